"""Column functions over subjects, amounts, voucher numbers and scores. All are built-in expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.config import CATEGORIES, DEFAULT, HARD_BONES, JOIN, SENSITIVE, SUFFIXES, Settings

SPACE = r"(?U)^\s+|\s+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def round2(x: Column) -> Column:
    """Two decimals, half to even on the binary value: the same in every engine."""
    return F.rint(x * 100) / 100


def strip(x: Column) -> Column:
    return F.regexp_replace(x, SPACE, "")


def normalize_subject(x: Column) -> Column:
    """Null is empty; Unicode white space leaves the ends, spaces and tabs leave the inside."""
    return F.coalesce(F.regexp_replace(strip(x), r"[ \t]", ""), F.lit(""))


def first_level_subject(name: Column, code: Column | None = None) -> Column:
    """The part before the first separator present, tried in the order - _ —— —; names with a code of up to three digits stay whole."""
    s = normalize_subject(name)
    out = s
    for mark in ("—", "——", "_", "-"):
        out = F.when(F.instr(s, mark) > 0, F.substring_index(s, mark, 1)).otherwise(out)
    if code is None:
        return out
    return F.when(code.rlike(r"^[0-9]{1,3}$"), s).otherwise(out)


def voucher_id(date: Column, number: Column) -> Column:
    """year年month月-number from yyyy-m-d, yyyy/m/d or yyyy年m月d日 text (the day is dropped); the bare number where the date says nothing."""
    number = F.coalesce(number, F.lit(""))
    text = date.cast("string")
    found = None
    for pattern in (r"^([0-9]{4})[/-]([0-9]{1,2})[/-][0-9]{1,2}", r"^([0-9]{4})年([0-9]{1,2})月[0-9]{1,2}日?"):
        year, month = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
        one = F.when(year != "", F.concat(year, F.lit("年"), F.try_to_number(month, F.lit("99")).cast("int").cast("string"), F.lit("月-"), number))
        found = one if found is None else F.coalesce(found, one)
    return F.coalesce(found, number)


def format_amount(x: Column) -> Column:
    """A number from text with thousands separators; 0 where it is none."""
    s = F.regexp_replace(x.cast("string"), "[, ]", "")
    return F.coalesce(F.when(s.rlike(NUMBER), s.try_cast("double")), F.lit(0.0))


def contra_amount(x: Column, strip_commas: bool = False) -> Column:
    """A number from text without separators (they make it 0, unless strip_commas), to two decimals."""
    s = F.regexp_replace(x.cast("string"), "," if strip_commas else "(?!)", "")
    s = strip(s)
    return round2(F.coalesce(F.when(s.rlike(NUMBER), s.try_cast("double")), F.lit(0.0)))


def direction(debit: Column, credit: Column) -> Column:
    return F.when(debit > 0, "借").when(credit > 0, "贷").otherwise("")


def contra_uid(date: Column, number: Column) -> Column:
    """date_number, day kept; nulls read nan."""
    return F.concat_ws("_", F.coalesce(date.cast("string"), F.lit("nan")), F.coalesce(number.cast("string"), F.lit("nan")))


def split_subjects(x: Column) -> Column:
    """The non-empty parts of a joined string."""
    return F.filter(F.transform(F.split(x, JOIN), lambda s: F.trim(s)), lambda s: s != "")


def join_subjects(x: Column) -> Column:
    return F.array_join(x, JOIN)


def contains_any(x: Column, words: list[str]) -> Column:
    return x.rlike("|".join(map(re.escape, words)))


def is_sensitive(x: Column) -> Column:
    return contains_any(x, SENSITIVE)


def bone_multiplier(x: Column) -> Column:
    return F.when(contains_any(x, HARD_BONES), 2.0).otherwise(1.0)


def pattern_hash(subjects: Column) -> Column:
    return F.md5(join_subjects(F.array_sort(F.array_distinct(subjects))).cast("binary"))


def alpha(amount: Column, level: Column, s: Settings = DEFAULT) -> Column:
    """1 from the materiality level on, falling exponentially below it."""
    ratio = F.try_divide(amount, level)
    return F.when((level <= 0) | (amount >= level), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(s.slope * (ratio - 1)))))


def rarity(share: Column, hhi: Column) -> Column:
    """How rare a share is, on a scale that concentration bends: (f^-(1-h) - 1) / (1-h), or -ln f for h = 1."""
    e = 1 - hhi
    return F.when(hhi >= 0.9999, -F.ln(share)).otherwise(F.try_divide(F.pow(share, -e) - 1, e))


def risk_level(score: Column) -> Column:
    return F.when(score >= 80, "高风险 🔴").when(score >= 30, "中风险 🟠").when(score >= 10, "中低风险 🟡").otherwise("正常 🟢")


def anomaly_type(cross: Column, inner: Column) -> Column:
    return F.when((cross > 0) & (inner > 0), "跨模块+内部异常").when(cross > 0, "跨模块异常").when(inner > 0, "模块内异常").otherwise("正常")


def hhi_band(hhi: Column) -> Column:
    return F.when(hhi >= 0.5, "高度集中").when(hhi >= 0.25, "中度集中").otherwise("低度集中")


def subject_category(x: Column) -> Column:
    """asset, liability, expense, cost, revenue or default."""
    return reduce(lambda out, c: out.when(x.isin(c[1]), c[0]), CATEGORIES.items(), F).otherwise("default")


def node_width(x: Column) -> Column:
    wide = F.length(F.regexp_replace(x, r"[^一-鿿]", ""))
    return wide * 15 + (F.length(x) - wide) * 8 + 36


def edge_width(weight: Column, most: Column) -> Column:
    return 1.5 + F.log1p(weight) / F.log1p(most) * 6.5


def edge_opacity(weight: Column, most: Column) -> Column:
    return 0.28 + F.log1p(weight) / F.log1p(most) * 0.55


def bezier(x0: Column, y0: Column, x1: Column, y1: Column, samples: int = 60) -> Column:
    """Points of a cubic curve from (x0, y0) to (x1, y1) that leaves and arrives level."""
    mid = (x0 + x1) / 2

    def at(i: Column) -> Column:
        t = i / F.lit(float(samples - 1))
        u = 1 - t
        a, b, c, d = u * u * u, 3 * u * u * t, 3 * u * t * t, t * t * t
        return F.struct((a * x0 + b * mid + c * mid + d * x1).alias("x"), (a * y0 + b * y0 + c * y1 + d * y1).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), at)


def tokens(subjects: Column) -> Column:
    """Each subject without its class suffix, then the subject itself."""
    return F.flatten(F.transform(subjects, lambda s: F.array(F.regexp_replace(s, f"[{SUFFIXES}]$", ""), s)))
