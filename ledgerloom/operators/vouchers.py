"""Vouchers: what the lines of one voucher say together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import CLOSING, JOIN
from ledgerloom.functions import scalars as S
from ledgerloom.shared import join_groups


def subject_set(column: str = "subject"):
    """The distinct non-empty subjects of a group, in code-point order."""
    return F.array_sort(F.collect_set(F.nullif(F.col(column), F.lit(""))))


def vouchers(lines: DataFrame) -> DataFrame:
    """One row per voucher: its subjects by side, its feature, sums and counts. One shuffle; amounts are summed on the map side first."""
    side = S.direction(F.col("debit"), F.col("credit"))
    of = lambda d: F.array_sort(F.collect_set(F.when(side == d, F.nullif("subject", F.lit("")))))
    out = lines.groupBy("voucher").agg(
        subject_set().alias("subjects"),
        of("借").alias("debit_subjects"),
        of("贷").alias("credit_subjects"),
        F.array_sort(F.collect_set(F.when((F.col("credit") > 0) & (F.col("debit") > 0), F.nullif("subject", F.lit(""))))).alias("both_subjects"),
        F.sum(F.abs("debit")).alias("abs_amount"),
        F.sum("debit").alias("debit_sum"),
        F.sum("credit").alias("credit_sum"),
        F.count_if(F.col("debit") > 0).alias("n_debit"),
        F.count_if(F.col("credit") > 0).alias("n_credit"),
        F.count("*").alias("n_lines"),
    )
    return out.withColumn("feature", S.join_subjects(F.col("subjects")))


def is_closing(feature="feature"):
    """Vouchers that only close the books: their feature contains a closing account."""
    return S.contains_any(F.col(feature), CLOSING)


def business_vouchers(lines: DataFrame) -> DataFrame:
    return vouchers(lines).where(~is_closing())


def filter_closing(lines: DataFrame) -> DataFrame:
    """The lines of vouchers that do not close the books; closing vouchers are few, so they are looked up, not the others."""
    closing = lines.where(S.contains_any(F.col("subject"), CLOSING)).select("voucher").distinct()
    return lines.join(closing, "voucher", "left_anti")


def with_counter_subjects(lines: DataFrame) -> DataFrame:
    """direction and counter_subject: the subjects on the other side of the voucher, without the line's own. The sets of both sides are aggregated by voucher and joined back, so a voucher may have any number of lines; an uploaded journal's own contra accounts (given_counter) stay instead."""
    lines = lines.withColumn("direction", S.direction(F.col("debit"), F.col("credit")))
    if "given_counter" in lines.columns:
        return lines.withColumnRenamed("given_counter", "counter_subject")
    of = lambda d: F.array_sort(F.collect_set(F.when(F.col("direction") == d, F.nullif("subject", F.lit("")))))
    sets = lines.groupBy("voucher").agg(F.count("*").alias("n_rows"), of("借").alias("_d"), of("贷").alias("_c"))
    sides = join_groups(lines, sets, "voucher", "line_no")
    other = F.when(F.col("direction") == "借", F.col("_c")).when(F.col("direction") == "贷", F.col("_d")).otherwise(F.array().cast("array<string>"))
    return sides.withColumn("counter_subject", F.array_join(F.array_remove(other, F.col("subject")), JOIN)).drop("_d", "_c")


def voucher_summary(v: DataFrame) -> DataFrame:
    return v.select("voucher", "feature", F.col("debit_sum").cast("double").alias("debit_sum"), F.col("credit_sum").cast("double").alias("credit_sum"), F.format_string("借方%d条/贷方%d条", "n_debit", "n_credit").alias("sides"))


def feature_distribution(v: DataFrame) -> DataFrame:
    return v.groupBy("feature").agg(F.count("*").alias("n_vouchers"))


def samples(lines: DataFrame, n: int = 5) -> DataFrame:
    """voucher, subjects (of its lines in order), feature, of the first n vouchers by their text."""
    first = lines.select("voucher").distinct().orderBy("voucher").limit(n)
    own = lines.join(F.broadcast(first), "voucher").groupBy("voucher").agg(F.array_sort(F.collect_list(F.struct("line_no", "subject"))).alias("l"), S.join_subjects(subject_set()).alias("feature"))
    return own.select("voucher", F.array_join(F.transform("l", lambda x: x["subject"]), ", ").alias("subjects"), "feature")


def amount_stats(v: DataFrame) -> DataFrame:
    """Over vouchers: total, mean, largest and smallest absolute amount, and the sum of signed debits."""
    return v.agg(
        F.count("*").alias("n_vouchers"),
        F.sum("abs_amount").cast("double").alias("total"),
        S.round2(F.sum("abs_amount").cast("double") / F.count("*")).alias("mean"),
        F.max("abs_amount").cast("double").alias("largest"),
        F.min("abs_amount").cast("double").alias("smallest"),
        F.sum("debit_sum").cast("double").alias("debit_total"),
    )


def voucher_meta(lines: DataFrame, summary: str = "summary") -> DataFrame:
    """First date and number of a voucher, and its distinct summaries in the order they appear."""
    seen = F.array_sort(F.collect_list(F.when(F.trim(F.col(summary)) != "", F.struct("line_no", F.trim(F.col(summary)).alias("s")))))
    return lines.groupBy("voucher").agg(
        F.min_by("date", "line_no").alias("date"),
        F.min_by("number", "line_no").alias("number"),
        F.array_join(F.array_distinct(F.transform(seen, lambda x: x["s"])), " | ").alias("summaries"),
    )
