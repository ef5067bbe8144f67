"""Quality rules as a learned decision list.

One pass counts plain facts of every whole text (words, symbols, repeated lines, repeated five-word windows, ...).
Sequential covering on a bounded sample of labelled texts then grows conjunctions of thresholds, one rule at a time:
a rule starts empty, takes the threshold test with the greatest FOIL gain until it is precise enough or cannot be
improved, is pruned from its end on rows that did not grow it, and is kept only if it is precise on those rows too. The
texts it covers leave the sample and the next rule is grown. The list becomes one ordered conditional expression.

Defined cases: a null or empty text has no words and fails the base rule; without labels of both kinds the list is
empty and the base rule alone decides; documents whose doc_id is null or repeated are judged by their text like any
other; columns of the input with other names are kept by `filter_documents`.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_words, bounded_batches, labelled_sample, per_text

#: At most so many labelled documents fit the list; their counts, not their texts, come to the driver.
MAX_LABELLED = 20_000
MAX_RULES, MAX_TESTS, MIN_PRECISION, MIN_COVER, BINS = 12, 4, 0.97, 8, 32
SYMBOLS = "#*$%&|<>"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_digits long, n_marks long, n_bytes long, n_distinct long"
CAPITALS, DIGITS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?;:=_{}[]()\\/+~^@"

#: What the rules may test; each is 0 where its divisor is 0.
FEATURES = {
    "words": "cast(n_words as double)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "capitals_per_char": "n_capitals / greatest(word_chars, 1)",
    "digits_per_char": "n_digits / greatest(word_chars, 1)",
    "bytes_per_char": "n_bytes / greatest(word_chars, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "repeated_word_share": "n_repeat_words / greatest(n_words, 1)",
    "repeated_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "distinct_word_share": "n_distinct / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def repeated_words(words: list, size: int = 5) -> int:
    """How many words lie in a window of `size` words that the text has twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(windows) == len(set(windows)):
        return 0
    found, covered, end = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if found[window] > 1:
            covered += at + size - max(at, end)
            end = at + size
    return covered


def count_facts(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    text = text or ""
    raw, words = text.encode("utf-8", "surrogatepass"), ascii_words(text)
    seen: set[str] = set()
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    repeats = sum(x in seen or bool(seen.add(x)) for x in lines)
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    spaces = without(b" \t\n\x0b\x0c\r")
    return (len(words), len(text) - spaces, without(SYMBOLS.encode()), repeats, repeated_words(words), len(lines), without(CAPITALS), without(DIGITS), without(MARKS), len(raw) - spaces, len(set(words)))


def with_counts(docs: DataFrame) -> DataFrame:
    """docs as the struct column row, and the counts of its text as the struct column _facts."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), per_text(count_facts, COUNTS)("text").alias("_facts"))


@dataclass(frozen=True)
class Rule:
    """Reject where every test (feature, '<=' or '>', threshold) holds."""

    tests: tuple[tuple[str, str, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for name, op, at in self.tests:
            out &= x[name] <= at if op == "<=" else x[name] > at
        return out

    def condition(self, feature) -> Column:
        out = F.lit(True)
        for name, op, at in self.tests:
            out = out & (feature(name) <= at if op == "<=" else feature(name) > at)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{name} {op} {at:.6g}" for name, op, at in self.tests)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple:
    tests, inside = [], np.ones(len(bad), dtype=bool)
    while len(tests) < MAX_TESTS:
        p0, n0 = bad[inside].sum(), (~bad)[inside].sum()
        if not n0 or not p0:
            break
        best, base = (0.0, None, None), np.log2(p0 / (p0 + n0))
        for name, values in x.items():
            for at in np.unique(np.quantile(values[inside], np.linspace(0, 1, BINS + 1)[1:-1])):
                below = values <= at
                for op, side in (("<=", below), (">", ~below)):
                    cover = inside & side
                    p = bad[cover].sum()
                    if p >= MIN_COVER and (gain := p * (np.log2(p / cover.sum()) - base)) > best[0] + 1e-9:
                        best = (gain, (name, op, float(at)), cover)
        if best[1] is None:
            break
        tests.append(best[1])
        inside = best[2]
    return tuple(tests)


def _worth(rule: Rule, x: dict, bad: np.ndarray) -> tuple[float, int]:
    cover = rule.covers(x)
    return (float(bad[cover].mean()) if cover.any() else 0.0), int(bad[cover].sum())


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Sequential covering; every third row prunes and confirms, the others grow."""
    rules: list[Rule] = []
    if not len(bad) or bad.all() or not bad.any():
        return rules
    left, check = np.ones(len(bad), dtype=bool), np.arange(len(bad)) % 3 == 2
    while len(rules) < MAX_RULES:
        grow, prune = left & ~check, left & check
        part = lambda rows: ({k: v[rows] for k, v in x.items()}, bad[rows])
        if bad[grow].sum() < MIN_COVER or not len(bad[prune]):
            break
        tests = _grow(*part(grow))
        versions = [Rule(tests[:n]) for n in range(1, len(tests) + 1)]
        sound = [(_worth(r, *part(prune))[1], -len(r.tests), r) for r in versions if _worth(r, *part(prune))[0] >= MIN_PRECISION and _worth(r, *part(grow))[0] >= MIN_PRECISION]
        if not sound or max(sound)[0] == 0:
            break
        rules.append(max(sound, key=lambda s: s[:2])[2])
        left &= ~rules[-1].covers(x)
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """The decision list for docs (doc_id, text), from labels (doc_id, quality); 0 is bad. At most max_labelled labels are used."""
    sample = labelled_sample(labels, max_labelled)
    facts = with_counts(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text"))
    rows = facts.select("row.doc_id", "row.label", "_facts.*").selectExpr("doc_id", "label", *(f"{e} as `{k}`" for k, e in FEATURES.items())).toPandas().sort_values(["doc_id", *FEATURES], kind="stable")
    return learn_rules({k: rows[k].to_numpy(dtype=float) for k in FEATURES}, rows["label"].to_numpy() == 0)


def verdict(rules: list[Rule], facts: str = "_facts") -> tuple[Column, Column, Column]:
    """base_failed, the number of the first rule that rejects (null if none), and kept."""
    f = lambda name: F.col(f"{facts}.{name}")
    base = (f("n_words") < 10) | (100 * f("n_repeat_words") > 20 * f("n_words"))
    feature = lambda name: F.expr(_qualified(FEATURES[name], facts))
    first = F.lit(None).cast("int")
    for n, rule in reversed(list(enumerate(rules))):
        first = F.when(rule.condition(feature), F.lit(n)).otherwise(first)
    return base, first, ~base & first.isNull()


def _qualified(expression: str, facts: str) -> str:
    for name in (x.split()[0] for x in COUNTS.split(", ")):
        expression = expression.replace(name, f"{facts}.{name}")
    return expression


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and rule: the number of the rule that rejects the document."""
    base, first, kept = verdict(rules)
    return with_counts(docs.select("doc_id", "text")).select("row.doc_id", *(f"_facts.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base.alias("base_failed"), kept.alias("kept"), first.alias("rule"))


def filter_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that pass, with all their columns."""
    return with_counts(docs).where(verdict(rules)[2]).select("row.*")
