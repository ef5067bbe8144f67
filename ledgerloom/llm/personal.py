"""Personal data: fixed patterns give seed entities, and contextual bootstrapping finds further identifiers.

A seed is a whole fixed-pattern span. A candidate is a run of adjacent identifier-like tokens (each with a digit or an @)
that touches no span: single tokens, and the parts of longer runs that start or end their run. Either stands in lexical
contexts: the word before it, the word after it, two words before, two words after, and one on either side, each together
with its shape, and also with its outline (an @, or about how many digits), so that '(743) 555-3824' can stand where
'+1 (743) 555-3824' does. Spark scores the graph of contexts and values in rounds: a context gets the mean score of its
distinct values (smoothed; those that nothing speaks for lower it), a value the noisy-or of its contexts. Contexts of
high confidence and enough support mark every unseen candidate that stands in them. `find` and `redact` use contexts of
several words only: 'the' before a number says little, and carries scores to every number.

Defined cases: a null or empty text holds nothing; equal rows are each reported; without seeds nothing is discovered;
a discovered identifier never overlaps a fixed-pattern span and takes the kind most of its context's seeds have (ties:
the kind listed first); discovered ones that overlap are one; candidates under 6 code points are no identifiers, nor are
several tokens that together have more than 64 (single tokens may have any length; long ones and long words beside a value
are known by a hash of all of them); other columns, whatever their names, are kept by `redact`.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, per_text, written
from ledgerloom.llm.links import LIGHT, join_counted

KINDS = ("email", "ip", "card", "phone")
ROUNDS, MIN_SUPPORT, MIN_CONFIDENCE, PRIOR = 3, 3, 0.8, 1.0
TOKEN = (6, 64)

_MAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_DIGITS = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _WORD, _EDGES = re.compile("[0-9]"), re.compile(r"\S+"), "\"'`.,;:!?()[]{}<>*#$%&|="
_LIKE, _GAP, _NUMBER = re.compile("[0-9@]"), re.compile(r"[()]*[^\S\n\x0b-\x0d\x1c-\x1e\x85\u2028\u2029]+[()]*"), re.compile(r"[\x20\t().+0-9-]+")
SPAN = "struct<start:int,kind:int,end:int>"
EXTRACTED = f"counts array<long>, base array<{SPAN}>, tokens array<struct<start:int,end:int,kind:int,contexts:array<string>,value:string>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; each @ is looked at once, so a long run of name characters costs no more than its length."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _MAIL_NAME:
            start -= 1
        m = _MAIL_HOST.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Each run of dotted numbers is taken four parts at a time, which is what leftmost matching does."""
    out = []
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(s, 1, e) for s, e in addresses(text)]
        for m in _DIGITS.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


def shape(token: str) -> str:
    """Runs of letters, digits and other signs: a, d and the sign itself, digits with their number."""
    runs = re.findall(r"[0-9]+|[^\W\d_]+|.", token)
    return "".join(f"d{len(r)}" if r[0] in "0123456789" else "a" if r[0].isalpha() else r for r in runs)


def outline(value: str) -> str:
    """What a value shares with those of another shape: an @, or digits of about the number that phones or cards have; empty for all else."""
    if "@" in value:
        return "@"
    n = sum("0" <= c <= "9" for c in value)
    return ("#10" if n < 14 else "#14") if 10 <= n <= 19 and _NUMBER.fullmatch(value) else ""


def bounded(value: str) -> str:
    """The value itself, or something short that stands for a long one."""
    return value if len(value) <= TOKEN[1] else value[: TOKEN[1] // 2] + xxhash.xxh3_128_hexdigest(value.encode("utf-8", "surrogatepass"))


#: What contexts of several words start with; no word holds it.
SEVERAL = "\t"


def contexts_of(value: str, before: str | None, after: str | None, wide: tuple[bool, bool] = (True, True), far: tuple[str, str] = ("", "")) -> list[str]:
    """Contexts from the words beside a value (None: no context) and those beside them, with its shape and, on the sides that are wide, its outline."""
    form, rough = bounded(shape(value)), outline(value)
    forms = [[form, f"~{rough}"][: 1 + (side and bool(rough))] for side in wide]
    left, right = before is not None, after is not None
    out = [f"{bounded(before)} _{x}" for x in forms[0]] if left else []
    out += [f"_{x} {bounded(after)}" for x in forms[1]] if right else []
    # neither the edges of a text nor signs such as the bars of a table are words
    says = lambda *words: all(any(map(str.isalnum, w)) for w in words)
    if left and says(before, far[0]):
        out += [f"{SEVERAL}{bounded(far[0])} {bounded(before)} _{x}" for x in forms[0]]
    if right and says(after, far[1]):
        out += [f"{SEVERAL}_{x} {bounded(after)} {bounded(far[1])}" for x in forms[1]]
    if left and right and says(before, after):
        out += [f"{SEVERAL}{bounded(before)} _{x} {bounded(after)}" for x in min(forms, key=len)]
    return out


def candidate_runs(text: str, words: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Runs of adjacent identifier-like tokens outside of base spans: (number of the word, start, end) of each token without the signs around it."""
    starts, out, last = [s for s, _, _ in base], [], None
    for i, (begin, stop) in enumerate(words):
        word = text[begin:stop]
        if not _LIKE.search(word):
            continue
        value = word.strip(_EDGES)
        start = begin + word.index(value)
        end = start + len(value)
        if not value or any(s < end and e > start for s, _, e in base[max(0, bisect_right(starts, start) - 4) : bisect_right(starts, end)]):
            continue
        if last and last[0] == i - 1 and _GAP.fullmatch(text, last[2], start):
            out[-1].append((i, start, end))
        else:
            out.append([(i, start, end)])
        last = (i, start, end)
    return out


def extract(text: str | None) -> tuple[list, list, list]:
    """The values of EXTRACTED for one text."""
    text = text or ""
    base = base_spans(text)
    counts, tokens = [sum(k == n for _, k, _ in base) for n in range(4)], []
    if not _LIKE.search(text):
        return counts, base, tokens
    words = [m.span() for m in _WORD.finditer(text)]
    begins = [b for b, _ in words]
    before = lambda i: text[slice(*words[i - 1])].lower() if i > 0 else "^"
    after = lambda i: text[slice(*words[i + 1])].lower() if i + 1 < len(words) else "$"
    for start, kind, end in base:
        first, last = bisect_right(begins, start) - 1, bisect_right(begins, end - 1) - 1
        # what is glued to a span, other than signs, is the word beside it
        left, right = text[words[first][0] : start].strip(_EDGES).lower(), text[end : words[last][1]].strip(_EDGES).lower()
        value = text[start:end]
        far = before(first if left else first - 1), after(last if right else last + 1)
        tokens.append((start, end, kind, contexts_of(value, left or before(first), right or after(last), far=far), bounded(value)))
    for run in candidate_runs(text, words, base):
        n = len(run)
        parts = {(i, i) for i in range(n)}
        for i in range(n):  # parts that start or end the run, up to the greatest length
            if run[i][2] - run[0][1] <= TOKEN[1]:
                parts.add((0, i))
            if run[-1][2] - run[i][1] <= TOKEN[1]:
                parts.add((i, n - 1))
        for i, j in sorted(parts):
            start, end = run[i][1], run[j][2]
            if text.count(")", start, end) > text.count("(", start, end) and start and text[start - 1] == "(":
                start -= 1
            if end - start < TOKEN[0] or i < j and end - start > TOKEN[1]:
                continue
            value, outer = text[start:end], (i == 0, j == n - 1)
            beside = before(run[i][0]) if outer[0] or i == j else None, after(run[j][0]) if outer[1] or i == j else None
            tokens.append((start, end, -1, contexts_of(value, *beside, outer, (before(run[i][0] - 1), after(run[j][0] + 1))), bounded(value)))
    return counts, base, tokens


def extract_several(text: str | None) -> tuple[list, list, list]:
    """extract() with contexts of several words only."""
    counts, base, tokens = extract(text)
    return counts, base, [(a, b, k, [c for c in contexts if c.startswith(SEVERAL)], v) for a, b, k, contexts, v in tokens]


def extracted(docs: DataFrame, several: bool = False) -> DataFrame:
    """A written table of what each text holds: doc_id, key (a hash of the text), counts, base, tokens; with contexts of several words only, if wanted."""
    bounded_batches(docs.sparkSession)
    held = per_text(extract_several if several else extract, EXTRACTED)("text")
    return written(docs.select("doc_id", F.xxhash64("text").alias("key"), held.alias("x")).select("doc_id", "key", "x.*"), "personal")


def confident_contexts(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """context, kind: the contexts that mark identifiers, from the tokens of extracted()."""
    token = found.select(F.explode("tokens").alias("t"))
    edges = written(
        token.select(F.explode("t.contexts").alias("context"), "t.value", "t.kind").groupBy("context", "value").agg(F.max("kind").alias("kind")),
        "personal-edges",
    )
    size = edges.count()
    often = {c: written(edges.groupBy(c).agg(F.count("*").alias("n")).where(F.col("n") > LIGHT), "personal-counts") for c in ("value", "context")}
    seeds = edges.where("kind >= 0").groupBy("value").agg(F.min("kind").alias("kind"))
    scores = written(seeds.select("value", "kind", F.lit(1.0).alias("score")), "personal-scores")
    for n in range(rounds):
        # distinct tokens per context are counted before anything is joined back, so a common context is one row
        held = join_counted(edges.select("context", "value"), scores, ["value"], often["value"], "left", size)
        votes = F.array(*(F.struct(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias("n"), F.lit(-k).alias("k")) for k in range(len(KINDS))))
        contexts = held.groupBy("context").agg(
            (F.sum(F.coalesce("score", F.lit(0.0))) / (F.count("*") + PRIOR)).alias("confidence"),
            F.count_if(F.col("score") >= 0.5).alias("support"),
            F.negative(F.array_max(votes)["k"]).alias("kind"),
        )
        contexts = written(contexts.where((F.col("support") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE / 2)), "personal-contexts")
        if n + 1 < rounds:
            reached = join_counted(edges.select("context", "value"), contexts, ["context"], often["context"], total=size).groupBy("value").agg(F.min("kind").alias("kind"), (1 - F.exp(F.sum(F.ln(1 - 0.99 * F.col("confidence"))))).alias("score"))
            scores = written(reached.join(seeds.select("value"), "value", "left_anti").unionByName(seeds.select("value", "kind", F.lit(1.0).alias("score"))), "personal-scores")
    return contexts.where(F.col("confidence") >= MIN_CONFIDENCE).select("context", "kind")


def discovered(found: DataFrame, contexts: DataFrame) -> DataFrame:
    """doc_id, key, added: the spans that the contexts mark, sorted; overlapping ones are one span of the kind of the first and longest."""
    token = found.select("doc_id", "key", F.explode("tokens").alias("t")).where("t.kind < 0")
    each = token.select("doc_id", "key", "t.start", "t.end", F.explode("t.contexts").alias("context"))
    often = written(each.groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") > LIGHT), "personal-counts")
    marked = join_counted(each, contexts, ["context"], often, total=each.count()).groupBy("doc_id", "key", "start", "end").agg(F.min("kind").alias("kind"))
    spans = marked.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", F.negative("end").alias("back"), "kind"))).alias("spans"))

    def merge(done: Column, s: Column) -> Column:
        last, end = F.try_element_at(done, F.lit(-1)), F.negative(s["back"])
        new = F.struct(s["start"].alias("start"), s["kind"].alias("kind"), end.alias("end"))
        wider = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], end).alias("end"))
        overlaps = (F.size(done) > 0) & (s["start"] < last["end"])
        return F.when(overlaps, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(done, F.array(new)))

    return spans.select("doc_id", "key", F.aggregate("spans", F.array().cast(f"array<{SPAN}>"), merge).alias("added"))


def _joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _with_added(docs: DataFrame, added: DataFrame) -> DataFrame:
    more = added.withColumnsRenamed({"doc_id": "_of", "key": "_at"})
    return docs.join(more, F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("key") == F.col("_at")), "left").drop("_of", "_at")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the four base counts, base (text of the base spans) and spans (text of all)."""
    found = extracted(docs, several=True)
    rows = _with_added(found.select("doc_id", "key", "counts", "base"), discovered(found, confident_contexts(found)))
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>"))))
    return rows.select("doc_id", *(F.col("counts")[n].alias(f"n_{k}") for n, k in enumerate(KINDS)), _joined(F.col("base")).alias("base"), _joined(every).alias("spans"))


def redacted(text: str | None, added: list | None) -> str | None:
    """The text with each span replaced by its kind; overlapping spans are replaced together by the first one's kind."""
    if not text:
        return text
    out, at = [], 0
    more = [] if added is None else [(int(s["start"]), int(s["kind"]), int(s["end"])) for s in added]
    for start, kind, end in sorted([*base_spans(text), *more]):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced by <EMAIL>, <IP>, <CARD> or <PHONE>; n_chars, if there, is counted anew."""
    bounded_batches(docs.sparkSession)
    found = extracted(docs, several=True)
    added = written(discovered(found, confident_contexts(found)), "personal-added")
    replace = F.pandas_udf(lambda x, a: pd.Series([redacted(t, s) for t, s in zip(x, a)], dtype=object), "string")
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    keyed = docs.select(rest.alias("rest"), "text", "doc_id", F.xxhash64("text").alias("key"))
    rows = _with_added(keyed, added).select("rest", replace("text", "added").alias("new"))
    value = lambda c: F.col("new") if c == "text" else F.length("new").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"rest.`{c}`")
    return rows.select(*(value(c).alias(c) for c in docs.columns))
