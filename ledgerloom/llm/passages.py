"""Removing passages that occur more than once, located by Aho-Corasick automata.

A window is `window` consecutive words; every word covered by a window that starts at two places or more is removed.
The smallest of the word runs of length ANCHOR inside a window is its anchor (equal windows have equal anchors), so a
document falls into segments of consecutive windows with one anchor:

1. Spark counts anchors; segments whose anchor occurs once hold no recurring window and leave. An anchor with more than
   MOST different segments (a phrase in many contexts) has its segments cut into single windows, which are counted like
   segments, so no group grows with it.
2. Equal segments are counted and go on as one, with the words of one of their places.
3. The segments are dealt by anchor over shards. A shard confirms what recurs: whole segments with two places or more, and
   windows that segments of one anchor share. It compiles these passages into pyahocorasick automata over word numbers
   and streams all its segments, so those of every document, through them; what they match is word by word equal.
4. The matches go back to the places of the segments, and each document loses the words they cover.

An automaton would have to see every document, and automata grow with the corpus; dealing both by anchor shows each
segment only the automaton that may know it. By then counting has already said which windows recur, so what the automata
add is word-by-word confirmation and the places. Hashes of 128 bits decide which segments are equal; windows are compared as
words. Keys with many rows are joined by a broadcast of a bounded number of rows (links.join_counted).

Defined cases: a null or empty text has no words and keeps an empty text; a document of fewer words than a window keeps
all; equal rows remove each other's windows; null ids are ids like others; a very long text is one row of its own size;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from hashlib import sha256

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_words, bounded_batches, drop_written, per_text, plain, squeezed, written
from ledgerloom.llm.links import join_counted
from ledgerloom.llm.shingles import runs, signed, spans, wide_hashes

WINDOW, ANCHOR = 35, 6
#: Segments of an anchor before they are cut into windows; segments of a shard, and of one automaton (a bit more where an anchor needs it).
MOST, SHARD, AUTOMATON = 2_000, 10_000, 400
RUNS = "array<struct<at:int,size:int>>"


def segments(text: str | None, window: int = WINDOW) -> tuple:
    """Anchor hashes, segment hashes, first window and number of windows of each segment of a text."""
    low_half, high_half = wide_hashes(ascii_words(text))
    n = len(low_half) - window + 1
    if n <= 0:
        return [], [], [], []
    grams = runs(low_half, ANCHOR)
    inside = window - ANCHOR + 1
    at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams, inside).argmin(axis=1)
    first = np.flatnonzero(np.r_[True, np.diff(at) != 0])
    count = np.diff(np.r_[first, n])
    with np.errstate(over="ignore"):
        whole = spans(high_half, first, count + window - 1) + (at[first] - first).astype(np.uint64)
    return signed(grams[at[first]]), signed(whole), first.astype(np.int32), count.astype(np.int32)


def single_windows(text: str | None, known: list, window: int = WINDOW) -> list[tuple]:
    """(anchor, hash of the window, its start) for each window of the known segments (anchor, lo, n)."""
    high = wide_hashes(ascii_words(text))[1]
    starts = np.concatenate([np.arange(s["lo"], s["lo"] + s["n"]) for s in known])
    hashes = signed(spans(high, starts, np.full(len(starts), window)))
    return list(zip(np.repeat([s["anchor"] for s in known], [s["n"] for s in known]).tolist(), hashes.tolist(), starts.tolist()))


def merged(starts: list[int], sizes: list[int]) -> list[tuple[int, int]]:
    """Runs that overlap or touch as one, (start, size) in order."""
    out: list[list[int]] = []
    for start, size in sorted(zip(starts, sizes)):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + size - out[-1][0])
        else:
            out.append([start, size])
    return [(a, b) for a, b in out]


def passages_of(group: list[tuple[tuple[int, ...], int]], window: int) -> set[tuple[int, ...]]:
    """What recurs among segments (words, places) of one anchor: segments of several places, and shared windows."""
    whole = {words for words, places in group if places > 1}
    if len(group) == 1:
        return whole
    seen: Counter = Counter()
    for words, places in group:
        for i in range(len(words) - window + 1):
            seen[words[i : i + window]] += places
    return whole | {w for w, n in seen.items() if n > 1}


def located(groups: list[list[tuple[tuple[int, ...], int]]], window: int) -> list[list[tuple[int, int]]]:
    """The runs of recurring words in each segment of these groups, by one automaton."""
    patterns = set().union(*(passages_of(g, window) for g in groups))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for p in patterns:
        automaton.add_word(p)
    if not patterns:
        return [[] for g in groups for _ in g]
    automaton.make_automaton()
    out = []
    for words, _ in (s for g in groups for s in g):
        ends, sizes = zip(*hits) if (hits := list(automaton.iter(words))) else ((), ())
        out.append(merged([e - n + 1 for e, n in zip(ends, sizes)], sizes))
    return out


def locate(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """anchor, segment and runs of a shard's segments that hold recurring words."""
    pdf = pdf.drop_duplicates(["anchor", "segment"]).sort_values(["route", "anchor", "segment"])
    numbers: dict[str, int] = {}
    words = [tuple(numbers.setdefault(w, len(numbers)) for w in t.split(" ")) for t in pdf["words"]]
    route, places = pdf["route"].to_numpy(), pdf["places"].tolist()
    cuts = [0, *(np.flatnonzero(np.diff(route)) + 1).tolist(), len(pdf)] if len(pdf) else [0]
    found, batch, held = [], [], 0
    for a, b in zip(cuts, cuts[1:]):
        batch.append(list(zip(words[a:b], places[a:b])))
        held += b - a
        if held >= AUTOMATON or b == len(pdf):
            found += located(batch, window)
            batch, held = [], 0
    out = pdf[["anchor", "segment"]].assign(runs=found)
    return out[out["runs"].map(len) > 0]


def removed(words: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A mask of the words in runs of sizes[i] from starts[i]."""
    steps = np.zeros(words + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + sizes, -1)
    return np.cumsum(steps[:-1]) > 0


def finish(text: str | None, known: list | None) -> tuple[int, int, str]:
    """n_words, n_removed and kept_sha256 of a text without its runs."""
    words = ascii_words(text)
    ranges = np.array([(r["at"], r["size"]) for r in known] if known is not None else [], dtype=np.int64).reshape(-1, 2)
    mask = removed(len(words), ranges[:, 0], ranges[:, 1])
    return len(words), int(mask.sum()), sha256(b" ".join([w for w, gone in zip(words, mask.tolist()) if not gone])).hexdigest()


def with_texts(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """doc_id, packed (squeezed text) and the other columns of lists (of, at, ...) for documents (doc_id, key, text)."""
    packed = docs.select("doc_id", "key", F.pandas_udf(squeezed, "binary")("text").alias("packed"))
    return packed.join(lists, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("at")), how).drop("of", "at")


def by_document(rows: DataFrame, *columns: str) -> DataFrame:
    """of, at (the document's doc_id and key) and known, the list of its rows."""
    return rows.groupBy(F.col("doc_id").alias("of"), F.col("key").alias("at")).agg(F.collect_list(F.struct(*columns)).alias("known"))


def distinct_segments(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "lo", "size")).alias("first"))


def windows_of_common(keyed: DataFrame, candidates: DataFrame, common: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """The candidates of anchors in common, each window a segment of its own."""
    lists = by_document(join_counted(candidates, common, ["anchor"], counts, "left_semi"), "anchor", "lo", F.col("size").alias("n"))

    def cut(packed: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([single_windows(plain(t), k, window) for t, k in zip(packed, known)], dtype=object)

    cut = F.pandas_udf(cut, "array<struct<anchor:long,segment:long,lo:int>>")
    rows = with_texts(keyed.dropDuplicates(["doc_id", "key"]), lists, "inner")
    return rows.select("doc_id", "key", F.explode(cut("packed", "known")).alias("w")).select("doc_id", "key", "w.*", F.lit(1).alias("size"))


def recurring_runs(keyed: DataFrame, window: int, most: int) -> DataFrame:
    """of, at, known: for every document with recurring words the runs of them."""
    cut = per_text(lambda t: segments(t, window), "anchor array<long>, segment array<long>, lo array<int>, size array<int>")
    cut_up = keyed.select("doc_id", "key", cut("text").alias("s")).select("doc_id", "key", F.explode(F.arrays_zip("s.anchor", "s.segment", "s.lo", "s.size")).alias("s"))
    places = written(cut_up.select("doc_id", "key", "s.*"), "places")
    counts = written(places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    candidates = written(join_counted(places, counts.select("anchor"), ["anchor"], counts, "left_semi"), "candidates")
    drop_written(places)
    distinct = written(distinct_segments(candidates), "distinct")

    common = written(distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > most).select("anchor"), "common")
    if not common.isEmpty():
        windows = written(windows_of_common(keyed, candidates, common, counts, window), "windows")
        rest = written(join_counted(candidates, common, ["anchor"], counts, "left_anti"), "candidates")
        shared = written(distinct_segments(windows).where("n > 1").withColumn("route", F.col("segment")), "distinct")
        candidates = rest.unionByName(windows)
        per_anchor = written(distinct.groupBy("anchor").agg(F.count("*").alias("n")), "kinds")
        distinct = join_counted(distinct, common, ["anchor"], per_anchor, "left_anti").withColumn("route", F.col("anchor")).unionByName(shared)
    else:
        distinct = distinct.withColumn("route", F.col("anchor"))

    def words_of(packed: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for raw, k in zip(packed, known):
            words = [w.decode("utf-8", "surrogatepass") for w in ascii_words(plain(raw))]
            out.append([" ".join(words[s["lo"] : s["lo"] + s["size"] + window - 1]) for s in k])
        return pd.Series(out, dtype=object)

    lists = by_document(distinct.select("first.*", "route", "anchor", "segment", F.col("n").alias("places")), "lo", "size", "route", "anchor", "segment", "places")
    texts = with_texts(keyed, lists, "inner").select("known", F.pandas_udf(words_of, "array<string>")("packed", "known").alias("words"))
    each = texts.select(F.explode(F.arrays_zip("known", "words")).alias("x")).select("x.known.route", "x.known.anchor", "x.known.segment", "x.known.places", "x.words")
    shards = max(1, -(-distinct.count() // SHARD))
    dealt = each.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
    found = dealt.groupBy("shard").applyInPandas(lambda pdf: locate(pdf, window), f"anchor long, segment long, runs {RUNS}")
    found = written(found, "found")

    segment_counts = written(distinct.select("anchor", "segment", "n"), "segments")
    hits = join_counted(candidates, found, ["anchor", "segment"], segment_counts)
    each = hits.select("doc_id", "key", "lo", F.explode("runs").alias("r")).select("doc_id", "key", (F.col("lo") + F.col("r.at")).alias("at"), "r.size")
    return written(by_document(each, "at", "size"), "runs")


def remove_recurring(docs: DataFrame, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per document. most: different segments of an anchor from which on they are cut into windows."""
    bounded_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    lists = recurring_runs(keyed, window, most)

    def finished(packed: pd.Series, known: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([finish(plain(t), k) for t, k in zip(packed, known)], columns=["n_words", "n_removed", "kept_sha256"])

    done = F.pandas_udf(finished, "n_words long, n_removed long, kept_sha256 string")
    return with_texts(keyed, lists, "left").select("doc_id", done("packed", "known").alias("x")).select("doc_id", "x.*")
