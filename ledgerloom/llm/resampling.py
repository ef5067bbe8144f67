"""Importance resampling of documents towards the texts of a target, by hashed runs of words.

Two passes over whole texts in Arrow batches. The first counts features (runs of 1 to RUN consecutive words) in BUCKETS
hashed buckets: np.bincount gives a vector for each partition, treeReduce merges them. A bucket's gain is the logarithm of
its smoothed share in the target over that in the documents. The second pass gathers the gains of every feature and sums
them by document with the weights of np.bincount. The logarithm of the weight plus Gumbel noise from a hash of doc_id is
the score, and the highest scores are drawn: a sample without replacement, in proportion to the weights.

Texts are cut at spaces into stretches of STRETCH bytes and their features go on in lots of LOT, so memory does not grow
with a text. Ranks come from a sort by ranges among the rows above a quantile that surely lies below the last one drawn.

Defined cases: null and empty texts have no features, the weight 0, and are not drawn; a null doc_id is hashed as the
empty text and comes before others with the same score; repeated rows are documents each; an empty table gives an empty
result, an empty target smoothed gains; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, written
from ledgerloom.shared import numbered

BUCKETS, RUN, SEED = 10_000, 3, 42
#: Documents of fewer words are not drawn; of the others this share, in hundredths, is.
LEAST_WORDS, PERCENT = 20, 5
STRETCH, LOT = 2**20, 2**20
#: For the quantile that spares most rows the sort: its accuracy, and how far below the share drawn it is taken.
ACCURACY, SLACK = 10_000, 0.01

#: Bytes of a text as a word has them (A-Z lower-cased; digits, letters and all bytes from 128 stay), else a space.
FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))


def features(text: str | None, run: int = RUN, buckets: int = BUCKETS, stretch: int = STRETCH) -> Iterator[np.ndarray]:
    """The buckets of a text's features, in arrays that follow from stretch to stretch."""
    raw, at, kept = (text or "").encode("utf-8", "replace").translate(FOLD), 0, []
    while at < len(raw):
        end = raw.find(b" ", at + stretch)
        end = len(raw) if end < 0 else end
        words = kept + raw[at:end].split()
        spaced, hashes = [b" " + w for w in words], list(map(crc32, words))
        for n in range(1, run + 1):
            # hashes[i] is that of n words from i; those that end in kept words were counted before
            yield np.array(hashes[max(len(kept) - n + 1, 0) :], dtype=np.int64) % buckets
            hashes = list(map(crc32, islice(spaced, n, None), hashes))
        kept, at = words[-(run - 1) :] if run > 1 else [], end


def lots(texts: list, run: int = RUN, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of texts, buckets), a pair for each feature of all texts, in lots of about LOT."""
    places, found, n = [], [], 0
    for k, text in enumerate(texts):
        for b in features(text, run, buckets):
            places.append((k, len(b)))
            found.append(b)
            n += len(b)
            if n >= LOT:
                yield np.repeat(*np.array(places).T), np.concatenate(found)
                places, found, n = [], [], 0
    if found:
        yield np.repeat(*np.array(places).T), np.concatenate(found)


def count_features(docs: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, found in lots(batch.column(0).to_pylist(), run, buckets):
                total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = docs.select("text").mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, dtype=np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets, dtype=np.int64)


def gains(target: np.ndarray, every: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of a bucket's share in the target over its share in the documents, each smoothed by 1."""
    t_all, s_all, n = float(target.sum()), float(every.sum()), len(every)
    ratio = [(t + 1) * (s_all + n) / ((s + 1) * (t_all + n)) for t, s in zip(target.astype(float).tolist(), every.astype(float).tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def weigh(docs: DataFrame, of: np.ndarray, run: int = RUN) -> DataFrame:
    """doc_id, n_features and weight, the sum of the gains `of` buckets over a document's features."""
    bounded_batches(docs.sparkSession)
    shared, buckets = docs.sparkSession.sparkContext.broadcast(of.astype(np.float64)), len(of)  # whole numbers: sums are exact below 2^53

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(len(batch), dtype=np.int64)
            weight = np.zeros(len(batch))
            for place, found in lots(batch.column("text").to_pylist(), run, buckets):
                n += np.bincount(place, minlength=len(batch))
                weight += np.bincount(place, weights=shared.value[found], minlength=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(weight.astype(np.int64))], names=["doc_id", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(add_up, f"doc_id {kind}, n_features long, weight long")


def noise(doc_id, seed: int = SEED):
    """floor(1000 times) a Gumbel variable, from the first 32 bits of a hash of the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(2**32))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per document; rank counts from 1 for those that are drawn, else it is null.

    target: a table with a column text. Of the documents with at least `least_words` words, `percent` in a hundred are drawn.
    """
    of = gains(count_features(target), count_features(docs))
    scored = weigh(docs, of).withColumn("score", F.col("weight") + noise("doc_id"))
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # n words have n + n - 1 + n - 2 features, as far as these are not negative
    large = F.col("n_features") >= sum(max(least_words - k, 0) for k in range(RUN))
    some, n = scored.where(large).agg(F.percentile_approx("score", max(0.0, 1 - percent / 100 - SLACK), ACCURACY), F.count("*")).first()
    drawn = n * percent // 100
    ahead = large & (F.col("score") >= F.lit(some)) if drawn else F.lit(False)
    ranked = numbered(scored.where(ahead), "rank", F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row"))
    rest = scored.where(~ahead).withColumn("rank", F.lit(None).cast("long"))
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", rank)


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that are drawn, with the columns of docs and in no order; null ids are not drawn, of a repeated id every row is if one is."""
    ids = resample(docs, target, percent).where("rank is not null").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi")
