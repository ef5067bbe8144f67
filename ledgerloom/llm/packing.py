"""Packing tokenised documents into sequences of fixed length by swap-based local search.

A document's ids (and the end id) are cut into pieces only where they exceed a sequence. Shorter pieces are dealt at
random over shards of about SHARD pieces, and every shard is packed on its own: the pieces fill bins in the order in which
they come (about a fifth too many bins), and local search on the bins that are not full, from the emptiest, does the
rest: one or two pieces move to another bin, or change places with a smaller one there, whenever that raises the sum of
squared fills; a bin that runs empty is gone. The bins that shards leave open are dealt again, bin by bin, over as many
shards as they need, and searched on, until one shard holds them all; so the number of sequences hardly depends on the
size of a shard. Where a turn gains next to nothing (lengths that fill no bin), it was the last.

Defined cases: a null or empty text is the end id alone; every row of the input is packed, repeated rows too; the
numbers of sequences are unique but not dense; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, written
from ledgerloom.llm.tokens import END_ID, WordEncoder, default_tokenizer

LENGTH, SHARD = 4096, 8_000
#: A turn over all shards has to bring this share of pieces to rest, or empty this share of bins, for another to follow.
GAIN = 0.005
PIECES = "pieces array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


def cut(text: str | None, encode: WordEncoder, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids) of a document."""
    raw = encode(text) + np.array([END_ID], dtype="<u4").tobytes()
    return [(n, at // 4, len(part) // 4, zlib.crc32(part)) for n, at in enumerate(range(0, len(raw), 4 * length)) if (part := raw[at : at + 4 * length])]


def next_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for each length, in the order in which they come: where the last bin is too full, a new one."""
    out, k, fill = np.zeros(len(lengths), dtype=np.int64), -1, capacity
    for i, x in enumerate(lengths.tolist()):
        if fill + x > capacity:
            k, fill = k + 1, 0
        fill += x
        out[i] = k
    return out


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for each length: longest first, into the fullest bin that has room. What the local search can be held against; it does not start from it."""
    bins, room, out = 0, [], np.zeros(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        at = bisect_left(room, (int(lengths[i]), -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            left, k = capacity, bins
            bins += 1
        out[i] = k
        if left > lengths[i]:
            insort(room, (left - int(lengths[i]), k))
    return out


@lru_cache(64)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def group_sums(own: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of one and then of two of these lengths, and for each room up to the capacity the greatest of them that fits (0: none)."""
    n = len(own)
    i, j = _pairs(n) if n <= 256 else np.triu_indices(n, 1)
    sums, fitting = np.concatenate([own, own[i] + own[j]]), np.zeros(capacity + 1, dtype=own.dtype)
    small = sums[sums <= capacity]
    fitting[small] = small
    return sums, np.maximum.accumulate(fitting)


def places_of(at: int, n: int) -> list[int]:
    """Which of n lengths make the sum at this place of group_sums()."""
    if at < n:
        return [at]
    i, j = _pairs(n) if n <= 256 else np.triu_indices(n, 1)
    return [int(i[at - n]), int(j[at - n])]


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Improve `bins` by moves of one or two pieces and exchanges of one or two for one, between bins that are not full.

    The emptiest bin gives: of all moves and exchanges that make some other bin fuller, the one with the least room left
    there, less what it takes from the giver, is made, until nothing helps; then the next bin gives. Every step raises the sum of squared fills. Rounds
    over all bins end when none improves, or when less than a bin's worth of room is left, as then no bin can run empty.
    """
    bins = bins.copy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64) if len(bins) else np.zeros(0, dtype=np.int64)
    settled = lambda: (o := (fill > 0) & (fill < capacity)).sum() < 2 or capacity * o.sum() - fill[o].sum() < capacity
    improved = True
    while improved and not settled():
        improved, given = False, set()
        while not settled():
            is_open = (fill > 0) & (fill < capacity)
            open_bins = np.flatnonzero(is_open)
            left = [k for k in open_bins[np.argsort(fill[open_bins], kind="stable")].tolist() if k not in given]
            if not left:
                break
            donor = left[0]
            given.add(donor)
            # pieces of open bins, their lengths and bins; who has no room takes nothing, so the giver counts as full
            items = np.flatnonzero(is_open[bins])
            size, of = lengths[items].astype(np.int64), bins[items]
            room = np.where(is_open, capacity - fill, 0).astype(np.int64)
            room[donor] = 0
            while fill[donor]:
                own = np.flatnonzero(of == donor)
                sums, fitting = group_sums(size[own], capacity)
                # what is taken in return: nothing, or one piece
                needed, there, best = capacity - fill[donor], room.take(of), (capacity + 1, None, 0, 0)
                for back, free in ((0, room), (size, there)):
                    gain = fitting.take(free + back) - back
                    worth = np.where((gain > 0) & (free - gain < needed), free - 2 * gain, capacity + 1)
                    at = int(np.argmin(worth))
                    if worth[at] < best[0]:
                        best = int(worth[at]), back is size, at, int(gain[at])
                _, exchanged, at, gain = best
                if not gain:
                    break
                to = int(of[at]) if exchanged else at
                given_sum = gain + (int(size[at]) if exchanged else 0)
                for k in places_of(int(np.argmax(sums == given_sum)), len(own)):
                    of[own[k]] = to
                if exchanged:
                    of[at] = donor
                fill[to] += gain
                fill[donor] -= gain
                room[to] -= gain
                improved = True
            bins[items] = of
    return bins


def offsets(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The place of each piece in its bin."""
    order = np.lexsort((np.arange(len(bins)), bins))
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.r_[True, np.diff(bins[order]) != 0] if len(order) else np.zeros(0, dtype=bool)
    out = np.empty(len(bins), dtype=np.int64)
    out[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    return out


def tokenised(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """A written table: doc_id, piece, start, length, ids_crc32 and a number for each row."""
    bounded_batches(docs.sparkSession)
    path = path or default_tokenizer()

    def cut_all(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = WordEncoder(path)  # for this task only: what it remembers must not stay in the worker
        for x in texts:
            yield pd.DataFrame({"pieces": [cut(t, encode, length) for t in x]})

    pieces = docs.select("doc_id", F.pandas_udf(cut_all, PIECES)("text").alias("x"))
    return written(pieces.select("doc_id", F.explode("x.pieces").alias("p")).select("doc_id", "p.*", F.monotonically_increasing_id().alias("row")), "pieces")


def pack_pieces(pieces: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """The columns of pieces (with length, and a row of its own for each) but row, and sequence_id and offset; pieces shorter than a sequence."""
    kept = [f.name for f in pieces.schema.fields if f.name != "row"]
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in pieces.schema.fields) + "sequence_id long, offset long, is_full boolean"

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        lengths = group["length"].to_numpy()
        before = group["sequence_id"].to_numpy()
        start = next_fit(lengths, length) if (before < 0).any() else pd.factorize(before)[0]
        bins = local_search(lengths, start, length)
        fill = np.bincount(bins, weights=lengths)
        numbers = 2 * (((group["turn"].to_numpy() << 28) + group["shard"].to_numpy() << 28) + bins)
        return group.assign(sequence_id=numbers, offset=offsets(lengths, bins), is_full=fill[bins] == length).drop(columns=["shard", "turn"])

    left, done = pieces.withColumn("sequence_id", F.lit(-1).cast("long")), []
    n, bins = left.count(), float("inf")
    for turn in range(64):
        shards = max(1, -(-n // min(max(shard, SHARD), shard << turn)))  # smaller shards than usual grow from turn to turn
        of = F.xxhash64("row" if not turn else "sequence_id")
        dealt = left.withColumns({"shard": F.pmod(of, F.lit(shards)), "turn": F.lit(turn).cast("long")})
        out = written(dealt.groupBy("shard").applyInPandas(place, schema), "packed")
        some = out.where("not is_full")
        after, still = some.agg(F.count("*"), F.countDistinct("sequence_id")).first() if shards > 1 else (0, 0)
        # the bins that shards leave open meet others, as long as pieces come to rest or bins run empty
        if shards == 1 or after > (1 - GAIN) * n and still > (1 - GAIN) * bins:
            done.append(out)
            break
        done.append(out.where("is_full"))
        left, n, bins = some.drop("offset", "is_full"), after, still
    return reduce(DataFrame.unionByName, done).select(*kept, "sequence_id", "offset")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    pieces = tokenised(docs, path, length)
    packed = pack_pieces(pieces.where(F.col("length") < length), length, shard)
    full = pieces.where(F.col("length") == length).select("doc_id", "piece", "start", "length", "ids_crc32", (2 * F.col("row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
