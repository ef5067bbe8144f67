"""Codes of vectors by product quantisation with whole numbers, entries found by annular norm pruning.

A component x counts as floor(SCALE * x). A vector is cut into PARTS consecutive parts of equal length, each position has
a codebook of up to ENTRIES entries, and a part's code is its nearest entry (squared Euclidean distance, ties to the lower
index). Codebooks start as the parts of the smallest vec_ids; ROUNDS times all parts are assigned and every used entry
becomes the floor of its parts' mean. A pass over the vectors sends no more than the entries' sums of each partition.

The nearest entry: entries are sorted by norm. Norms differ by no more than the distance, so once some distance is known,
a binary search gives the interval of norms in which an entry can be as near, both ends included, and only that annulus
is compared, exactly. Parts go in blocks of similar norm; the entries nearest to a block in norm come first.

Defined cases: a row whose vector is null, or holds null or non-finite components, is left out; so a null vec_id stays (and comes
last where codebooks start), as do repeated vec_ids (the smaller vector first). All codes have one length: the commonest
that PARTS divides (of equally common ones the greatest). Rows of another length, or with components of LIMIT / SCALE and
more, stay with null code and error, and the codebooks do not see them. Fewer vectors than ENTRIES give as many entries;
no vectors an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, written
from ledgerloom.llm.links import join_counted

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Scaled components have to be smaller, so that all distances are exact.
LIMIT = 2**24
#: Parts that are searched at once, and how many entries on either side of their norms come first.
BLOCK, FIRST = 256, 8


class Entries:
    """A codebook position, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(axis=1)
        self.number = np.argsort(squares, kind="stable")
        self.norms = np.sqrt(squares[self.number])
        self.squares, self.entries = squares[self.number], entries[self.number]
        self.compared = 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each part (a row of whole numbers) the index of its entry and their squared distance."""
        if max(np.abs(parts).max(initial=0), np.abs(self.entries).max(initial=0)) ** 2 * 4 * parts.shape[1] < 2**53:
            # whole numbers below 2^53 are exact as doubles, whose matrix product is faster
            kind = np.float64
        else:
            kind = np.int64
        squares = (parts * parts).sum(axis=1)
        norms = np.sqrt(squares)
        order = np.argsort(norms, kind="stable")
        index, best = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
        entries = self.entries.astype(kind)
        for at in range(0, len(parts), BLOCK):
            rows = order[at : at + BLOCK]
            index[rows], best[rows] = self._block(parts[rows].astype(kind), squares[rows], norms[rows], entries)
        return index, best

    def _block(self, x: np.ndarray, squares: np.ndarray, norms: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index, best = np.full(len(x), len(entries)), np.full(len(x), np.iinfo(np.int64).max)

        def compare(rows: np.ndarray, lo: int, hi: int) -> None:
            if not len(rows) or lo >= hi:
                return
            self.compared += len(rows) * (hi - lo)
            d = squares[rows, None] + self.squares[None, lo:hi] - 2 * (x[rows] @ entries[lo:hi].T).astype(np.int64)
            least = d.min(axis=1)
            number = np.where(d == least[:, None], self.number[None, lo:hi], len(entries)).min(axis=1)
            better = (least < best[rows]) | ((least == best[rows]) & (number < index[rows]))
            best[rows], index[rows] = np.where(better, least, best[rows]), np.where(better, number, index[rows])

        every = np.arange(len(x))
        lo = max(0, int(np.searchsorted(self.norms, norms[0])) - FIRST)
        hi = min(len(entries), int(np.searchsorted(self.norms, norms[-1], side="right")) + FIRST)
        compare(every, lo, hi)
        # the best distance so far, and a little more for the rounding of norms
        reach = np.sqrt(best) * (1 + 1e-9) + 1e-3
        first = np.searchsorted(self.norms, norms - reach, side="left")
        end = np.searchsorted(self.norms, norms + reach, side="right")
        below, above = np.flatnonzero(first < lo), np.flatnonzero(end > hi)
        compare(below, int(first[below].min(initial=lo)), lo)
        compare(above, hi, int(end[above].max(initial=hi)))
        return index, best


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))


def whole(column: pa.ListArray, length: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """The places of the rows that can be coded, and their scaled components."""
    sizes = np.diff(column.offsets.to_numpy())
    at = np.flatnonzero(sizes == length)
    values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), length)
    scaled = np.floor(scale * values)
    good = (np.abs(scaled) < LIMIT).all(axis=1)
    return at[good], scaled[good].astype(np.int64)


class Codebooks:
    """Learns codebooks from all vectors of a table (vec_id, embedding) and codes them."""

    def __init__(self, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
        self.parts, self.most, self.rounds, self.scale, self.length = parts, entries, rounds, scale, 0
        self.books: list[np.ndarray] = []

    def usable(self) -> Column:
        """Can the column v be coded?"""
        scaled = lambda c: c.cast("double") * self.scale
        return (F.size("v") == self.length) & ~F.exists("v", lambda c: (scaled(c) < 1 - LIMIT) | (scaled(c) >= LIMIT))

    def fit(self, vectors: DataFrame) -> "Codebooks":
        """vectors: vec_id and v, without null or non-finite components."""
        lengths = vectors.groupBy(F.size("v").alias("n")).count().where((F.col("n") > 0) & (F.col("n") % self.parts == 0))
        commonest = lengths.orderBy(F.desc("count"), F.desc("n")).first()
        if commonest is None:
            return self
        self.length = commonest["n"]
        smallest = vectors.where(self.usable()).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(self.most).select("v").collect()
        start = np.floor(self.scale * np.array([r.v for r in smallest], dtype=np.float64).reshape(-1, self.length)).astype(np.int64)
        self.books = list(np.split(start, self.parts, axis=1))
        for _ in range(self.rounds if len(start) else 0):
            width = self.length // self.parts
            sums = self._assigned(vectors).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)))
            for r in sums.collect():  # a row for each entry that is used
                self.books[r.part][r.entry] = [int(r[2 + k + 1]) // r.n for k in range(width)]
        return self

    def _assigned(self, vectors: DataFrame) -> DataFrame:
        """part, entry, n, sums: for each partition how many parts an entry got, and their sum by component."""
        books, length, scale = vectors.sparkSession.sparkContext.broadcast(self.books), self.length, self.scale

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [Entries(b) for b in books.value]
            counts, sums = np.zeros((len(found), len(books.value[0])), dtype=np.int64), np.zeros((len(found), *books.value[0].shape), dtype=np.int64)
            for batch in batches:
                _, x = whole(batch.column(0), length, scale)
                for p, part in enumerate(np.split(x, len(found), axis=1)):
                    index, _ = found[p].nearest(part)
                    counts[p] += np.bincount(index, minlength=len(counts[p]))
                    np.add.at(sums[p], index, part)
            p, e = np.nonzero(counts)
            arrays = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "n", "sums"])

        return vectors.select("v").mapInArrow(assign, "part int, entry int, n long, sums array<long>")

    def code(self, vectors: DataFrame) -> DataFrame:
        """The columns of vectors but v, and code (two hexadecimal digits a part) and error; both null for a row that cannot be coded."""
        books, length, scale = vectors.sparkSession.sparkContext.broadcast(self.books), self.length, self.scale
        others = [c for c in vectors.columns if c != "v"]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [Entries(b) for b in books.value]
            for batch in batches:
                at, x = whole(batch.column(batch.schema.get_field_index("v")), length, scale) if found else (np.zeros(0, dtype=np.int64), None)
                codes, error = np.zeros((len(at), len(found)), dtype=np.uint8), np.zeros(len(at), dtype=np.int64)
                for p, part in enumerate(np.split(x, len(found), axis=1) if len(at) else []):
                    codes[:, p], d = found[p].nearest(part)
                    error += d
                texts, errors = np.full(len(batch), None, dtype=object), np.full(len(batch), None, dtype=object)
                texts[at], errors[at] = [c.tobytes().hex() for c in codes], error
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string()), pa.array(errors, pa.int64())], names=[*others, "code", "error"])

        kinds = "".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}, " for c in others)
        return vectors.mapInArrow(assign, f"{kinds}code string, error long")

    def digest(self) -> str:
        """sha256 of all components, by part, entry and position, as decimal numbers joined by commas."""
        return hashlib.sha256(",".join(str(c) for b in self.books for c in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (the errors of all rows with the same label), codebooks_sha256: one row per vector."""
    if ENTRIES > 256:
        raise ValueError("a code has two hexadecimal digits a part")
    bounded_batches(vectors.sparkSession)
    kept = vectors.where(finite(F.col("embedding"))).select("vec_id", "label", F.col("embedding").alias("v"))
    books = Codebooks().fit(kept.select("vec_id", "v"))
    # null labels are together: a label's text with a mark before it, or nothing
    of = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = written(books.code(kept.select("vec_id", of.alias("of"), "v")), "codes")
    sums = written(coded.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label_errors")
    out = join_counted(coded, sums.select("of", "label_error"), ["of"], sums.select("of", "n"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
