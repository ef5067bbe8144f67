"""Files of token ids in Simple-8b coding.

A 64-bit word holds a selector in its upper 4 bits and, in the other 60, as many ids of equal width as the selector says
(PACKS). A number of more than 60 bits is escaped: a word with selector 0, then the number itself as a word. Each word
takes as many of the next numbers as it can; the last word of a block is filled with zeros.

A file, all numbers little-endian: MAGIC; the words of its blocks (of BLOCK ids each, the last one shorter); for each block
the number of words before it, and their total; for each document doc_id (signed), its number of ids, and a byte that is
1 if doc_id is null; last the numbers of blocks, documents, ids and ids of a block, and MAGIC again. So any block is
found, and decoded at once for each selector, without reading those before it.

Documents stand in ascending order of doc_id, nulls first, equal doc_ids by a hash of their text. Texts are dealt by
ranges of this order, and a task tokenises and writes its range as one file, block by block. The names of files hold a
random part, and only the files that the finished tasks report are ever read, so a task that is run again does no harm.

Defined cases: a null or empty text is the end id alone; repeated rows are documents each; doc_id is of an integer type;
an empty table has no files; a document may span any number of blocks; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, written
from ledgerloom.llm.tokens import END_ID, WordEncoder, default_tokenizer
from ledgerloom.shared import shared_folder

# Numbers in a word and bits of each, for the selectors from 1.
PACKS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]

MAGIC, BLOCK = b"ids-s8b1", 65_536
FOOTER = struct.Struct("<QQQQ8s")
#: Bytes of text for a file. Smaller inputs get smaller files, of at least LEAST_BYTES, so that every core has work.
FILE_BYTES, LEAST_BYTES = 256 * 2**20, 8 * 2**20


def takes(numbers: np.ndarray) -> np.ndarray:
    """For each place, how many numbers from there on fit into one word; 0 where the number needs an escape. Places after the end fit anywhere."""
    limits = np.array([(1 << bits) - 1 for _, bits in PACKS], dtype=np.uint64)
    widths = np.searchsorted(limits, numbers).astype(np.uint8)  # the first selector, less 1, whose width holds the number
    n, out = len(numbers), np.zeros(len(numbers), dtype=np.uint8)
    widest, span = np.r_[widths, np.zeros(PACKS[0][0], dtype=np.uint8)], 1
    for k in range(len(PACKS) - 1, -1, -1):
        count = PACKS[k][0]
        # widest[i] is the greatest width of `span` numbers from i; counts at most double, so two such spans cover `count`
        if count > span:
            widest = np.maximum(widest[: len(widest) - (count - span)], widest[count - span :])
            span = count
        out[widest[:n] <= k] = count
    return out


def encode(numbers: np.ndarray) -> np.ndarray:
    """Numbers (uint64) as words (uint64)."""
    numbers = np.ascontiguousarray(numbers, dtype=np.uint64)
    counts = takes(numbers)
    steps, starts, at = np.maximum(counts, 1).tolist(), [], 0
    while at < len(steps):
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, dtype=np.int64)
    counts = counts[starts]
    ends = np.cumsum(np.where(counts == 0, 2, 1))
    words, padded = np.zeros(ends[-1] if len(ends) else 0, dtype=np.uint64), np.r_[numbers, np.zeros(PACKS[0][0], dtype=np.uint64)]
    for k, (count, bits) in enumerate(PACKS):
        here = np.flatnonzero(counts == count)
        if len(here):
            parts = padded[starts[here, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            words[ends[here] - 1] = np.bitwise_or.reduce(parts, axis=1) | np.uint64((k + 1) << 60)
    escaped = counts == 0
    words[ends[escaped] - 1] = numbers[starts[escaped]]
    return words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n numbers of a block's words."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    # an escaped number has one of the upper 4 bits set, so it never looks like an escape itself
    raw = np.flatnonzero(selectors == 0) + 1
    if len(raw) and raw[-1] >= len(words):
        raise ValueError("an escaped number is missing")
    counts = np.array([0, *(c for c, _ in PACKS), 0], dtype=np.int64)[selectors]
    counts[raw], selectors[raw] = 1, -1
    if (selectors > len(PACKS)).any() or counts.sum() < n:
        raise ValueError("not words of this coding")
    starts, out = np.cumsum(counts) - counts, np.zeros(counts.sum(), dtype=np.uint64)
    for k, (count, bits) in enumerate(PACKS):
        here = np.flatnonzero(selectors == k + 1)
        if len(here):
            parts = words[here, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            out[starts[here, None] + np.arange(count)] = parts & np.uint64((1 << bits) - 1)
    out[starts[raw]] = words[raw]
    return out[:n]


class Writer:
    """Writes one file to a binary stream."""

    def __init__(self, stream, block: int = BLOCK):
        self.stream, self.block, self.held, self.waiting, self.n = stream, block, [], 0, 0
        self.before, self.doc_ids, self.sizes, self.nulls = array("Q", [0]), array("q"), array("Q"), bytearray()
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document with these ids, unsigned 32-bit numbers."""
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.sizes.append(len(ids) // 4)
        self.held.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= self.block:
            self.flush()

    def flush(self, all_of_it: bool = False) -> None:
        ids = np.frombuffer(b"".join(self.held), dtype="<u4")
        end = len(ids) if all_of_it else len(ids) - len(ids) % self.block
        for at in range(0, end, self.block):
            words = encode(ids[at : min(at + self.block, end)])
            self.stream.write(words.astype("<u8").tobytes())
            self.before.append(self.before[-1] + len(words))
        self.held, self.waiting, self.n = [ids[end:].tobytes()], len(ids) - end, self.n + end

    def close(self) -> None:
        self.flush(True)
        for numbers, kind in ((self.before, "<u8"), (self.doc_ids, "<i8"), (self.sizes, "<u8")):
            self.stream.write(np.array(numbers, dtype=kind).tobytes())
        self.stream.write(bytes(self.nulls) + FOOTER.pack(len(self.before) - 1, len(self.sizes), self.n, self.block, MAGIC))
        self.stream.close()


class Reader:
    """Reads one file that can be read anywhere (seek and read): its documents at once, its blocks one by one."""

    def __init__(self, file, size: int):
        self.file = file
        blocks, docs, self.n, self.block, magic = FOOTER.unpack(self.part(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or self.part(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of token ids")
        tables = self.part(size - FOOTER.size - 17 * docs - 8 * (blocks + 1), 17 * docs + 8 * (blocks + 1))
        self.before = np.frombuffer(tables, dtype="<u8", count=blocks + 1).astype(np.int64)
        self.doc_ids = np.frombuffer(tables, dtype="<i8", count=docs, offset=8 * (blocks + 1))
        self.sizes = np.frombuffer(tables, dtype="<u8", count=docs, offset=8 * (blocks + 1 + docs)).astype(np.int64)
        self.nulls = np.frombuffer(tables, dtype=bool, count=docs, offset=8 * (blocks + 1 + 2 * docs))
        self.last: tuple[int, np.ndarray] | None = None

    def part(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, block: int) -> np.ndarray:
        """The ids of a block; the last one that was read stays."""
        if self.last and self.last[0] == block:
            return self.last[1]
        lo, hi = self.before[block : block + 2].tolist()
        words = np.frombuffer(self.part(len(MAGIC) + 8 * lo, 8 * (hi - lo)), dtype="<u8")
        self.last = block, decode(words.astype(np.uint64), min(self.block, self.n - block * self.block))
        return self.last[1]

    def between(self, start: int, end: int) -> np.ndarray:
        """The ids from `start` to before `end`, of the blocks that hold them."""
        first, last = start // self.block, -(-end // self.block)
        found = [self.ids(b) for b in range(first, last)]
        return np.concatenate(found)[start - first * self.block : end - first * self.block] if found else np.zeros(0, dtype=np.uint64)

    def checksums(self) -> np.ndarray:
        """For each document the crc32 of its ids as unsigned 32-bit numbers."""
        out, crc, doc, left = np.zeros(len(self.sizes), dtype=np.int64), 0, 0, 0
        for block in range(len(self.before) - 1):
            raw, at = memoryview(self.ids(block).astype("<u4").tobytes()), 0
            while at < len(raw):
                left = left or 4 * int(self.sizes[doc])
                take = min(left, len(raw) - at)
                crc, at, left = zlib.crc32(raw[at : at + take], crc), at + take, left - take
                if not left:
                    out[doc], crc, doc = crc, 0, doc + 1
        return out


def write_files(docs: DataFrame, folder: str | None = None, path: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of all documents; one row a file: file (ascending), path, n_docs, n_ids and start, the ids of the files before it.

    folder: where to, a URI or path that all executors see; by default a new one in the shared folder. path: the tokenizer's file.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder, path = folder or f"{shared_folder(spark)}/token_ids/{uuid.uuid4().hex}", path or default_tokenizer()
    # the last column parts rows that are equal, of which there may be many
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-size // file_bytes), min(2 * spark.sparkContext.defaultParallelism, size // LEAST_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    end = np.array([END_ID], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, encode_text, writer = TaskContext.get().partitionId(), WordEncoder(path), None
        system, place = fs.FileSystem.from_uri(folder)
        name = f"part-{number:08d}-{uuid.uuid4().hex}.ids"
        try:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    if writer is None:
                        system.create_dir(place)
                        writer = Writer(system.open_output_stream(f"{place}/{name}"))
                    writer.add(doc_id, encode_text(text) + end)
            if writer is not None:
                writer.close()
        except BaseException:
            if writer is not None:
                writer.stream.close()
                system.delete_file(f"{place}/{name}")
            raise
        if writer is not None:
            row = {"file": number, "path": f"{folder}/{name}", "n_docs": len(writer.sizes), "n_ids": writer.n}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ranged = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    # a row of a few bytes for each file; the driver adds up their ids
    found = sorted(written(ranged.mapInArrow(write, "file long, path string, n_docs long, n_ids long"), "token_files").collect())
    starts = np.cumsum([0, *(r.n_ids for r in found)]).tolist()
    return spark.createDataFrame([(*r, s) for r, s in zip(found, starts)], "file long, path string, n_docs long, n_ids long, start long")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32: what the files of write_files() hold."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, place = fs.FileSystem.from_uri(row["path"])
                with system.open_input_file(place) as file:
                    r = Reader(file, file.size())
                    columns = [pa.array(r.doc_ids, mask=r.nulls), pa.array(row["start"] + np.cumsum(r.sizes) - r.sizes), pa.array(r.sizes), pa.array(r.checksums())]
                out = pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield from (out.slice(at, 100_000) for at in range(0, len(out), 100_000))

    few = files.repartitionByRange(max(1, files.count()), "file")
    return few.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, ids: the documents of the files with their ids, each read from the blocks that hold it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, place = fs.FileSystem.from_uri(row["path"])
                with system.open_input_file(place) as file:
                    r, at = Reader(file, file.size()), 0
                    for doc_id, null, size in zip(r.doc_ids.tolist(), r.nulls.tolist(), r.sizes.tolist()):
                        ids = r.between(at, at + size).astype(np.int64)
                        arrays = [pa.array([None if null else doc_id], pa.int64()), pa.array([row["start"] + at]), pa.array([ids], pa.list_(pa.int64()))]
                        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "ids"])
                        at += size

    few = files.repartitionByRange(max(1, files.count()), "file")
    return few.mapInArrow(read, "doc_id long, start long, ids array<long>")
