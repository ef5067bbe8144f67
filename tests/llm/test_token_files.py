"""Simple-8b files against the tokenizers library, a greedy coder in plain Python, and round trips."""

import io
import zlib

import numpy as np
import pytest

from ledgerloom.llm import queries as llm_queries
from ledgerloom.llm import token_files as tf
from ledgerloom.llm.common import table
from ledgerloom.llm.tokens import default_tokenizer

SF = "/root/testdata/sf0.001"


def greedy(numbers):
    out, at = [], 0
    while at < len(numbers):
        for k, (count, bits) in enumerate(tf.PACKS):
            part = numbers[at : at + count]
            if all(x < 1 << bits for x in part):
                out.append(sum(x << bits * j for j, x in enumerate(part)) | (k + 1) << 60)
                at += count
                break
        else:
            out += [0, numbers[at]]
            at += 1
    return out


def test_words_are_greedy_and_come_back():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 59, 60, 61, 500):
        for top in (1, 2, 300, 50_000, 2**32, 2**60, 2**64 - 1):
            x = rng.integers(0, top, n, dtype=np.uint64)
            x[rng.random(n) < 0.1] = rng.integers(0, 2**64 - 1, dtype=np.uint64)
            words = tf.encode(x)
            assert words.tolist() == greedy(x.tolist()) and tf.decode(words, n).tolist() == x.tolist()
    edges = np.array([2**60, 2**60 - 1, 2**64 - 1, 0, 15 << 60, 1 << 60], dtype=np.uint64)
    assert tf.decode(tf.encode(edges), 6).tolist() == edges.tolist()


def test_broken_words_are_refused():
    for words, n in (([15 << 60], 1), ([0], 1), ([14 << 60], 2)):
        with pytest.raises(ValueError):
            tf.decode(np.array(words, dtype=np.uint64), n)


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_file_comes_back(block):
    rng, out = np.random.default_rng(1), io.BytesIO()
    docs = [(d, rng.integers(0, 2**32, int(n), dtype=np.uint64)) for d, n in zip([None, None, -5, 0, 2**62, 2**62], [3, 1, 200, 1, 64, 7])]
    close, out.close = out.close, lambda: None
    w = tf.Writer(out, block)
    for d, ids in docs:
        w.add(d, ids.astype("<u4").tobytes())
    w.close()
    r = tf.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert [None if null else d for d, null in zip(r.doc_ids.tolist(), r.nulls)] == [d for d, _ in docs]
    every = np.concatenate([ids for _, ids in docs])
    assert r.sizes.tolist() == [len(ids) for _, ids in docs] and r.n == len(every)
    assert r.checksums().tolist() == [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in docs]
    for lo, hi in ((0, len(every)), (3, 3), (5, 6), (100, 271)):
        assert r.between(lo, hi).tolist() == every[lo:hi].tolist()
    close()
    with pytest.raises(ValueError):
        tf.Reader(io.BytesIO(b"x" * 100), 100)


def expected(rows):
    """By the library itself, in order of doc_id."""
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(default_tokenizer()), 0, []
    for doc_id, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(docs, texts, tmp_path):
    files = tf.write_files(docs.repartition(5), folder=f"file://{tmp_path}/ids", file_bytes=40_000)
    assert files.count() > 3
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tf.read_files(files).collect())
    # equal ids may stand in any order: take the texts as they were written, then hold every row against the library
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0))
    assert [g[1] for g in got] == [i for i, _ in order]
    known = {(i, n, crc) for i, _, n, crc in expected(order)}
    assert {(i, n, crc) for _, i, n, crc in got} == known
    assert [g[0] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    ids = {(r.start, r.doc_id, len(r.ids), zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())) for r in tf.read_ids(files).collect()}
    assert ids == set(got)


def test_token_files_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").orderBy("doc_id").collect()]
    got = llm_queries.op12_token_files(spark, SF)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == expected(rows)


def test_no_documents(empty):
    files = tf.write_files(empty)
    assert files.count() == 0 and tf.read_files(files).count() == 0 and tf.read_ids(files).count() == 0


def test_equal_rows_are_many_files(spark):
    """Rows that are all equal are dealt over files too."""
    df = spark.createDataFrame([(7, "some words here " * 20)] * 600, "doc_id long, text string").repartition(4)
    files = tf.write_files(df, file_bytes=20_000)
    assert files.count() > 4 and files.agg({"n_docs": "max"}).first()[0] < 300
    rows = tf.read_files(files).collect()
    assert len(rows) == 600 and len({r.ids_crc32 for r in rows}) == 1 and sorted(r.start for r in rows) == [rows[0].n_tokens * n for n in range(600)]
