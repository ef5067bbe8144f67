"""Product codes against brute force over all entries, in plain whole numbers."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import queries as llm_queries
from ledgerloom.llm import vector_codes as vc
from ledgerloom.llm.common import table

SF = "/root/testdata/sf0.001"


def nearest(part, book):
    d = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
    return min(range(len(d)), key=lambda k: (d[k], k)), min(d)


def brute(rows, length):
    """Rows (vec_id, vector, label), those that are left out already gone; expected result rows."""
    scaled = lambda v: [math.floor(1024 * float(x)) for x in v]
    usable = lambda v: len(v) == length and all(abs(x) < 2**24 for x in scaled(v))
    cut = lambda v: [tuple(scaled(v)[p * length // 4 : (p + 1) * length // 4]) for p in range(4)]
    good = [(i, v, k, cut(v)) for i, v, k in rows if usable(v)]
    start = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))[:256]
    books = [[r[3][p] for r in start] for p in range(4)]
    for _ in range(4):
        for p, book in enumerate(books):
            members = defaultdict(list)
            for r in good:
                members[nearest(r[3][p], book)[0]].append(r[3][p])
            for e, parts in members.items():
                book[e] = tuple(sum(c) // len(parts) for c in zip(*parts))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, errors = [], Counter()
    for i, v, k in rows:
        if usable(v):
            found = [nearest(x, b) for x, b in zip(cut(v), books)]
            out.append((i, "".join(f"{f[0]:02x}" for f in found), sum(f[1] for f in found), k))
            errors[k] += out[-1][2]
        else:
            out.append((i, None, None, k))
    return Counter((i, c, e, errors[k] if k in errors else None, digest) for i, c, e, k in out)


def got(df):
    assert df.columns[:5] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return Counter(tuple(r)[:5] for r in df.collect())


def test_codes(spark):
    rng = np.random.default_rng(3)
    base = np.round(rng.standard_normal((330, 8)) * 2, 1).astype(np.float32)  # coarse, so that distances tie
    rows = [(int(n), x.tolist(), int(n) % 3) for n, x in enumerate(np.r_[base, base[:40]])]
    rows += [(7, base[9].tolist(), None), (7, base[7].tolist(), None), (None, base[1].tolist(), 0), (-3, [0.0] * 8, 1), (-2, [-0.0] * 8, 1)]
    odd = [(900, [1.0] * 5, 1), (901, [], 9), (902, [1e6] * 8, 1), (908, [-3e38] * 8, 1), (909, [-16384.0] + [0.0] * 7, 4), (903, [1.0] * 4, None)]
    gone = [(904, None, 1), (905, [None] * 8, 1), (906, [float("nan")] * 8, 1), (907, [float("inf")] * 8, 0)]
    df = spark.createDataFrame([(i, v, k, "x", 5, 1) for i, v, k in rows + odd + gone], "vec_id long, embedding array<float>, label int, code string, error int, of int")
    assert got(vc.encode(df.repartition(4))) == brute(rows + odd, 8)


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vc.encode(spark.createDataFrame([], schema)).count() == 0
    rows = [(3, [1.0, 2.0, 3.0, 4.5], None), (1, [0.5, -2.0, 3.0, 4.5], None)]
    assert got(vc.encode(spark.createDataFrame(rows, schema))) == brute(rows, 4)
    assert got(vc.encode(spark.createDataFrame([(3, [1.0], None)], schema))) == Counter([(3, None, None, None, hashlib.sha256(b"").hexdigest())])


def test_codes_of_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, SF, "embeddings").collect()]
    scaled = np.floor(1024 * np.array([v for _, v, _ in rows], dtype=float)).astype(np.int64)
    books = np.split(scaled[np.argsort([i for i, _, _ in rows])[:256]], 4, axis=1)
    assign = lambda: [(((x[:, None, :] - b[None]) ** 2).sum(axis=2)) for x, b in zip(np.split(scaled, 4, axis=1), books)]
    for _ in range(4):
        for x, b, d in zip(np.split(scaled, 4, axis=1), books, assign()):
            index = d.argmin(axis=1)
            for e in set(index.tolist()):
                b[e] = x[index == e].sum(axis=0) // (index == e).sum()
    found, digest = assign(), hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    error = sum(d.min(axis=1) for d in found)
    code = np.stack([d.argmin(axis=1) for d in found], axis=1).astype(np.uint8)
    by_label = Counter()
    for (_, _, k), e in zip(rows, error.tolist()):
        by_label[k] += e
    expected = Counter((i, c.tobytes().hex(), e, by_label[k], digest) for (i, _, k), c, e in zip(rows, code, error.tolist()))
    assert got(llm_queries.op13_vector_codes(spark, SF)) == expected


@pytest.mark.parametrize("top", [3, 1000, 2**23])
def test_annuli_hold_the_nearest(top):
    """Ties, equal entries and wide ranges; where norms spread, few entries are compared."""
    rng = np.random.default_rng(top)
    book = rng.integers(-top, top, (256, 6))
    book[100:120] = book[:20]
    x = np.r_[rng.integers(-top, top, (700, 6)), book[:50]]
    entries = vc.Entries(book)
    index, best = entries.nearest(x)
    d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert best.tolist() == d.min(axis=1).tolist() and index.tolist() == d.argmin(axis=1).tolist()
    spread = vc.Entries(rng.integers(0, 5, (256, 6)) + np.arange(256)[:, None] * 100)
    spread.nearest(np.arange(0, 25600, 3)[:, None] + rng.integers(0, 5, (8534, 6)))
    assert spread.compared < 0.2 * 256 * 8534
