"""The binary index of near-duplicate vectors: balance, recall and candidates for vectors that lie in a cone; whole results against brute force."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from ledgerloom.llm import embeddings


def cone(rng, n, mean_cosine, d=64):
    """Vectors whose cosines have this mean."""
    x = rng.standard_normal((n, d))
    x[:, 0] = 0
    x *= math.sqrt(1 - mean_cosine) * np.clip(1 + 0.08 * rng.standard_normal((n, 1)), 0.3, 2) / np.linalg.norm(x, axis=1, keepdims=True)
    x[:, 0] = math.sqrt(mean_cosine)
    return x


def partners(rng, x, cosine):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.standard_normal(u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    return (cosine * u + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w, axis=1, keepdims=True)) * rng.uniform(0.5, 2, (len(x), 1))


@pytest.mark.parametrize("mean_cosine", [0, 0.6, 0.8])
@pytest.mark.parametrize("count", [10**4, 10**6])
def test_codes_find_planted_links(count, mean_cosine):
    rng = np.random.default_rng(1)
    index = embeddings.Index([cone(rng, 5000, mean_cosine)], count)
    x = cone(rng, 1000, mean_cosine)
    a, far_a = index.place(pd.Series(list(x)))
    b, far_b = index.place(pd.Series(list(partners(rng, x, 0.9801))))
    keys = lambda c: c.reshape(len(c), index.tables, index.bits)
    meet = (keys(a) == keys(b)).all(axis=2).any(axis=1)
    n = embeddings.CODE_BITS
    near = (a[:, :n] != b[:, :n]).sum(axis=1) <= embeddings.most_different(a[:, :n].shape[1], embeddings.differing(far_a, far_b))
    assert (meet & near).mean() >= 0.99
    unrelated = index.near(a[:, :n], far_a)
    np.fill_diagonal(unrelated, False)
    assert unrelated.mean() < 0.01
    assert abs(a.mean(axis=0) - 0.5).max() < 0.15  # every bit is balanced
    first = keys(a)[:, 0] @ (1 << np.arange(index.bits, dtype=np.int64))
    assert max(Counter(first.tolist()).values()) < 0.03 * len(x)


def brute(rows):
    """(vec_id, links, smallest reachable id) of usable rows (vec_id, vector, label)."""
    x = np.array([v for _, v, _ in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([k for _, _, k in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    least = np.array([i for i, _, _ in rows])
    while True:
        after = np.minimum(least, np.where(near, least[None, :], least.max()).min(axis=1))
        if (after == least).all():
            return Counter(zip((i for i, _, _ in rows), near.sum(axis=1).tolist(), least.tolist()))
        least = after


@pytest.mark.parametrize("mean_cosine", [0, 0.6, 0.8])
def test_whole_results_on_a_cone(spark, mean_cosine):
    """Planted pairs, chains, and a large group of near copies, off the centre; recall of links at least 0.99."""
    rng = np.random.default_rng(7)
    x = cone(rng, 1200, mean_cosine)
    chain = [x[0]]
    for _ in range(30):
        chain.append(partners(rng, chain[-1][None], 0.985)[0])
    group = x[1] + rng.standard_normal((300, 64)) * 0.01 * np.linalg.norm(x[1]) / 8
    every = np.concatenate([x, partners(rng, x[:400], 0.981), partners(rng, x[400:500], 0.979), np.array(chain), group, x[:20]]).astype(np.float32)
    rows = [(n, v.tolist(), n % 20 % 2 if n < 1200 else 0) for n, v in enumerate(every)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in embeddings.deduplicate(df).collect())
    expected = brute(rows)
    found, due = (sum(n * c for (_, n, _), c in k.items()) for k in (got, expected))
    assert due > 300 * 299 and found >= 0.99 * due
    assert sum((got & expected).values()) >= 0.99 * len(rows)
    assert all(g[1] <= e[1] for g, e in zip(sorted(got.elements()), sorted(expected.elements())))  # no link below the threshold


def test_vectors_around_the_mean(spark):
    """All vectors in one narrow cone, some at its very axis, where angles seen from the mean say nothing."""
    rng = np.random.default_rng(8)
    axis = np.eye(16)[0]
    tight = axis + rng.standard_normal((200, 16)) * 0.02
    wide = axis * 0.3 + rng.standard_normal((200, 16)) * 0.3
    rows = [(n, v.tolist(), 1) for n, v in enumerate(np.concatenate([tight, wide]).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in embeddings.deduplicate(df).collect()) == brute(rows)


def test_shape_of_the_tables():
    for count in (0, 1, 10**3, 10**9):
        for share in (0.0, 0.064, 0.2, 0.5, 1.0):
            bits, tables = embeddings.tables_for(count, share)
            assert 0 <= bits <= 62 and tables >= 1 and 1 - (1 - (1 - share) ** bits) ** tables >= 1 - embeddings.MISS - 1e-9
