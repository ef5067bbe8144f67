"""Importance resampling against brute force in plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from ledgerloom.llm import queries as llm_queries
from ledgerloom.llm import resampling
from ledgerloom.llm.common import table

SF = "/root/testdata/sf0.001"


def runs(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, percent=5):
    every, wanted = Counter(), Counter()
    for _, text in docs:
        every.update(runs(text)[0])
    for text in target:
        wanted.update(runs(text)[0])
    S, T, rows = sum(every.values()), sum(wanted.values()), []
    for doc_id, text in docs:
        found, n_words = runs(text)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (S + 10_000) / ((every[b] + 1) * (T + 10_000)))) for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    large = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = large[: len(large) * percent // 100]
    rest = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return Counter((*r[:4], k) for k, r in enumerate(drawn, 1)) + Counter({(*r, None): n for r, n in rest.items()})


def got(df):
    assert df.columns[:5] == ["doc_id", "n_features", "weight", "score", "rank"]
    return Counter(tuple(r)[:5] for r in df.collect())


def test_resampling(spark, docs, texts):
    target = [texts[0][1], texts[5][1][:300], "", None, "Äpfel, ÄPFEL and 3.5 apples"]
    table_of = spark.createDataFrame([(t, 1) for t in target], "text string, score int")
    for percent in (5, 40, 100, 0):
        assert got(resampling.resample(docs, table_of, percent)) == brute(texts, target, percent), percent
    kept = resampling.draw(docs, table_of, 40)
    assert kept.columns == docs.columns and kept.count() > 10


def test_resampling_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    target = [r.text for r in table(spark, SF, "benchmark").collect()]
    assert got(llm_queries.op11_target_resampling(spark, SF)) == brute(rows, target)


def test_stretches_do_not_matter():
    rng = random.Random(0)
    text = " ".join(rng.choice(["a", "Bb", "ccc", "-", "é1", "x" * 50]) for _ in range(3000))
    whole = Counter(np.concatenate(list(resampling.features(text))).tolist())
    assert whole == Counter(runs(text)[0])
    for stretch in (1, 7, 60, 1000):
        assert Counter(np.concatenate(list(resampling.features(text, stretch=stretch))).tolist()) == whole
    assert resampling.FOLD == bytes(32 if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def test_nothing_to_resample(spark, docs, empty):
    assert resampling.resample(empty, docs).count() == 0
    out = resampling.resample(docs, empty)
    assert out.count() == docs.count() and out.where("rank is not null").count() == int(0.05 * out.where("n_features >= 57").count())
