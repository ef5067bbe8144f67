"""Quality by compression: zstandard dictionaries made from good and from bad labelled text.

Every whole text is cut into blocks (each block is compressed on its own, so a dictionary helps the end of a long text
as much as its start) and compressed once with each dictionary. The normalised difference of the summed sizes,
(bad - good) / (bad + good), is positive where the good dictionary fits better. A logistic curve fitted on other
labelled texts turns it into the probability of label 1. Labels, languages, sources and ids are no inputs of a score.

Defined cases: a null or empty text has the difference 0 and its curve value; without texts of both labels every score
is the share of label 1 (0.5 without labels); repeated labels of an id vote; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, held_out, labelled_sample

BLOCK = 256
#: Bounds of the labelled sample: at most so many labelled texts, and so many of their blocks for each dictionary.
MAX_LABELLED, MAX_BLOCKS, DICTIONARY_BYTES = 8_000, 8_000, 112_640
LEVEL, THRESHOLD = 1, 0.3


def blocks(text: str | None, size: int = BLOCK) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + size] for i in range(0, len(raw), size)]


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0

    def difference(self):
        """A function from a text to the normalised difference; made once per task."""
        if not self.good or not self.bad:
            return lambda text: 0.0
        sizers = [zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d), write_content_size=False, write_dict_id=False) for d in (self.good, self.bad)]
        for z, d in zip(sizers, (self.good, self.bad)):
            z.compress(d[:64])

        def difference(text: str | None) -> float:
            good = bad = 0
            for block in blocks(text):
                good += len(sizers[0].compress(block))
                bad += len(sizers[1].compress(block))
            return (bad - good) / (bad + good) if bad + good else 0.0

        return difference

    def score(self, difference: pd.Series) -> pd.Series:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * difference + self.offset, -50, 50)))


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return d


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; the joined samples where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, with a little ridge; a step is halved until the loss falls enough, so it converges however far the classes are apart."""
    if not len(x):
        return 0.0, 0.0
    scale = float(np.std(x)) or 1.0
    a, w = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    loss = lambda w: float((np.logaddexp(0, a @ w) - y * (a @ w)).sum() + ridge / 2 * w @ w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        rise = a.T @ (y - p) - ridge * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), rise)
        share, before, gain = 1.0, loss(w), float(rise @ step)
        while loss(w + share * step) > before - 1e-4 * share * gain and share > 1e-9:
            share /= 2
        w = w + share * step
        if np.abs(share * step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from at most max_labelled labelled texts whose crc32(doc_id) mod 5 is not 0: half make dictionaries, half fit the curve."""
    sample = labelled_sample(labels, max_labelled, training_only=True)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("order", F.xxhash64("doc_id", "text"))
    for_curve = F.pmod("order", F.lit(2)) == 1

    def cut(x: pd.Series) -> pd.Series:
        return x.map(blocks)

    cut = F.pandas_udf(cut, "array<binary>")

    pieces = texts.where(~for_curve).select("label", F.explode(cut("text")).alias("block")).where(F.length("block") >= 16)
    chosen = [[bytes(r.block) for r in pieces.where(F.col("label") == k).orderBy(F.xxhash64("block"), "block").limit(MAX_BLOCKS).select("block").collect()] for k in (1, 0)]
    model = Model(*(train_dictionary(x) if x else b"" for x in chosen))
    rows = with_difference(texts.where(for_curve).select("doc_id", "label", "text"), model).select("doc_id", "label", "difference").toPandas()
    rows = rows.sort_values(["doc_id", "difference"])
    return Model(model.good, model.bad, *fit_curve(rows["difference"].to_numpy(dtype=float), rows["label"].to_numpy(dtype=float)))


def with_difference(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the text, with the normalised size difference."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad))  # two dictionaries of DICTIONARY_BYTES at most

    def difference(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Model(*shared.value).difference()
        for x in batches:
            yield x.map(of).astype(float)

    return docs.withColumn("difference", F.pandas_udf(difference, "double")("text"))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    curve = 1 / (1 + F.exp(-F.least(F.greatest(F.lit(model.slope) * F.col("difference") + F.lit(model.offset), F.lit(-50.0)), F.lit(50.0))))
    scored = with_difference(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), curve.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
