"""Mixing towards target weights with soft membership.

A classifier learned from a labelled table gives every document a posterior over domains: word presence is counted by
domain in hashed counters on one half of a bounded labelled sample, and a softmax regression over the mean and the
greatest log ratio of a document's words is fitted on the other half. A document of t words then adds t * p_k expected
tokens to domain k. Projected gradient descent finds document rates between 0 and MAX_RATE whose expected totals come
closest, in least squares, to the target weights times the token budget. The gradient of a document is its posterior
times a vector of K numbers, scaled by the K x K Gram matrix of the documents that are not at a bound; Spark sums both
over all documents in every round, and as every document starts at rate 1 its rate is a fold over the rounds' vectors:
no state is kept per document, and any task can compute it again.

Defined cases: a null or empty text has no tokens, counts nowhere, and gets the rate of its posterior; without labels of
two domains all posteriors are the label shares; equal rows have equal rates and are taken or left together; domains
without any expected tokens stay short of their target (least squares; what is missed is logged); other columns, whatever
their names, are kept by `resample`; a very long text is one row of its own size.
"""

from __future__ import annotations

import ctypes
import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, label_votes, per_text, written
from ledgerloom.llm.shingles import in_portions, word_hashes, word_hashes_of

#: Production targets: shares of expected tokens by domain, as the labelled table marks them.
TARGETS = {"clean": 0.96, "toxic": 0.02, "junk": 0.02}
#: At most so many labelled documents teach the classifier; word presence is counted in COUNTERS counters per domain.
MAX_LABELLED, COUNTERS, RARE = 20_000, 2**16, 10
MAX_RATE, ROUNDS, ENOUGH, RIDGE = 8.0, 40, 1e-4, 0.01
LOG = logging.getLogger(__name__)


def give_back() -> None:
    """Return memory that this worker has freed, in this task and in earlier ones, to the machine: workers wait for further tasks beside the JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain: the number of its name in TARGETS; junk is quality 0, toxic is toxic 1 of the others."""
    toxic = label_votes(labels, "toxic").withColumnRenamed("label", "toxic")
    both = label_votes(labels, "quality").join(toxic, "doc_id", "left")
    return both.select("doc_id", F.when(F.col("label") == 0, 2).when(F.col("toxic") == 1, 1).otherwise(0).alias("domain"))


def buckets(text: str | None) -> np.ndarray:
    return (word_hashes(text) & np.uint64(COUNTERS - 1)).astype(np.int64)


@dataclass(frozen=True)
class Classifier:
    ratios: np.ndarray  # K x COUNTERS log ratios of word presence
    weights: np.ndarray  # (2K + 1) x K of the softmax regression

    def features_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The number of words and the features of each text."""
        hashes, words = word_hashes_of(texts)
        k, some = len(self.ratios), words > 0
        out = np.zeros((len(texts), 2 * k + 1))
        out[:, -1] = 1
        if some.any():
            x = self.ratios[:, (hashes & np.uint64(COUNTERS - 1)).astype(np.int64)]
            begin = (np.cumsum(words) - words)[some]
            out[some, :k] = (np.add.reduceat(x, begin, axis=1) / words[some]).T
            out[some, k:-1] = np.maximum.reduceat(x, begin, axis=1).T
        return words, out

    def features(self, text: str | None) -> np.ndarray:
        return self.features_of([text])[1][0]

    def posteriors_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The number of words and the posterior of each text."""
        words, x = self.features_of(texts)
        z = (x[:, :, None] * self.weights).sum(axis=1)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return words, e / e.sum(axis=1, keepdims=True)

    def posterior(self, text: str | None) -> list[float]:
        return self.posteriors_of([text])[1][0].tolist()


def fit_softmax(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 100, ridge: float = 1e-2) -> np.ndarray:
    """Multinomial logistic regression by Newton's method; a step is halved until the loss falls enough, so it converges for domains without rows and for separable ones too."""
    d, w = x.shape[1], np.zeros((x.shape[1], k))
    onehot = np.eye(k)[y]

    def state(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        total = e.sum(axis=1, keepdims=True)
        return float((np.log(total[:, 0]) - (z * onehot).sum(axis=1)).sum() + ridge / 2 * (w * w).sum()), e / total

    loss, p = state(w)
    for _ in range(rounds):
        grad = x.T @ (p - onehot) + ridge * w
        blocks = np.einsum("ni,nj,na,nab->iajb", x, x, p, np.eye(k)[None] - p[:, None, :], optimize=True)
        step = np.linalg.solve(blocks.reshape(d * k, d * k) + ridge * np.eye(d * k), grad.ravel()).reshape(d, k)
        share, slope = 1.0, float((grad * step).sum())
        while (after := state(w - share * step))[0] > loss - 1e-4 * share * slope and share > 1e-9:
            share /= 2
        w, (loss, p) = w - share * step, after
        if np.abs(share * step).max() < 1e-7:
            break
    return w


def fit(docs: DataFrame, labelled: DataFrame, max_labelled: int = MAX_LABELLED, k: int = len(TARGETS)) -> Classifier:
    """Learn from docs (doc_id, text) and labelled (doc_id, domain); at most max_labelled labels are used."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).withColumn("curve", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 1)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def count(batches):
        seen, total = np.zeros((k, COUNTERS)), np.zeros(k)
        for pdf in batches:
            for text, domain in zip(pdf["text"], pdf["domain"]):
                seen[domain, np.unique(buckets(text))] += 1
                total[domain] += 1
        i, j = np.nonzero(seen)
        yield pd.DataFrame({"domain": np.r_[np.arange(k), i], "counter": np.r_[np.full(k, -1), j], "n": np.r_[total, seen[i, j]]})

    rows = texts.where(~F.col("curve")).select("text", "domain").mapInPandas(count, "domain int, counter int, n double").groupBy("domain", "counter").agg(F.sum("n").alias("n")).toPandas()
    seen, total = np.zeros((k, COUNTERS)), np.zeros(k)
    whole = rows["counter"] < 0
    total[rows["domain"][whole]] = rows["n"][whole]
    seen[rows["domain"][~whole], rows["counter"][~whole]] = rows["n"][~whole]
    rest, others = seen.sum(axis=0) - seen, total.sum() - total
    ratios = np.log((seen + 0.5) / (total + 1)[:, None]) - np.log((rest + 0.5) / (others + 1)[:, None])
    ratios *= seen.sum(axis=0) / (seen.sum(axis=0) + RARE)  # words seen a few times say little
    draft = Classifier(ratios, np.zeros((2 * k + 1, k)))
    shared = spark.sparkContext.broadcast(draft)  # K x COUNTERS numbers
    features = per_text(lambda t: (shared.value.features(t),), "x array<double>")
    found = texts.where("curve").select("doc_id", "domain", features("text").alias("f")).select("doc_id", "domain", "f.x").toPandas().sort_values("doc_id")
    if found["domain"].nunique() < 2:
        shares = (total + np.bincount(found["domain"], minlength=k)) if len(found) else total
        weights = np.zeros((2 * k + 1, k))
        weights[-1] = np.log((shares + 1e-3) / (shares + 1e-3).sum()) if shares.sum() else 0
        return Classifier(ratios, weights)
    return Classifier(ratios, fit_softmax(np.array(found["x"].tolist()), found["domain"].to_numpy(), k))


def with_posterior(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs as the struct column row, tokens (words of the text) and p (the posterior)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for texts in batches:
                found = [shared.value.posteriors_of(portion) for portion in in_portions(texts)]
                yield pd.DataFrame({"tokens": [n for words, _ in found for n in words.tolist()], "p": [p for _, ps in found for p in ps.tolist()]})
        finally:
            give_back()

    # not deterministic as far as the optimiser knows, so a filter on what it gives doesn't compute it a second time
    both = F.pandas_udf(score, "tokens long, p array<double>").asNondeterministic()
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), both("text").alias("_x")).select("row", "_x.*")


def least_rate(keep: float | None) -> Column:
    return F.lit(0.0) if keep is None else F.when(F.col("p")[0] >= keep, 1.0).otherwise(0.0)


def rate(steps: list[np.ndarray], most: float = MAX_RATE, keep: float | None = None) -> Column:
    """A document's rate after these steps, from its posterior p: a fold over one literal array. keep: from this posterior of the first domain on, a rate never falls under 1."""
    if not steps:
        return F.lit(1.0)
    table = F.array(*(F.array(*(F.lit(float(x)) for x in step)) for step in steps))
    change = lambda step: F.aggregate(F.zip_with("p", step, lambda p, x: p * x), F.lit(0.0), lambda acc, x: acc + x)
    return F.aggregate(table, F.lit(1.0), lambda r, step: F.least(F.greatest(r - change(step), least_rate(keep)), F.lit(most)))


def fit_rates(documents: DataFrame, targets: list[float], budget: float | None = None, most: float = MAX_RATE, rounds: int = ROUNDS, keep: float | None = None) -> list[np.ndarray]:
    """The steps that rate() folds, for documents (tokens, p). budget: the tokens wanted in all, those of the documents if None."""
    k, steps, size, best = len(targets), [], 1.0, np.inf
    goal: np.ndarray | None = None
    for _ in range(rounds):
        r, t, p = rate(steps, most, keep), F.col("tokens"), F.col("p")
        inside = F.when((F.col("r") > least_rate(keep)) & (F.col("r") < most) | (F.lit(not steps) & (F.col("r") < most)), t).otherwise(0.0)
        sums = [F.sum(F.col("r") * t * p[i]) for i in range(k)] + [F.sum(inside * p[i] * p[j]) for i in range(k) for j in range(k)]
        row = np.array([x or 0.0 for x in documents.withColumn("r", r).agg(*(s.alias(f"s{n}") for n, s in enumerate([*sums, F.sum(t)]))).first()], dtype=float)
        total, gram, tokens = row[:k], row[k : k + k * k].reshape(k, k), row[-1]
        ridge = RIDGE * gram.trace() / k * np.eye(k) if goal is None else ridge
        goal = np.asarray(targets) * (tokens if budget is None else budget) if goal is None else goal
        miss = total - goal
        error = float(miss @ miss)
        if error > best:  # the step went too far: take half of it
            size /= 2
            steps[-1] = steps[-1] / 2
            if size < 1e-2:
                return steps[:-1]
            continue
        if np.abs(miss).max() <= ENOUGH * max(goal.sum(), 1):
            return steps
        if steps and best - error <= 0.02 * best:
            LOG.warning("targets missed by %s of %s tokens: rates at their bounds get no closer", np.abs(miss).round().tolist(), goal.sum())
            return steps
        best, size = error, 1.0
        steps.append(np.linalg.solve(gram + ridge, miss) if tokens else np.zeros(k))
    LOG.warning("targets missed by %s tokens after %s rounds", np.sqrt(best).round(), rounds)
    return steps[:-1]  # the last step was not tried


def copies(steps: list[np.ndarray], *identity: str, keep: float | None = None) -> Column:
    """How often a document is taken: its rate, rounded up or down by a hash of what identifies it."""
    chance = F.pmod(F.xxhash64(*identity, F.lit(11)), F.lit(2**20)) / F.lit(float(2**20))
    return F.floor(rate(steps, keep=keep) + chance).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, tokens, p_<domain> for each target, rate and copies."""
    model = fit(docs, labelled, k=len(targets))
    found = written(with_posterior(docs.select("doc_id", "text"), model).select("row.doc_id", F.xxhash64("row.text").alias("key"), "tokens", "p"), "posteriors")
    steps = fit_rates(found, list(targets.values()))
    return found.select("doc_id", "tokens", *(F.col("p")[i].alias(f"p_{name}") for i, name in enumerate(targets)), rate(steps).alias("rate"), copies(steps, "doc_id", "key").alias("copies"))


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, keep: float | None = None) -> DataFrame:
    """docs, each as often as its copies say. Rows and posteriors are written once; rates depend on the posterior alone, so nothing is joined. Equal rows are taken or left together. keep: documents with this posterior of the first domain stay (then the targets may be missed)."""
    model = fit(docs, labelled, k=len(targets))
    found = written(with_posterior(docs, model), "posteriors")
    steps = fit_rates(found, list(targets.values()), keep=keep)
    taken = found.select("row", copies(steps, "row.doc_id", "row.text", keep=keep).alias("n")).where("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("row.*")
