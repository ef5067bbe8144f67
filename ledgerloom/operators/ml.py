"""Learned fallback for vouchers that no rule places: TF-IDF of features, group centroids, nearest centroid by cosine.

Features are account sets: they repeat in millions of vouchers and are few, so everything is fitted on distinct features.
Vectors are rows (feature, term, weight). The vocabulary has a defined order (most frequent terms first, equally frequent
ones by their text), so results do not depend on how the journal is partitioned.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import OTHER
from ledgerloom.functions import scalars as S
from ledgerloom.shared import written

MIN_ROWS, VOCABULARY, MIN_FEATURES, MIN_SIMILARITY = 10, 100, 2, 0.3


def documents(c: DataFrame) -> DataFrame:
    """feature, primary_group, words: tokens of two characters and more, then pairs of neighbours; one row per feature."""
    out = c.select("feature", "primary_group", "subjects").distinct()
    words = F.filter(S.tokens(F.col("subjects")), lambda t: F.length(t) >= 2)
    out = out.withColumn("one", words)
    pairs = F.when(F.size("one") > 1, F.zip_with(F.slice("one", F.lit(1), F.size("one") - 1), F.slice("one", F.lit(2), F.size("one") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return out.select("feature", "primary_group", F.concat("one", pairs).alias("words"))


def vocabulary(docs: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """term, place, idf: the most frequent terms of placed features that are in two of them at least, with idf ln((1+n)/(1+df)) + 1; at most `size` rows."""
    placed = docs.where(F.col("primary_group") != OTHER)
    counts = placed.select("feature", F.explode("words").alias("term")).groupBy("feature", "term").agg(F.count("*").alias("tf"))
    terms = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).where(F.col("df") >= MIN_FEATURES)
    most = terms.orderBy(F.desc("total"), "term").limit(size)
    n = placed.agg(F.count("*").alias("n"))  # one row
    idf = F.ln((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1
    place = F.row_number().over(Window.orderBy(F.desc("total"), "term"))  # over the few terms that were taken
    return most.crossJoin(F.broadcast(n)).select("term", (place - 1).alias("place"), idf.alias("idf"))


def vectors(docs: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """feature, primary_group, term, place, weight: unit TF-IDF vectors; a feature without a known term has no rows."""
    counts = docs.select("feature", "primary_group", F.explode("words").alias("term")).groupBy("feature", "primary_group", "term").agg(F.count("*").alias("tf"))
    raw = counts.join(F.broadcast(vocabulary(docs, size)), "term").withColumn("x", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("feature")))  # at most `size` rows
    return raw.select("feature", "primary_group", "term", "place", (F.col("x") / norm).alias("weight"))


def fit_features(c: DataFrame, size: int = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """documents() and vectors() of the vouchers' features, both written."""
    docs = written(documents(c), "features")
    return docs, written(vectors(docs, size), "vectors")


def centroids(docs: DataFrame, v: DataFrame) -> DataFrame:
    """g, term, weight: the mean vector of each group that rules know; features without a known term count too."""
    sums = v.where(F.col("primary_group") != OTHER).groupBy(F.col("primary_group").alias("g"), "term").agg(F.sum("weight").alias("sum"))
    sizes = docs.where(F.col("primary_group") != OTHER).groupBy(F.col("primary_group").alias("g")).agg(F.count("*").alias("n"))
    return sums.join(F.broadcast(sizes), "g").select("g", "term", (F.col("sum") / F.col("n")).alias("weight"))


def predict(c: DataFrame) -> DataFrame:
    """voucher, primary_group, ml_predicted: vouchers of the group of others go to the nearest group if the cosine reaches 0.3 (of equally near ones the first by name). Nothing is learned from fewer than 10 placed features."""
    docs, v = fit_features(c)
    if docs.where(F.col("primary_group") != OTHER).limit(MIN_ROWS).count() < MIN_ROWS:
        return c.select("voucher", "primary_group", F.lit(False).alias("ml_predicted"))
    centers = centroids(docs, v)
    norms = centers.groupBy("g").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    # eight groups of a hundred terms at most
    near = v.where(F.col("primary_group") == OTHER).join(F.broadcast(centers.join(norms, "g").select("g", "term", (F.col("weight") / F.col("norm")).alias("center"))), "term")
    cosine = near.groupBy("feature", "g").agg((F.rint(F.sum(F.col("weight") * F.col("center")) * 1e9) / 1e9).alias("cosine"))
    best = cosine.groupBy("feature").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "g")).alias("b"))
    found = best.where(-F.col("b.less") >= MIN_SIMILARITY).select("feature", F.col("b.g").alias("guess"))
    out = c.select("voucher", "feature", "primary_group").join(found, "feature", "left")
    return out.select("voucher", F.coalesce("guess", "primary_group").alias("primary_group"), F.col("guess").isNotNull().alias("ml_predicted"))


def feature_clusters(c: DataFrame, seed: int = 42, size: int = 50) -> DataFrame:
    """feature, cluster: k-means over unit TF-IDF vectors of 50 terms, k between 2 and 8 but no more than there are different vectors. Features are sorted by ranges first, so the same features give the same clusters."""
    docs, v = fit_features(c, size)
    entries = v.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("place", "weight"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    none = F.array_repeat(F.lit(0.0), size)
    data = docs.select("feature").join(entries, "feature", "left").select("feature", F.when(F.col("m").isNull(), none).otherwise(dense).alias("x"))
    points = written(data.repartitionByRange(8, "feature").sortWithinPartitions("feature"), "points")
    different = points.select("x").distinct().limit(8).count()
    if different < 2:
        return points.select("feature", F.lit(0).alias("cluster"))
    k = min(different, max(2, min(8, points.count() // 2)))
    data = points.select("feature", array_to_vector("x").alias("features"))
    return KMeans(k=k, seed=seed).fit(data).transform(data).select("feature", F.col("prediction").alias("cluster"))


def similar_subjects(subjects: DataFrame, k: int) -> DataFrame:
    """subject, other, similarity: the k nearest subjects by the cosine of character counts; joined on shared characters."""
    chars = subjects.select("subject", F.explode(F.split("subject", "")).alias("c")).where("c <> ''").groupBy("subject", "c").agg(F.count("*").alias("n"))
    norm = chars.groupBy("subject").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    unit = chars.join(norm, "subject")
    other = unit.select(F.col("subject").alias("other"), "c", F.col("n").alias("m"), F.col("norm").alias("other_norm"))
    dots = unit.join(other, "c").where("subject <> other").groupBy("subject", "other").agg((F.sum(F.col("n") * F.col("m")) / (F.any_value("norm") * F.any_value("other_norm"))).alias("s"))
    scored = dots.select("subject", "other", (F.rint(F.col("s") * 1e6) / 1e6).alias("similarity"))
    w = Window.partitionBy("subject").orderBy(F.desc("similarity"), "other")
    return scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
