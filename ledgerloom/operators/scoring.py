"""Distance between groups, rarity inside groups, materiality, and the graded score of every voucher.

All group-grain tables have a handful of rows (one per group or pair of groups), so joins with them are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT, OTHER, Settings
from ledgerloom.functions import scalars as S
from ledgerloom.operators.classify import combination_counts, involved_counts


def distance_matrix(c: DataFrame) -> DataFrame:
    """g1, g2, distance for every ordered pair of groups. X is the noisy-or of the shares (n+1)/(sum+2) of the combinations that hold both; the distance is 1/X - 1, 100 at most and where there are none, 0 on the diagonal."""
    sizes = involved_counts(c)
    combos = combination_counts(c).withColumn("g", F.explode("combination")).join(F.broadcast(sizes.withColumnRenamed("n", "size")), "g")
    combos = combos.groupBy("combination", "n").agg(F.sum("size").alias("total"))
    pairs = combos.select("n", "total", F.explode("combination").alias("g1"), "combination").withColumn("g2", F.explode("combination")).where("g1 <> g2")
    shared = pairs.groupBy("g1", "g2").agg((1 - F.product(1 - (F.col("n") + 1) / (F.col("total") + 2))).alias("x"))
    names = sizes.select("g")
    square = names.withColumnRenamed("g", "g1").crossJoin(F.broadcast(names.withColumnRenamed("g", "g2")))  # one row per group on each side
    distance = F.when(F.col("g1") == F.col("g2"), 0.0).when(F.col("x") > 0, S.round2(F.least(F.lit(100.0), 1 / F.col("x") - 1))).otherwise(100.0)
    return square.join(F.broadcast(shared), ["g1", "g2"], "left").select("g1", "g2", distance.alias("distance"))


def matrix_frame(distances: DataFrame) -> DataFrame:
    """The distances as a square table."""
    return distances.groupBy("g1").pivot("g2").agg(F.first("distance")).fillna(0.0)


def kinds(c: DataFrame) -> DataFrame:
    """primary_group, feature, kind, n, pairs: vouchers with the same subjects on the same sides are one kind, n of them, with the distinct connections (src, dst) that each has."""
    between = lambda src, dst: F.flatten(F.transform(src, lambda x: F.transform(F.array_remove(dst, x), lambda y: F.struct(F.trim(x).alias("src"), y.alias("dst")))))
    # a line with both sides counts as a debit line, so its subject looks at the credit side
    pairs = F.array_distinct(F.concat(between(F.col("credit_subjects"), F.col("debit_subjects")), between(F.col("both_subjects"), F.col("credit_subjects"))))
    sides = ["debit_subjects", "credit_subjects", "both_subjects"]
    found = c.groupBy("primary_group", "feature", kind_of().alias("kind")).agg(F.count("*").alias("n"), *(F.any_value(s).alias(s) for s in sides))
    return found.withColumn("pairs", pairs).drop(*sides)


def kind_of():
    """What the subjects of a voucher say by side, as text."""
    return F.to_json(F.struct("debit_subjects", "credit_subjects", "both_subjects"))


def connections(c: DataFrame) -> DataFrame:
    return _counted(kinds(c))


def _counted(k: DataFrame) -> DataFrame:
    return k.select("primary_group", "n", F.explode("pairs").alias("p")).groupBy("primary_group", "p.src", "p.dst").agg(F.sum("n").alias("n"))


def concentration(conn: DataFrame) -> DataFrame:
    """primary_group, hhi, total: the sum of squared shares of a group's connections, from whole numbers."""
    sums = conn.groupBy("primary_group").agg(F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("n").alias("total"))
    return sums.select("primary_group", (F.col("squares").cast("double") / (F.col("total").cast("double") * F.col("total").cast("double"))).alias("hhi"), "total")


def feature_frequency(c: DataFrame) -> DataFrame:
    counts = c.groupBy("primary_group", "feature").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("primary_group")))


def inner_scores(c: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """voucher, inner_score: the rarest connection of the voucher; without connections the rarity of its feature, if rare; plus a penalty in the group of others. Each kind of voucher is scored once."""
    k = kinds(c)
    conn = _counted(k)
    hhi = concentration(conn)
    rated = conn.join(F.broadcast(hhi), "primary_group").withColumn("score", F.least(F.lit(s.top_score), S.rarity(F.col("n") / F.col("total"), F.col("hhi"))))
    each = k.select("primary_group", "feature", "kind", F.explode("pairs").alias("p")).select("primary_group", "feature", "kind", "p.*")
    best = each.join(rated.select("primary_group", "src", "dst", "score"), ["primary_group", "src", "dst"]).groupBy("primary_group", "feature", "kind").agg(F.max("score").alias("best"))
    freq = feature_frequency(c).select("primary_group", "feature", (F.col("n") / F.col("total")).alias("share"))
    base = k.select("primary_group", "feature", "kind").join(best, ["primary_group", "feature", "kind"], "left").join(F.broadcast(hhi.select("primary_group", "hhi")), "primary_group", "left").join(freq, ["primary_group", "feature"])
    h = F.coalesce("hhi", F.lit(0.0))
    rare = S.rarity(F.col("share"), h)
    without = F.when(F.col("share") < s.rare_share, F.when(h >= 0.9999, rare).otherwise(F.least(F.lit(s.top_score), rare))).otherwise(0.0)
    penalty = F.when(F.col("primary_group") == OTHER, s.other_penalty).otherwise(0.0)
    scored = base.select("primary_group", "feature", "kind", S.round2(F.coalesce("best", without) + penalty).alias("inner_score"))
    return c.select("voucher", "primary_group", "feature", kind_of().alias("kind")).join(scored, ["primary_group", "feature", "kind"]).select("voucher", "inner_score")


def cross_scores(c: DataFrame, distances: DataFrame) -> DataFrame:
    """involved_groups, cross_score: the sum of distances of the pairs of groups. Sets of groups are few, so each is summed once."""
    sets = c.where("is_cross_group").select("involved_groups", "involved").distinct()
    pairs = sets.select("involved_groups", "involved", F.explode("involved").alias("g1")).withColumn("g2", F.explode("involved")).where(f"g1 < g2 and g1 <> '{OTHER}' and g2 <> '{OTHER}'")
    return pairs.join(F.broadcast(distances), ["g1", "g2"]).groupBy("involved_groups").agg(S.round2(F.sum("distance")).alias("cross_score"))


def materiality(c: DataFrame, pareto: float = DEFAULT.pareto) -> DataFrame:
    """primary_group, level: the amount at which vouchers, largest first, reach the share `pareto` of their group's total.

    In two steps: sums of ranges of amounts (a thousandth wide) show in which range the share is reached, and only the
    distinct amounts of that range are run through, so no task gets all amounts of a group. Sums are decimals.
    """
    amounts = c.groupBy("primary_group", "abs_amount").agg(F.count("*").alias("n"))
    amounts = amounts.withColumns({"sum": (F.col("abs_amount") * F.col("n")).cast("decimal(38,2)"), "range": F.floor(F.ln(F.col("abs_amount").cast("double") + 1) * 1000)})
    down = lambda order, *by: Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    ranges = amounts.groupBy("primary_group", "range").agg(F.sum("sum").cast("decimal(38,2)").alias("sum"), F.min("abs_amount").alias("least"))
    group = Window.partitionBy("primary_group")
    ranges = ranges.withColumns({"running": F.sum("sum").over(down("range", "primary_group")), "total": F.sum("sum").over(group), "least": F.min("least").over(group)})
    reached = F.col("running").cast("double") >= F.col("total").cast("double") * pareto
    # where rounding lets no range reach the total, the level is the least amount
    crossing = ranges.groupBy("primary_group").agg(F.max(F.when(reached, F.struct("range", (F.col("running") - F.col("sum")).cast("decimal(38,2)").alias("before")))).alias("at"), F.any_value("total").alias("total"), F.any_value("least").alias("least"))
    inside = amounts.join(F.broadcast(crossing.select("primary_group", F.col("at.range").alias("range"), "at.before", "total")), ["primary_group", "range"])  # one row per group
    running = inside.withColumn("running", F.col("before") + F.sum("sum").over(down("abs_amount", "primary_group")))
    found = running.groupBy("primary_group").agg(F.max(F.when(reached, F.col("abs_amount"))).alias("crossing"))
    level = crossing.join(F.broadcast(found), "primary_group", "left")
    return level.select("primary_group", F.when(F.col("total") == 0, 0.0).otherwise(F.coalesce("crossing", "least").cast("double")).alias("level"))


def score(c: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Vouchers with cross_score, inner_score, alpha, final_score, level, anomaly_type and risk_level."""
    cross = cross_scores(c, distance_matrix(c))
    out = c.join(F.broadcast(cross), "involved_groups", "left").join(inner_scores(c, s), "voucher").join(F.broadcast(materiality(c, s.pareto)), "primary_group")
    out = out.withColumn("cross_score", F.coalesce("cross_score", F.lit(0.0))).withColumn("alpha", S.alpha(F.col("abs_amount").cast("double"), F.col("level"), s))
    out = out.withColumn("final_score", S.round2((F.col("cross_score") + F.col("inner_score")) * F.col("alpha")))
    return out.withColumns({"anomaly_type": S.anomaly_type(F.col("cross_score"), F.col("inner_score")), "risk_level": S.risk_level(F.col("final_score"))})


def materiality_preview(c: DataFrame, pareto: float = DEFAULT.pareto) -> DataFrame:
    """Per group, and for all (primary_group null): what the materiality level leaves out."""
    v = c.join(F.broadcast(materiality(c, pareto)), "primary_group")
    below = F.col("abs_amount").cast("double") < F.col("level")
    part = lambda x: F.coalesce(F.sum(F.when(below, F.col(x))), F.lit(0)).cast("double")
    out = v.rollup("primary_group").agg(
        F.max("level").alias("level"),
        F.count("*").alias("n_vouchers"),
        F.sum("abs_amount").cast("double").alias("amount"),
        F.count_if(below).alias("n_excluded"),
        part("abs_amount").alias("excluded_amount"),
        part("debit_sum").alias("excluded_debit"),
    )
    ratio = lambda a, b: F.rint(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)) * 1e6) / 1e6
    return out.withColumns({"level": F.when(F.col("primary_group").isNotNull(), F.col("level")), "excluded_share": ratio("n_excluded", "n_vouchers"), "excluded_amount_share": ratio("excluded_amount", "amount")})


def anomaly_summary(scored: DataFrame) -> DataFrame:
    has = lambda c, t: F.count_if(F.col(c).contains(t))
    return scored.agg(
        F.count("*").alias("total_vouchers"),
        has("risk_level", "高风险").alias("high_risk"),
        has("risk_level", "中风险").alias("medium_risk"),
        has("risk_level", "低风险").alias("low_risk"),
        has("risk_level", "正常").alias("normal"),
        has("anomaly_type", "跨模块").alias("cross_group"),
        S.round2(F.sum(F.col("final_score").cast("decimal(20,2)")).cast("double") / F.count("*")).alias("avg_score"),
        F.max("final_score").alias("max_score"),
    )


def high_risk(scored: DataFrame, n: int = 10) -> DataFrame:
    """The first n high-risk vouchers, by their text."""
    return scored.where(F.col("risk_level").contains("高风险")).orderBy("voucher").limit(n)


def group_stats(scored: DataFrame) -> DataFrame:
    return scored.groupBy("primary_group").agg(
        S.round2(F.sum(F.col("final_score").cast("decimal(20,2)")).cast("double") / F.count("*")).alias("mean_score"),
        F.max("final_score").alias("max_score"),
        F.count("*").alias("n_vouchers"),
        F.count_if("is_cross_group").alias("n_cross"),
    )


def score_histogram(scored: DataFrame, bins: int = 50) -> DataFrame:
    """bin, n: equal bins from 0 to the largest score."""
    most = scored.agg(F.max("final_score").alias("most"))
    at = F.when(F.col("most") > 0, F.least(F.floor(F.col("final_score") * bins / F.col("most")), F.lit(bins - 1))).otherwise(0)
    return scored.crossJoin(F.broadcast(most)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))  # one row


def distance_pairs(distances: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest and k farthest pairs of groups, without zeros."""
    pairs = distances.where("g1 < g2 and distance > 0")
    near = pairs.orderBy("distance", "g1", "g2").limit(k).withColumn("end", F.lit("nearest"))
    return near.unionByName(pairs.orderBy(F.desc("distance"), "g1", "g2").limit(k).withColumn("end", F.lit("farthest")))
