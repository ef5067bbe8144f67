"""The graph of a group's connections: edges, nodes, levels from the roots, and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.shared import drop_written, written


def edges(lines: DataFrame) -> DataFrame:
    """primary_group, src, dst, weight (paying lines), n_vouchers, width and opacity, from lines with counter_subject and primary_group."""
    paid = lines.where("credit > 0 and subject <> ''").select("voucher", "primary_group", F.col("subject").alias("src"), F.explode(S.split_subjects(F.col("counter_subject"))).alias("dst"))
    # counted per voucher first: the distinct count needs no expansion
    per = paid.groupBy("primary_group", "src", "dst", "voucher").agg(F.count("*").alias("n"))
    out = per.groupBy("primary_group", "src", "dst").agg(F.sum("n").alias("weight"), F.count("*").alias("n_vouchers"))
    most = F.max("weight").over(Window.partitionBy("primary_group"))
    six = lambda c: F.rint(c * 1e6) / 1e6
    return out.withColumns({"width": six(S.edge_width(F.col("weight"), most)), "opacity": six(S.edge_opacity(F.col("weight"), most))})


def nodes(e: DataFrame) -> DataFrame:
    """primary_group, node, n_in, n_out, width, category."""
    ends = e.select("primary_group", F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select("primary_group", F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    out = ends.groupBy("primary_group", "node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return out.withColumns({"width": S.node_width(F.col("node")), "category": S.subject_category(F.col("node"))})


def levels(e: DataFrame) -> DataFrame:
    """primary_group, node, level: steps from the nearest node nothing leads to; nodes in cycles that none reaches follow one level after another, by name.

    Each round joins the nodes reached last with the edges and writes what is reached so far to the shared folder, so
    plans do not grow with the rounds. The edges are those of a chart of accounts, whatever the journal's size.
    """
    e = written(e.select("primary_group", "src", "dst").distinct(), "edges")
    every = nodes_of(e)
    led_to = e.select("primary_group", F.col("dst").alias("node")).distinct()
    reached = written(every.join(led_to, ["primary_group", "node"], "left_anti").withColumn("level", F.lit(0)), "levels")
    depth, n = 0, reached.count()
    while True:
        last = reached.where(F.col("level") == depth).select("primary_group", F.col("node").alias("src"))
        new = last.join(e, ["primary_group", "src"]).select("primary_group", F.col("dst").alias("node")).distinct().join(reached, ["primary_group", "node"], "left_anti")
        more = written(reached.unionByName(new.withColumn("level", F.lit(depth + 1))), "levels")
        drop_written(reached)
        reached, before, n, depth = more, n, more.count(), depth + 1
        if n == before:
            break
    rest = every.join(reached, ["primary_group", "node"], "left_anti")
    last = reached.groupBy("primary_group").agg(F.max("level").alias("last"))
    order = F.row_number().over(Window.partitionBy("primary_group").orderBy("node"))
    cyclic = rest.join(last, "primary_group", "left").withColumn("level", F.coalesce("last", F.lit(0)) + order).drop("last")
    return reached.unionByName(cyclic)


def nodes_of(e: DataFrame) -> DataFrame:
    return e.select("primary_group", F.explode(F.array("src", "dst")).alias("node")).distinct()


def layout(lv: DataFrame) -> DataFrame:
    """x by level, y by name within the level, centred."""
    w = Window.partitionBy("primary_group", "level")
    i = F.row_number().over(w.orderBy("node")) - 1
    return lv.select("primary_group", "node", "level", (F.col("level") * 280 + 150).cast("double").alias("x"), ((F.count("*").over(w) - 1) * 44.0 - i * 88.0).alias("y"))


def summary(e: DataFrame) -> DataFrame:
    """primary_group, n_nodes, n_edges, flow."""
    counts = e.groupBy("primary_group").agg(F.count("*").alias("n_edges"), F.sum("weight").alias("flow"))
    return counts.join(nodes_of(e).groupBy("primary_group").agg(F.count("*").alias("n_nodes")), "primary_group")
