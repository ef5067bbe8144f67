"""Comparing the members of buckets in blocks of bounded size, and connected components of the links found."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import drop_written, written

#: Members of a block, and rows of a unit (what one call of a comparing function gets is about this many rows).
BLOCK, UNIT = 256, 4_000


def in_units(members: DataFrame, bucket: list[str], member: str, block: int = BLOCK, unit: int = UNIT) -> DataFrame:
    """members with _bucket, _left, _right, _block and _unit: rows to compare are those with equal (_bucket, _left, _right).

    A bucket of more than `block` members is cut into blocks by a hash of the member, and each pair of blocks is
    compared on its own, so no group grows with its bucket. Buckets with a single member are left out.
    """
    sizes = members.groupBy(*bucket).agg(F.count("*").alias("_size")).where("_size > 1")
    sized = members.join(sizes, bucket).withColumn("_blocks", F.ceil(F.col("_size") / block).cast("int")).drop("_size")
    own = F.pmod(F.xxhash64(member, F.lit(7)), F.col("_blocks")).cast("int")
    dealt = sized.withColumn("_block", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = dealt.select(
        *members.columns,
        F.xxhash64(*bucket).alias("_bucket"),
        "_block",
        F.least("_block", "_other").alias("_left"),
        F.greatest("_block", "_other").alias("_right"),
    )
    total = sizes.agg(F.sum(F.col("_size") * F.ceil(F.col("_size") / block))).first()[0] or 0
    return rows.withColumn("_unit", F.pmod(F.xxhash64("_bucket", "_left", "_right"), F.lit(max(1, int(total) // unit))))


#: A key with more than this share of the rows, and more than LIGHT of them, is heavy; there are at most as many of them as the share goes into 1.
HEAVY, LIGHT = 1 / 1_000, 100


def join_counted(big: DataFrame, small: DataFrame, on: list[str], counts: DataFrame, how: str = "inner", total: int | None = None) -> DataFrame:
    """big joined to small, whose keys are unique, without sending a heavy key's rows to one task.

    counts: a written table of keys and n, how many rows of big have them (keys with LIGHT rows and less may be missing if
    total is given, the rows of big). Rows with heavy keys meet the (at most
    1 / HEAVY) rows of small that have them by a broadcast, all others by a shuffle.
    """
    if total is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.where(F.col("n") > max(LIGHT, total * HEAVY)).select(*on).collect()
    if not heavy:
        return big.join(small, on, how)
    keys = F.broadcast(big.sparkSession.createDataFrame(heavy, counts.select(*on).schema))
    few = F.broadcast(small.join(keys, on, "left_semi"))
    return big.join(keys, on, "left_semi").join(few, on, how).unionByName(big.join(keys, on, "left_anti").join(small, on, how))


def groups_of(pdf, *names: str):
    """Index arrays of the rows with equal values in `names`."""
    keys = [pdf[n].to_numpy() for n in names]
    order = np.lexsort(keys[::-1])
    change = np.zeros(max(len(order) - 1, 0), dtype=bool)
    for k in keys:
        change |= np.diff(k[order]) != 0
    return np.split(order, np.flatnonzero(change) + 1) if len(order) else []


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix, breadth first, so paths stay short."""
    fresh, out = np.ones(len(linked), dtype=bool), []
    for start in range(len(linked)):
        if not fresh[start]:
            continue
        fresh[start], queue = False, [start]
        for at in queue:
            new = np.flatnonzero(linked[at] & fresh)
            fresh[new] = False
            out += [(at, int(n)) for n in new]
            queue += new.tolist()
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that each node of the edges reaches. Stars are contracted in turns until nothing changes; every turn is a written table. Edges with a null node are left out."""
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    pairs = written(pairs, "edges")
    mark = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m"))
        # large star: larger neighbours of a node go to the smallest of its neighbourhood
        large = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a != b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        after = written(small, "edges")
        drop_written(pairs)
        pairs = after
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now
