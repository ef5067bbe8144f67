"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Removes a query's shuffle files when it ends; nothing reads them once its result is a table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Arrays collected for very many groups: sorted once by group, where hashing would sort twice, as it gives up after a few groups in a task, before and after merging.
ONE_SORT = {"spark.sql.execution.useObjectHashAggregateExec": "false"}


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, a folder of this machine with a local master (tests), else an error: executors of a cluster would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, is computed once, and outlives lost executors. settings of the session hold for this only."""
    spark = df.sparkSession
    path, settings = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}", {CLEANUP: "true"} | (settings or {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, x in settings.items():
        spark.conf.set(k, x)
    try:
        df.write.parquet(path)
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def drop_written(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for t in tables:
        system, path = hadoop_path(t.sparkSession, t.folder)
        system.delete(path, True)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with one more column: numbers from 1, without gaps, in this order (rows that it leaves equal: any order).

    Rows are dealt by ranges of the order and sorted in their partition; a partition's numbers start after the rows of
    those before it, so no task sees more than its range. Add a column that tells rows apart to the order where many may
    be equal: equal rows are one range. df is computed twice (the first time to find the ranges).
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # the partition, then 33 bits of the row's place in it
    ranged = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = written(ranged.select(F.struct("*").alias("row"), F.shiftright(at, 33).alias("range"), at.bitwiseAND(2**33 - 1).alias("at")), "numbered")
    before, starts = 0, []
    for r in placed.groupBy("range").count().orderBy("range").collect():  # a row a partition
        starts.append((r["range"], before + 1))
        before += r["count"]
    starts = F.broadcast(spark.createDataFrame(starts, "range long, start long"))
    return placed.join(starts, "range").select("row.*", (F.col("start") + F.col("at")).alias(name))


#: A group of more rows than SPLIT may be parted; the PARTED largest groups are looked at, so any other has less than a PARTED-th of all rows.
SPLIT, PARTED = 50_000, 1_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, spread: str, split: int = SPLIT, sizes: DataFrame | None = None) -> DataFrame:
    """rows with the other columns of `groups` (one row per key, with n_rows, the rows that have it), as windows by key would give them, but no task gets all rows of a large group.

    A large group's rows are dealt over parts by a hash of the column `spread`, and its row of `groups` is there once for
    each part. Null keys are a group. n_rows does not stay. sizes: a written table with key and n_rows of these groups or
    more, where large ones are looked up without computing `groups` twice.
    """
    parts = F.ceil(F.col("n_rows") / split).cast("int")
    # the order looks at every column, so that this reads the shuffle which the join reads, not a narrower one of its own
    every = [F.xxhash64(*(F.col(f"`{c}`") for c in groups.columns))] if sizes is None else []
    large = (groups if sizes is None else sizes.select(key, "n_rows")).orderBy(F.desc("n_rows"), key, *every).limit(PARTED).where(F.col("n_rows") > split)
    large = F.broadcast(large.select(F.col(key).alias("_large"), parts.alias("_parts")))
    count = F.coalesce(F.col("_parts"), F.lit(1))
    dealt = rows.join(large, F.col(key).eqNullSafe(F.col("_large")), "left").withColumn("_part", F.pmod(F.xxhash64(spread), count)).drop("_large", "_parts")
    copies = groups.join(large, F.col(key).eqNullSafe(F.col("_large")), "left").withColumn("_at", F.explode(F.sequence(F.lit(0), count - 1)))
    copies = copies.withColumnRenamed(key, "_key").drop("_large", "_parts", "n_rows")
    return dealt.join(copies, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at"))).drop("_key", "_at", "_part")
