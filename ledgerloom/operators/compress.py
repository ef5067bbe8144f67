"""Compressing large journals before the contra analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.vouchers import subject_set
from ledgerloom.shared import join_groups, numbered, written


def _sides(df: DataFrame) -> DataFrame:
    """Rows with both amounts become two, rows with none go."""
    zero = F.lit(0).cast(df.schema["debit"].dataType)
    debit = df.where("debit <> 0").withColumn("credit", zero)
    return debit.unionByName(df.where("credit <> 0").withColumn("debit", zero))


def simple(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Sums by `keys` (date, number, perhaps summary, subject, perhaps details), debit and credit rows apart; rows with a null key go."""
    known = lines.dropna(subset=keys)
    return _sides(known.groupBy(*keys).agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit")))


def minimal(lines: DataFrame) -> DataFrame:
    """virtual_voucher, feature, month, subject, debit, credit: sums by month and voucher feature (years merge), numbered in the text order of month_feature."""
    features = lines.groupBy("voucher").agg(F.count("*").alias("n_rows"), F.array_join(subject_set(), "、").alias("feature"))
    month = lines.withColumn("month", F.month(F.try_to_timestamp("date"))).where("month is not null")
    key = F.concat_ws("_", F.col("month").cast("string"), F.col("feature"))
    of = join_groups(month, features, "voucher", "line_no").groupBy("month", "feature", "subject").agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))
    sums = written(of.withColumn("key", key), "sums")
    keys = numbered(sums.select("key").distinct(), "virtual_voucher", F.col("key"))
    return _sides(sums.join(keys, "key").drop("key"))
