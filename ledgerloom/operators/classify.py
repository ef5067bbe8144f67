"""Rule-based business groups of vouchers, as expressions over their subjects."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import ANCHOR, CHARACTERISTIC, DEFAULT, OTHER, Settings
from ledgerloom.functions import scalars as S

STRINGS = "array<string>"


def _words(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast(STRINGS)


def _if(condition: Column, name: str) -> Column:
    return F.when(condition, F.array(F.lit(name))).otherwise(F.array().cast(STRINGS))


def _valid(subjects: Column, s: Settings) -> Column:
    """Subjects but for stop words, which say nothing."""
    return F.array_except(subjects, _words(s.stop_words))


def _hits(valid: Column, s: Settings) -> Column:
    """For each group in the order of CHARACTERISTIC and ANCHOR its words among the subjects."""
    return F.struct(*(F.array_intersect(valid, _words(s.group_words.get(g, []))).alias(g) for g in (*CHARACTERISTIC, *ANCHOR)))


def _involved(valid: Column, hits: Column) -> Column:
    """The groups that a voucher takes part in, from the subjects that say something, in their order, and each group's words among them.

    One word decides for a characteristic group. The others need: the only word left; or both words of two (else either);
    or two words of three and more, in the order in which the groups' first words appear.
    """
    of = lambda g: hits.getField(g)
    characteristic = F.concat(*(_if(F.size(of(g)) > 0, g) for g in CHARACTERISTIC))
    both = F.concat(*(_if(F.size(of(g)) == 2, g) for g in ANCHOR))
    either = F.concat(*(_if(F.size(of(g)) > 0, g) for g in ANCHOR))
    first = lambda g: F.array_position(valid, of(g)[0])
    ranked = F.array_sort(F.concat(*(F.when(F.size(of(g)) >= 2, F.array(F.struct(first(g).alias("at"), F.lit(g).alias("g")))).otherwise(F.array().cast("array<struct<at:bigint,g:string>>")) for g in ANCHOR)))
    many = F.transform(ranked, lambda x: x["g"])
    anchor = F.when(F.size(valid) == 1, either).when(F.size(valid) == 2, F.when(F.size(both) > 0, both).otherwise(either)).otherwise(many)
    return F.array_distinct(F.concat(characteristic, anchor))


def _group(subjects: Column, valid: Column, hits: Column, involved: Column) -> Column:
    """struct(primary_group, involved, classify_type)."""
    nothing = F.size(involved) == 0
    characteristic = reduce(or_, (F.size(hits.getField(g)) > 0 for g in CHARACTERISTIC), F.lit(False))
    kind = (
        F.when(F.size(subjects) == 0, OTHER)
        .when(F.size(valid) == 0, "停用词主导")
        .when(characteristic, "特性群判定")
        .when(~nothing, "二元锚定")
        .otherwise(OTHER)
    )
    return F.struct(
        F.when(nothing, OTHER).otherwise(involved[0]).alias("primary_group"),
        F.when(nothing, F.array(F.lit(OTHER))).otherwise(involved).alias("involved"),
        kind.alias("classify_type"),
    )


def classify(v: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Vouchers with primary_group, involved, involved_groups (joined), group_count, classify_type and is_cross_group.

    Each voucher is classified where it is: a join by feature would send the commonest one to one task.
    """
    of = v.drop("primary_group", "involved", "classify_type", "involved_groups", "group_count", "is_cross_group")
    # in steps, as columns: one expression would look for every group's words again wherever it asks for them
    of = of.withColumn("_subjects", S.split_subjects(F.col("feature"))).withColumn("_valid", _valid(F.col("_subjects"), s)).withColumn("_hits", _hits(F.col("_valid"), s))
    of = of.withColumn("_involved", _involved(F.col("_valid"), F.col("_hits")))
    known = of.withColumn("_g", _group(*map(F.col, ("_subjects", "_valid", "_hits", "_involved")))).select("*", "_g.*").drop("_g", "_subjects", "_valid", "_hits", "_involved")
    return known.withColumns({"involved_groups": S.join_subjects(F.col("involved")), "group_count": F.size("involved"), "is_cross_group": F.size("involved") > 1})


def group_distribution(c: DataFrame) -> DataFrame:
    return c.groupBy("primary_group").agg(F.count("*").alias("n_vouchers"), F.countDistinct("feature").alias("n_features"))


def involved_counts(c: DataFrame) -> DataFrame:
    """Vouchers that each group takes part in; those of several groups count in each."""
    return c.select(F.explode("involved").alias("g")).groupBy("g").agg(F.count("*").alias("n"))


def combination_counts(c: DataFrame) -> DataFrame:
    """Vouchers of each exact set of two groups and more."""
    return c.where("is_cross_group").groupBy(F.array_sort("involved").alias("combination")).agg(F.count("*").alias("n"))


def feature_detail(c: DataFrame) -> DataFrame:
    return c.groupBy("feature", "primary_group", "is_cross_group", "involved_groups").agg(F.count("*").alias("n_vouchers"))


def feature_detail_head(c: DataFrame, group: str | None = None, n: int = 100) -> DataFrame:
    """The n most frequent features (of one group, if it is named), with 是 or 否 for vouchers across groups."""
    detail = feature_detail(c if group is None else c.where(F.col("primary_group") == group))
    first = detail.orderBy(F.desc("n_vouchers"), "feature").limit(n)
    return first.select("feature", "primary_group", "involved_groups", F.when(F.col("is_cross_group"), "是").otherwise("否").alias("cross_group"), "n_vouchers")
