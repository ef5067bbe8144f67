"""The queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import chat, compression, embeddings, licences, minhash, mixing, packing, passages, personal, resampling, text_rules, token_files, vector_codes
from ledgerloom.llm.common import table


def op1_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.domains(table(spark, sf_dir, "labels")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return text_rules.judge(docs, text_rules.fit(docs, table(spark, sf_dir, "labels")))


def op4_itq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.deduplicate(table(spark, sf_dir, "embeddings"))


def op5_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compression.score_documents(docs, compression.fit(docs, table(spark, sf_dir, "labels")))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_recurring(table(spark, sf_dir, "documents"))


def op7_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).drop("expressions")


def op9_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_files(token_files.write_files(table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_weighted_minhash, op2_soft_mixing, op3_quality_rules, op4_itq_near_duplicates, op5_compression_classifier, op6_repeated_passages, op7_swap_packing, op8_license_scan, op9_chat_perspectives, op10_personal_data, op11_target_resampling, op12_token_files, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op9_chat_perspectives": chat.ORACLE_SQL}
