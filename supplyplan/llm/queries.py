"""The registered queries of the numbered operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_pairs, decontaminate, exact_dedup, hard_negatives, language, line_dedup, near_dedup, packing, personal_data, quality, spelling,
    substring_dedup, suffix_dedup,
)
from .statements import STATEMENTS


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.substring_dedup(_documents(spark, folder)).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    model = quality.fit(docs, quality.graded(spark.read.parquet(f"{folder}/labels.parquet")))
    return quality.score(docs, model).withColumn("keep", F.col("p_best") >= quality.KEEP)


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{folder}/documents.parquet").withColumnRenamed("digest", "text_sha256")


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    found = line_dedup.linked_lines(docs)
    lines = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.nullif("doc", F.lit(line_dedup.NO_ID))), "left")
    return lines.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
                        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
                        F.coalesce("removed", F.expr("array()")).alias("removed"),
                        F.coalesce("linked", F.expr("array()")).alias("linked"))


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    return language.predict(docs, language.fit(docs))


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.best_fit_packing(_documents(spark, folder))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_documents(spark, folder)).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), "kept_sha256")


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    return personal_data.personal_data(docs, personal_data.fit(docs))


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_dedup(_documents(spark, folder))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_groups(spelling.word_counts(_documents(spark, folder), mistype=199))


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    out = byte_pairs.decoded(byte_pairs.encoded(_documents(spark, folder)))
    return out.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_decontaminate, op3_quality, op4_exact_dedup, op5_line_dedup, op6_language,
                                     op7_best_fit_packing, op8_suffix_dedup, op9_personal_data, op10_near_dedup,
                                     op11_hard_negatives, op12_spelling_variants, op13_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in STATEMENTS.items() if name in queries()}
