"""The pipeline over documents: classifier, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next one's
documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyplan.llm import decontaminate, line_dedup, near_dedup, packing, quality
from supplyplan.llm.scratch import stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade reaches the classifier's limit; the others go."""
    model = quality.fit(docs, quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.select_good(docs, model)


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat, up to the edit threshold, a line before; emptied documents go."""
    return line_dedup.line_dedup(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.keep_first(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the benchmark's windows cover less than a twentieth, unchanged; the others go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents that are left, with its place in a sequence."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", first_lines),
    ("near-duplicates", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("best-fit packing", packed_sequences),
]

#: the classifier, the alignment and the tokenizer can't be said in SQL; tests hold every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
