"""Exact deduplication (operator 4): a stream into keyed state that never expires.

The stream of documents meets state keyed by content digest and kept in RocksDB on disk. Per digest it holds
the stable identifier (largest doc_id), the content locator (file and row of that document) and a count; there
is no watermark, so nothing expires. Map-side partial aggregation puts one row per digest and task into the
state, however many copies a text has. Every hit (a digest seen more than once) is checked on its full bytes
against the text at the locator; digests shared by different texts are then grouped by text.

Defined results: a null text counts as empty, a null doc_id ranks below every other; of rows that repeat a doc_id
with the same text the last by file and row stays; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_folder, stored

_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # else every instance reserves megabytes of disk for a manifest of a few hundred bytes
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _located(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", body.alias("body"), digest(body).alias("digest"),
        F.struct(F.col("doc_id").alias("id"), F.col("_metadata.file_path").alias("file"),
                 F.col("_metadata.row_index").alias("row")).alias("at"))


def digest_state(spark: SparkSession, source: str, digest: Callable[[Column], Column] = sha256,
                 files_per_batch: int = 1000) -> DataFrame:
    """Run all files under `source` through the state: (digest, keeper, n), one row per digest.

    A trigger takes at most `files_per_batch` files; the state carries over from batch to batch.
    """
    source = source.rstrip("/")
    before = {k: spark.conf.get(k, None) for k in _STATE}
    updates = new_folder(spark, "exact-updates")
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        stream = (spark.readStream.schema(spark.read.parquet(source).schema)
                  .option("maxFilesPerTrigger", files_per_batch)
                  .parquet(f"{source[:-1]}[{source[-1]}]"))  # as a pattern, it may name a file or a folder
        state = _located(stream, digest).groupBy("digest").agg(
            F.max("at").alias("keeper"), F.count(F.lit(1)).alias("n"))
        query = (state.writeStream.outputMode("update").trigger(availableNow=True)
                 .option("checkpointLocation", new_folder(spark, "exact-state"))
                 .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{updates}/batch={batch}"))
                 .start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not _exists(spark, updates):
        return spark.createDataFrame([], state.schema)
    return spark.read.schema(state.schema).parquet(updates).groupBy("digest").agg(
        F.max_by("keeper", "n").alias("keeper"), F.max("n").alias("n"))


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def exact_dedup(spark: SparkSession, source: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest."""
    state = stored(digest_state(spark, source, digest), "exact-digests")
    docs = _located(spark.read.parquet(source), digest)
    # the hits, with their bytes; shuffled by digest so that a heavy digest can be split by adaptive execution
    hits = stored(docs.join(state.filter("n > 1"), "digest"), "exact-hits")
    first = hits.filter(F.col("at").eqNullSafe(F.col("keeper"))).select("digest", F.col("body").alias("first"))
    # no aggregate above this join, so that adaptive execution may split a heavy digest
    collided = stored(hits.join(first, "digest").filter("body <> first").select("digest"), "exact-collided").distinct()
    plain = docs.drop("body").join(state, "digest")
    columns = ["doc_id", F.col("keeper.id").alias("keep_id"), F.col("n").alias("group_size"),
               F.col("at").eqNullSafe(F.col("keeper")).alias("kept"), "digest"]
    if collided.isEmpty():
        return plain.select(*columns)
    apart = hits.drop("keeper", "n").join(collided, "digest", "left_semi")
    groups = apart.groupBy("digest", "body").agg(F.max("at").alias("keeper"), F.count(F.lit(1)).alias("n"))
    return plain.join(collided, "digest", "left_anti").select(*columns).unionByName(
        apart.join(groups, ["digest", "body"]).select(*columns))
