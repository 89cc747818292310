"""Small files that are created once, with their whole text, or not at all.

What many writers must agree on (the next id, the next version of a ledger) is the name of a file: only one of them can
create it. Needs a file system in which creating a name is atomic, by link or by rename.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one of spark.checkpoint.dir; in a temporary one where that is unset and the session is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="supplyplan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored_once(df: DataFrame, name: str) -> DataFrame:
    """A frame that several jobs read, written to the work folder; as it is where the session has no such folder."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local["):
        return df
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: drops the shuffle files of a plan once it has run
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside leave no shuffle files behind; for plans that are not run again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _resolved(spark: SparkSession, path: str):
    """Hadoop's path and file system, and the local path where there is one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return where, system, where.toUri().getPath() if system.getUri().getScheme() == "file" else None


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its text; False if the name is taken. No reader sees a part of it."""
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    where, system, local = _resolved(spark, path)
    if local:
        draft = os.path.join(os.path.dirname(local), os.path.basename(draft))
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(draft, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    source = spark._jvm.org.apache.hadoop.fs.Path(draft)
    out = system.create(source)
    out.write(bytearray(text, "utf-8"))
    out.close()
    made = system.rename(source, where)
    if not made:
        system.delete(source, False)
    return made


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder, drafts left out; none if there is no folder."""
    where, system, _ = _resolved(spark, folder)
    found = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
    return sorted(n for n in found if not n.startswith("."))


def read_text(spark: SparkSession, path: str) -> str:
    where, system, _ = _resolved(spark, path)
    stream = system.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder; one that is gone already is no error."""
    where, system, _ = _resolved(spark, path)
    system.delete(where, True)
