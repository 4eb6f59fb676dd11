"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark then removes a query's shuffle files when the query has ended; a written table needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to a Python worker at once while a table is written: long texts and arrays come in smaller batches.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
#: Bytes that go to a Python worker at once (a longer row ends its batch), and rows that a scan of Parquet holds at once, after small_batches().
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20, "spark.sql.parquet.columnarReaderBatchSize": 1024}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master, whose tasks share the machine, gets one of its own if there is none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        found = f"{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI that executors can all reach."""
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends if discard() has not done so before."""
    path = f"{shared_dir(spark)}/kindred/{uuid.uuid4().hex}/{name}"
    fs, at = _hadoop(spark, path)
    fs.mkdirs(at.getParent())
    fs.deleteOnExit(at.getParent())
    return path


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows on in small batches, so executors and their Python workers take less memory; smaller settings stay.

    It holds beyond the call, as a table that a caller writes later is planned only then. No result depends on it.
    """
    for key, most in SMALL.items():
        if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))) > most:
            spark.conf.set(key, most)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    It cuts the lineage: a lost executor costs a re-read of files that every
    other executor sees, never the work that made them. So the shuffle files of the writing query go.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), {k: spark.conf.get(k, v) for k, v in ((CLEANUP, "false"), (BATCH, "10000"))}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, min(BATCH_ROWS, int(before[BATCH])) if int(before[BATCH]) > 0 else BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() made and that nothing not yet written depends on."""
    for df in tables:
        if path := getattr(df, "scratch", None):
            fs, at = _hadoop(df.sparkSession, path)
            fs.delete(at.getParent(), True)
