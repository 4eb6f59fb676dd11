"""Index bundles: Parquet of signatures beside what they were built of; a stale bundle is built anew."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from kindred.operators.ownership import fingerprint

VERSION = 1


def _stamp(rows: DataFrame, line: Column, settings: str) -> DataFrame:
    return fingerprint(rows, line).withColumn("version", F.lit(VERSION)).withColumn("settings", F.lit(settings))


def load_or_build(spark: SparkSession, path: str, source: DataFrame, line: Column, build: Callable[[DataFrame], DataFrame], settings: str = "") -> tuple[DataFrame, bool]:
    """(bundle, whether it was loaded). source has `algo`; `line` is the text of a row that counts for the fingerprint.

    The stamp is written after the rows, so a build that was cut off leaves none and is built anew. Rows go to a folder
    of their own by stamp, so readers of an earlier bundle keep their files.
    """
    now = sorted(map(tuple, _stamp(source, line, settings).collect()))  # one row an algorithm
    digest = format(hash_of(now), "016x")
    at = f"{path}/{digest}"
    try:
        if sorted(map(tuple, spark.read.parquet(f"{at}/stamp").collect())) == now:
            return spark.read.parquet(f"{at}/rows"), True
    except AnalysisException:
        pass  # no stamp there
    build(source).write.mode("overwrite").parquet(f"{at}/rows")
    spark.createDataFrame(now, "algo string, n_rows long, fingerprint long, version int, settings string").coalesce(1).write.mode("overwrite").parquet(f"{at}/stamp")
    return spark.read.parquet(f"{at}/rows"), False


def hash_of(stamp: list[tuple]) -> int:
    return int.from_bytes(hashlib.sha256(repr(stamp).encode()).digest()[:8], "big")
