"""Incremental near-key queries: each micro-batch meets all keys before it, then joins them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.bits import hamming
from kindred.operators.mih import RADIUS, bands


def prior_matches(batch: DataFrame, prior: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(image_id, prior_id, hamming): keys of earlier rows near those of the batch, and of smaller ids within it."""
    new = bands(batch.select("image_id", "algo", "key"))
    old = bands(prior.select("image_id", "algo", "key").union(batch.select("image_id", "algo", "key"))).select(F.col("image_id").alias("prior_id"), "algo", "band", "byte", F.col("key").alias("prior_key"))
    met = new.join(old, ["algo", "band", "byte"]).where("prior_id < image_id")
    return met.withColumn("hamming", hamming(F.col("key"), F.col("prior_key"))).where(F.col("hamming") <= radius).groupBy("image_id", "prior_id").agg(F.min("hamming").alias("hamming"))


def run_increments(stream: DataFrame, state_dir: str, out_dir: str, checkpoint: str, radius: int = RADIUS):
    """Write the matches of every micro-batch to out_dir; keys seen go to state_dir, one folder a batch, so a replayed batch overwrites its own."""

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.select("image_id", "algo", "key")
        before = [f"{state_dir}/epoch={e}" for e in range(epoch)]
        prior = spark.read.schema(batch.schema).parquet(*before) if before else batch.limit(0)
        prior_matches(batch, prior, radius).write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")
        batch.write.mode("overwrite").parquet(f"{state_dir}/epoch={epoch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
