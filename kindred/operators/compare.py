"""Compare by one algorithm, and by agreement of several."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.bits import hamming
from kindred.operators import blocks
from kindred.operators.grouping import members
from kindred.operators.mih import near_keys

THRESHOLD, SMART_THRESHOLD, MIN_AGREE = 0.85, 0.92, 3


def radius_of(threshold: float) -> int:
    """The most differing bits whose similarity 1 - d/64 reaches the threshold."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie between 0 and 1")
    return floor(64 * (1 - threshold) + 1e-9)


def algorithm_pairs(keys: DataFrame, threshold: float) -> DataFrame:
    """(i, j, algo, score), i < j: the best similarity over orientations, for each algorithm that reaches the threshold.

    No pair of images is met that has no near keys; the key join finds all pairs within the radius.
    """
    near = near_keys(keys, radius_of(threshold), complete=True)
    owners = keys.select("image_id", "algo", "key").distinct()
    left = owners.select(F.col("image_id").alias("i"), "algo", F.col("key").alias("a"))
    right = owners.select(F.col("image_id").alias("j"), "algo", F.col("key").alias("b"))
    met = left.join(near, ["algo", "a"]).join(right, ["algo", "b"]).where("i < j")
    return met.groupBy("i", "j", "algo").agg((1 - F.min(hamming(F.col("a"), F.col("b"))) / F.lit(64.0)).alias("score"))


def same_orientation_pairs(keys: DataFrame, threshold: float) -> DataFrame:
    """(i, j, algo, score), i < j: like algorithm_pairs, but an orientation is held against the same one only."""
    near = near_keys(keys, radius_of(threshold), complete=True)
    left = keys.select(F.col("image_id").alias("i"), "algo", "variant_idx", F.col("key").alias("a"))
    right = keys.select(F.col("image_id").alias("j"), "algo", "variant_idx", F.col("key").alias("b"))
    met = left.join(near, ["algo", "a"]).join(right, ["algo", "variant_idx", "b"]).where("i < j")
    return met.groupBy("i", "j", "algo").agg((1 - F.min(hamming(F.col("a"), F.col("b"))) / F.lit(64.0)).alias("score"))


def smart_votes(keys: DataFrame, gate: list[str], threshold: float = SMART_THRESHOLD) -> DataFrame:
    """(i, j, n_agree, algorithms, gated, score): what the algorithms that reach the threshold say of a pair."""
    hits = algorithm_pairs(keys, threshold)
    return hits.groupBy("i", "j").agg(F.count("*").alias("n_agree"), F.array_join(F.array_sort(F.collect_set("algo")), ",").alias("algorithms"), F.bool_or(F.col("algo").isin(gate)).alias("gated"), F.max("score").alias("score"))


def smart_confirmed(votes: DataFrame, min_agree: int = MIN_AGREE) -> DataFrame:
    return votes.where((F.col("n_agree") >= min_agree) & F.col("gated"))


def smart_groups(votes: DataFrame, min_agree: int = MIN_AGREE) -> DataFrame:
    """(group_id, n_images, members, confidence, algorithms): groups of confirmed pairs; all hits within a group count for the last two."""
    placed = members(smart_confirmed(votes, min_agree))
    listed = placed.groupBy("group_id").agg(F.count("*").alias("n_images"), F.array_join(F.array_sort(F.collect_list("image_id")).cast("array<string>"), ",").alias("members"))
    ends = votes.join(placed.select(F.col("image_id").alias("i"), "group_id"), "i").join(placed.select(F.col("image_id").alias("j"), F.col("group_id").alias("other")), "j").where("group_id = other")
    said = ends.select("group_id", "score", F.explode(F.split("algorithms", ",")).alias("algo")).groupBy("group_id").agg(F.max("score").alias("confidence"), F.array_join(F.array_sort(F.collect_set("algo")), ",").alias("algorithms"))
    return listed.join(said, "group_id")


def group_averages(keys: DataFrame, placed: DataFrame) -> DataFrame:
    """(group_id, n_images, avg_similarity): the mean over all pairs within a group, from the number of members that have each bit.

    A bit that c of n members have differs in c (n - c) pairs, so no pair is formed, however large the group.
    """
    bits = F.expr("transform(sequence(0, 63), b -> shiftrightunsigned(key, b) & 1)")
    each = placed.join(keys.select("image_id", "key"), "image_id").select("group_id", F.posexplode(bits).alias("bit", "on"))
    ones = each.groupBy("group_id", "bit").agg(F.sum("on").alias("c"), F.count("*").alias("n"))
    total = ones.groupBy("group_id").agg(F.max("n").alias("n_images"), F.sum(F.col("c") * (F.col("n") - F.col("c"))).alias("d"))
    pairs = F.col("n_images") * (F.col("n_images") - 1) / 2
    return total.select("group_id", "n_images", F.when(F.col("n_images") < 2, 1.0).otherwise(F.round(1 - F.col("d") / 64.0 / pairs, 4)).alias("avg_similarity"))


def report(images: DataFrame, placed: DataFrame) -> DataFrame:
    """One row: total_images, groups_count, duplicates, unique_count, duplicate_rate in percent."""
    counts = images.agg(F.count("*").alias("total_images")).crossJoin(placed.agg(F.count_distinct("group_id").alias("groups_count"), F.count("*").alias("duplicates")))  # one row each
    rate = F.when(F.col("total_images") > 0, F.round(100.0 * F.col("duplicates") / F.col("total_images"), 1)).otherwise(0.0)
    return counts.withColumn("unique_count", F.col("total_images") - F.col("duplicates")).withColumn("duplicate_rate", rate)


def similar_to(keys: DataFrame, probes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(probe_id, image_id, score, rank): up to n images most like each probe, by one key each; equal file_hash is left out. Both are (image_id, key, file_hash), nulls take no part.

    A task holds some probes with their best so far and reads all files of keys.
    """
    spark = keys.sparkSession
    kinds = dict(probes.dtypes)["image_id"], dict(keys.dtypes)["image_id"]
    whole = [x.select(F.col("image_id").cast("long").alias("image_id"), "key", "file_hash").dropna() for x in (keys, probes)]
    files, asked = blocks.stored(whole[0], "keys", "image_id"), blocks.stored(whole[1], "probes", "image_id", 32)
    most = max((d for d in range(65) if 1 - d / 64 >= threshold), default=-1)

    def work(file: blocks.File) -> Iterator[list[np.ndarray]]:
        mine = blocks.read(file)
        hashes = {h: k for k, h in enumerate(dict.fromkeys(mine["file_hash"].to_pylist()))}
        own = np.array([hashes[h] for h in mine["file_hash"].to_pylist()])
        at = range(0, len(own), blocks.STRIP)
        best = [blocks.Best(len(own[k : k + blocks.STRIP]), n) for k in at]
        for other in files:
            y = blocks.read(other)
            theirs = np.array([hashes.get(h, -1) for h in y["file_hash"].to_pylist()])
            for k, found in zip(at, best):
                d = blocks.distance(mine["key"][k : k + blocks.STRIP], y["key"])
                r, c = blocks.where(d <= np.minimum(most, -found.least)[:, None])
                keep = own[k + r] != theirs[c]
                r, c = r[keep], c[keep]
                found.offer(r, -d[r, c].astype(float), y["image_id"][c])
        for k, found in zip(at, best):
            r, rank, score, ids = found.ranked()
            yield [mine["image_id"][k + r], ids, 1 + score / 64, rank]

    near = blocks.each(spark, asked, work, "probe_id long, image_id long, score double, rank int")
    return near.withColumns({"probe_id": F.col("probe_id").cast(kinds[0]), "image_id": F.col("image_id").cast(kinds[1])})
