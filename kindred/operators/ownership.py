"""Shards of keys, the nodes that own them, dense slots and fingerprints of what an index was built of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 256


def even_ranges(n: int, nodes: int) -> list[tuple[int, int]]:
    """Contiguous [start, end) of n shards for each node; the first ones get what is left over."""
    if nodes < 1:
        raise ValueError("at least one node")
    size, rest = divmod(n, nodes)
    out, start = [], 0
    for i in range(nodes):
        out.append((start, start + size + (i < rest)))
        start = out[-1][1]
    return out


def validate(ranges: list[tuple[int, int]], n: int = SHARDS) -> None:
    """Ranges must tile 0 to n without a gap or overlap."""
    if [a for a, _ in ranges] + [n] != [0] + [b for _, b in ranges] or any(a > b for a, b in ranges):
        raise ValueError("the ranges do not tile the shards")


def owner_of(shard: Column, ranges: list[tuple[int, int]]) -> Column:
    validate(ranges, ranges[-1][1])
    return F.coalesce(*[F.when((shard >= a) & (shard < b), i) for i, (a, b) in enumerate(ranges)])


def probe_fanout(shards: DataFrame, radius: int) -> DataFrame:
    """(algo, shard, n_probed): the occupied shards that a key of a shard has to look into. shards is (algo, shard), at most 256 rows each."""
    a, b = shards.select("algo", "shard"), shards.select("algo", F.col("shard").alias("other"))
    return a.join(b, "algo").where(F.bit_count(F.col("shard").bitwiseXOR(F.col("other"))) <= radius).groupBy("algo", "shard").agg(F.count("*").alias("n_probed"))


def dense_slots(ids: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """(key, slot): the rank of distinct integer ids from 0. Ids are ranked within ranges of `width`; only the ranges' sizes are summed up in one place."""
    own = ids.select(key).distinct().withColumn("_r", F.floor(F.col(key) / width))
    sizes = own.groupBy("_r").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_r").orderBy(key)) - 1
    return own.withColumn("_k", inside).join(before, "_r").select(key, (F.col("_b") + F.col("_k")).alias("slot"))


def fingerprint(rows: DataFrame, line: Column) -> DataFrame:
    """(algo, n_rows, fingerprint): a sum of 32-bit digests of the rows, whatever their order and place."""
    part = F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")
    return rows.select("algo", part.alias("p")).groupBy("algo").agg(F.count("*").alias("n_rows"), F.sum("p").alias("fingerprint"))
