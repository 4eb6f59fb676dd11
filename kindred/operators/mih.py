"""Near keys by multi-index hashing: keys meet by aligned bytes or blocks of bits, then by the Hamming distance."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.bits import BANDS, band
from kindred.operators import blocks as meet

RADIUS, MIN_VOTES, THRESHOLD = 10, 2, 0.85
#: Pairs of a group up to which it is compared together with others, and pairs that are then compared at once.
FEW, AT_ONCE = 1 << 16, 1 << 19


def bands(keys: DataFrame, n: int = 8) -> DataFrame:
    """One row of each byte of each key: (algo, band, byte) and the columns of keys."""
    return keys.select("*", F.posexplode(F.array(*[band(F.col("key"), i) for i in range(n)])).alias("band", "byte"))


def cuts(n: int) -> list[int]:
    """Where n blocks of bits, as even as 64 allows, begin, and 64."""
    return [64 * i // n for i in range(n + 1)]


def dealt(keys: DataFrame, n: int, slack: int) -> DataFrame:
    """(algo, band, byte, guest, key): one row of each of n blocks of bits; with a slack of 1 also as a guest of the smaller blocks one bit off.

    Two keys that differ in n (slack + 1) - 1 bits at most share a block, or one is a guest where the other is at home.
    """
    at = cuts(n)
    value = [F.shiftrightunsigned(F.col("key"), a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(at, at[1:])]
    place = lambda i, v, guest: F.struct(F.lit(i).alias("band"), v.cast("long").alias("byte"), F.lit(guest).alias("guest"))
    places = F.array(*[place(i, v, False) for i, v in enumerate(value)])
    if slack:
        off = [F.when(F.getbit("key", F.lit(a + k)) == 1, place(i, v.bitwiseXOR(F.lit(1 << k)), True)) for i, (v, a, b) in enumerate(zip(value, at, at[1:])) for k in range(b - a)]
        places = F.concat(places, F.array_compact(F.array(*off)))
    return keys.select("algo", "key", F.explode(places).alias("p")).select("algo", "p.band", "p.byte", "p.guest", "key")


def _met(keys: np.ndarray, guest: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of a group within the radius, by groups that lie side by side, those at home first; guests don't meet each other."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    own = np.add.reduceat(~guest, start, dtype=np.int64)
    few = size * own <= FEW
    # each at home in a small group with those after it, side by side for many groups at once
    home = np.flatnonzero(np.repeat(few, size) & ~guest)
    after = np.repeat(start + size, size)[home] - home - 1
    total = np.cumsum(after)
    part = np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, AT_ONCE))
    for a, b in zip(part, [*part[1:], len(home)]):
        left, n = home[a:b], after[a:b]
        x = np.repeat(left, n)
        y = np.arange(len(x)) + np.repeat(left + 1 - (np.cumsum(n) - n), n)
        near = np.flatnonzero(np.bitwise_count(keys[x] ^ keys[y]) <= radius)
        yield x[near], y[near]
    for s, n, h in zip(start[~few], size[~few], own[~few]):
        for a in range(0, h, meet.STRIP):
            for b in range(a, n, meet.ROWS):
                r, c = meet.where(meet.distance(keys[s + a : s + min(h, a + meet.STRIP)], keys[s + b : s + min(n, b + meet.ROWS)]) <= radius)
                later = a + r < b + c
                yield s + a + r[later], s + b + c[later]


def near_keys(keys: DataFrame, radius: int = RADIUS, complete: bool = False) -> DataFrame:
    """(algo, a, b): pairs of distinct keys of an algorithm that differ in radius bits at most, a key with itself included.

    They must also share an aligned byte, which above a radius of 7 is part of what is asked for; `complete` drops
    that condition and finds all by blocks of bits. Images are joined on only afterwards, so a key that many images
    have is probed once. Keys are dealt out by block; a worker measures the pairs of a block as they come and hands on those within
    the radius, each from the first block that brings it about. The rows are few bytes and much work, so they are dealt out
    by a number of partitions that the adaptive planner leaves as it is.
    """
    own = keys.select("algo", "key").where("key is not null").distinct()
    spark = keys.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    # up to 7, radius + 1 blocks find all, are wider than bytes and so meet fewer keys; far apart, half as many with a bit off do with fewer pairs still
    slack = int(complete and radius >= 8)
    parts = BANDS if not complete and radius >= 7 else max(2, radius // (slack + 1) + 1)
    at = cuts(parts)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if held is None or not len(held):
                continue
            algo, band, byte, guest, key = (held.column(x).combine_chunks() for x in ("algo", "band", "byte", "guest", "key"))
            coded = algo.dictionary_encode() if isinstance(algo, pa.Array) else algo.chunk(0).dictionary_encode()
            code, band, byte, guest, key = coded.indices.to_numpy(zero_copy_only=False), band.to_numpy(), byte.to_numpy(), guest.to_numpy(zero_copy_only=False), key.to_numpy().view(np.uint64)
            new = np.flatnonzero((code[1:] != code[:-1]) | (band[1:] != band[:-1]) | (byte[1:] != byte[:-1])) + 1
            end = len(key) if batch is None else int(new[-1]) if len(new) else 0  # the last group may go on
            if end:
                group = np.zeros(end, np.int64)
                group[new[new < end]] = 1
                for r, c in _met(key[:end], guest[:end], group.cumsum(), radius):
                    off = key[r] ^ key[c]
                    first = np.ones(len(r), bool)
                    for m in range(parts):
                        same = np.bitwise_count((off >> np.uint64(at[m])) & np.uint64((1 << (at[m + 1] - at[m])) - 1)) <= slack
                        first &= ~same | (m >= band[r])
                    r, c = r[first], c[first]
                    if len(r):
                        x, y = key[r].view(np.int64), key[c].view(np.int64)
                        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[r])), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["algo", "a", "b"])
                held = held.slice(end)

    rows = dealt(own, parts, slack).repartition(n, "algo", "band", "byte").sortWithinPartitions("algo", "band", "byte", "guest")
    found = rows.mapInArrow(step, "algo string, a long, b long")
    same = own.select("algo", F.col("key").alias("a"), F.col("key").alias("b"))
    both = found.select("algo", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("algo", "p.a", "p.b")  # once through the workers
    return both.union(same)


def votes(keys: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(i, j, votes): i < j, and how many algorithms bring a key of i near one of j."""
    owners = keys.select("image_id", "algo", "key").distinct()
    near = near_keys(keys, radius)
    left = owners.select(F.col("image_id").alias("i"), "algo", F.col("key").alias("a"))
    right = owners.select(F.col("image_id").alias("j"), "algo", F.col("key").alias("b"))
    met = left.join(near, ["algo", "a"]).join(right, ["algo", "b"]).where("i < j")
    return met.groupBy("i", "j").agg(F.countDistinct("algo").alias("votes"))


def candidates(keys: DataFrame, radius: int = RADIUS, min_votes: int = MIN_VOTES) -> DataFrame:
    return votes(keys, radius).where(F.col("votes") >= min_votes)


def confirmed(keys: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(i, j, score): pairs whose best similarity over all algorithms and orientations reaches the threshold."""
    packed = keys.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("algo", "variant_idx", "key"))).alias("s"))
    left = packed.select(F.col("image_id").alias("i"), F.col("s").alias("x"))
    right = packed.select(F.col("image_id").alias("j"), F.col("s").alias("y"))
    best = F.expr("array_max(flatten(transform(x, p -> transform(filter(y, r -> r.algo = p.algo), r -> 1 - bit_count(p.key ^ r.key) / 64.0D))))")
    return pairs.join(left, "i").join(right, "j").select("i", "j", best.cast("double").alias("score")).where(F.col("score") >= threshold)


def similar(keys: DataFrame, threshold: float) -> DataFrame:
    """All pairs a < b by the similarity of one key each: every pair is measured, by blocks in files, as the query asks for every pair. Null ids and keys take no part."""
    spark = keys.sparkSession
    kind = dict(keys.dtypes)["vec_id"]
    files = meet.stored(keys.select(F.col("vec_id").cast("long").alias("vec_id"), "key").where("vec_id is not null and key is not null"), "keys", "vec_id")
    most = max((d for d in range(65) if 1 - d / 64 >= threshold), default=-1)

    def work(tile: tuple) -> Iterator[list[np.ndarray]]:
        for x, y, same in meet.within(tile):
            for at in range(0, len(x["key"]), meet.STRIP):
                d = meet.distance(x["key"][at : at + meet.STRIP], y["key"])
                near = d <= most
                if same:
                    near &= x["vec_id"][at : at + meet.STRIP, None] < y["vec_id"]
                r, c = meet.where(near)
                a, b = x["vec_id"][at + r], y["vec_id"][c]
                keep = a != b
                yield [np.minimum(a, b)[keep], np.maximum(a, b)[keep], d[r, c].astype(np.int32)[keep]]

    met = meet.each(spark, meet.tiles(files, meet.parallelism(spark)), work, "a long, b long, hamming int")
    return met.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "hamming", (1 - F.col("hamming") / F.lit(64.0)).alias("similarity"))
