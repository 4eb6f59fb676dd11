"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks. While the same sources have blocks left, block j of a source of weight w
(of all weights' sum s) may start at slot floor(j s / w) and must be done by ceil((j + 1) s / w);
of the blocks that may start, the one with the earliest deadline takes the slot. So after any number of slots
every source is less than one block away from its share. When a source ends, the others go on anew.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import helper, table
from kindred.sources.scratch import materialize

BLOCK_DOCS = 16
#: Weight of the largest source; the others' follow the square roots of their numbers of documents, so small sources count for more than their share.
MOST = 16
#: A source's documents that one bucket of hashes is made for.
BUCKET_DOCS = 1 << 13


def target_weights(counts: dict) -> dict:
    """Whole numbers from 1 to MOST, in proportion to the square roots of counts."""
    top = max(counts.values(), default=1)
    return {s: max(1, round(MOST * (n / top) ** 0.5)) for s, n in counts.items()}


def period(weights: dict) -> dict:
    """Slots of each source's blocks in the first sum(weights) slots, after which all repeats (every source has its exact share then)."""
    total, slots, ready = sum(weights.values()), {s: [] for s in weights}, []
    waiting = [(0, i, s, 0) for i, s in enumerate(sorted(weights, key=lambda s: (s is None, str(s))))]
    heapq.heapify(waiting)
    for now in range(total):
        while waiting and waiting[0][0] <= now:
            _, i, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), i, s, j))
        _, i, s, j = heapq.heappop(ready)
        slots[s].append(now)
        if j + 1 < weights[s]:
            heapq.heappush(waiting, ((j + 1) * total // weights[s], i, s, j + 1))
    return slots


@dataclass
class Lane:
    """Where a source's blocks go: phase k begins at block first[k] and slot start[k]."""

    first: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    total: list[int] = field(default_factory=list)
    slots: list[np.ndarray] = field(default_factory=list)

    def slot(self, block: np.ndarray) -> np.ndarray:
        out = np.empty(len(block), np.int64)
        phase = np.searchsorted(self.first, block, "right") - 1
        for k in np.unique(phase):
            own = phase == k
            j, at = block[own] - self.first[k], self.slots[k]
            out[own] = self.start[k] + j // len(at) * self.total[k] + at[j % len(at)]
        return out


def schedule(blocks: dict, weights: dict) -> dict[object, Lane]:
    """Lanes for `blocks[source]` blocks each; its work and size depend on the sources, not on the blocks."""
    lanes, done, now = {s: Lane() for s in blocks}, dict.fromkeys(blocks, 0), 0
    left = [s for s in blocks if blocks[s]]
    while left:
        slots = {s: np.array(x) for s, x in period({s: weights[s] for s in left}).items()}
        total = sum(weights[s] for s in left)
        last = {}
        for s in left:
            q, r = divmod(blocks[s] - done[s] - 1, len(slots[s]))
            last[s] = q * total + int(slots[s][r])
            lane = lanes[s]
            lane.first.append(done[s])
            lane.start.append(now)
            lane.total.append(total)
            lane.slots.append(slots[s])
        length = min(last.values()) + 1
        for s in left:
            done[s] += length // total * len(slots[s]) + int(np.searchsorted(slots[s], length % total, "left"))
        now += length
        left = [s for s in left if done[s] < blocks[s]]
    return lanes


def _slots(batches, lanes: dict, counts: dict, block: int, columns: list[str], p: str) -> Iterator[pa.RecordBatch]:
    short = sorted((int(lanes[s].slot(np.array([-(-n // block) - 1]))[0]), -n % block) for s, n in counts.items() if n % block)
    at, missing = np.array([a for a, _ in short], np.int64), np.concatenate([[0], np.cumsum([m for _, m in short])]).astype(np.int64)
    for batch in batches:
        source, rank = batch.column(f"{p}source").to_pylist(), batch.column(f"{p}rank").to_numpy(zero_copy_only=False)
        number, slot = rank // block, np.empty(len(rank), np.int64)
        by: dict = {}
        for i, s in enumerate(source):
            by.setdefault(s, []).append(i)
        for s, rows in by.items():
            slot[rows] = lanes[s].slot(number[rows])
        position = slot * block + rank % block - missing[np.searchsorted(at, slot, "left")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(number), pa.array(slot), pa.array(position)], [*columns, "block", "slot", "position"])


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK_DOCS, keep: list[str] | None = None) -> DataFrame:
    """All rows of docs with block (of the source), slot and position (from 0, gapless) in the mix.

    Without weights, target_weights() of the numbers of documents; with them, a source that has none has 1. Of docs'
    columns those in `keep` are returned (all, if not given); texts not among them are hashed where they are read.

    A source's documents come in the order of a hash of id and text (then id). Documents without
    a source form one of their own. Rank in a source is counted per bucket of hashes and summed over
    buckets, so the largest source is spread like any other. Columns of docs named block, slot or position are
    left out. An empty table gives no rows.
    """
    from pyspark.sql import Window

    spark = docs.sparkSession
    columns = [c for c in (docs.columns if keep is None else keep) if c not in ("block", "slot", "position")]
    bits = max(3, (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length(), (docs.count() // BUCKET_DOCS).bit_length())
    p = helper(docs.columns)
    source = F.struct("source")  # so that null is a group like others
    keyed = docs.select(*dict.fromkeys([*columns, "doc_id", "source"]), F.xxhash64("doc_id", "text").alias(f"{p}h")).withColumn(f"{p}b", F.shiftrightunsigned(f"{p}h", 64 - bits))
    # only the key columns are read for these counts
    counted = materialize(keyed.groupBy("source", f"{p}b").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("source").orderBy(f"{p}b").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select(F.col("source").alias(f"{p}s"), F.col(f"{p}b").alias(f"{p}bb"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{p}base"))
    counts = {r.source: r.n for r in counted.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    given = target_weights(counts) if weights is None else {s: max(1, int(weights.get(s, 1))) for s in counts}
    lanes = schedule({s: -(-n // block) for s, n in counts.items()}, given)
    local = F.row_number().over(Window.partitionBy(source, f"{p}b").orderBy(f"{p}h", "doc_id")) - 1
    ranked = keyed.withColumn(f"{p}local", local).join(base, keyed["source"].eqNullSafe(F.col(f"{p}s")) & (keyed[f"{p}b"] == F.col(f"{p}bb"))).withColumn(f"{p}rank", F.col(f"{p}local") + F.col(f"{p}base")).withColumn(f"{p}source", F.col("source"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in columns)
    return ranked.select(*columns, f"{p}source", f"{p}rank").mapInArrow(lambda b: _slots(b, lanes, counts, block, columns, p), f"{schema}, block long, slot long, position long")


def in_order(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK_DOCS, position: bool = False) -> DataFrame:
    """docs in the order of the mix: partitions by range of position, sorted within. The order is only sure to outlast a write with `position` as a column."""
    mixed = mix(docs, weights, block)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [c for c in docs.columns if c in mixed.columns and c not in ("block", "slot", "position")]
    return mixed.repartitionByRange(n, "position").sortWithinPartitions("position").select(*columns, *(["position"] if position else []))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, keep=["doc_id", "source"]).select("doc_id", "source", "block", "slot", "position")
