"""Best-fit-decreasing packing of documents' ids into windows of at most `window` ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import release, slices, table, texts
from kindred.llm.tokenizer import default_path, encoder
from kindred.sources.scratch import materialize

WINDOW = 1024
#: Consecutive documents of a mix that are packed together.
STRETCH_DOCS = 2048
PIECE = "split long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local_rank long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Segment tree over remaining capacities 0..size: how many runs of windows are open at each."""

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.count = [0] * (2 * self.n)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.n
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, least: int) -> int:
        """The smallest open capacity >= least, or -1."""
        i = least + self.n
        if self.count[i]:
            return least
        while i > 1:  # up to the first right sibling with anything open, then down its left edge
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return -1


def plan(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Best-fit decreasing for counts[length] items of each length; rows (length, first rank, last rank + 1, first window, items a window, offset).

    Items of one length are alike, so runs of windows in the same state move together: the
    work and the rows depend on `window`, not on the number of items. The item of rank k
    in a row goes to window first + (k - first rank) // items, at offset + remainder * length.
    """
    tree, open_runs, rows, windows = CapacityTree(window), {}, [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_runs.setdefault(capacity, []).append((first, n))
            tree.add(capacity, 1)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity < 0:  # nothing fits: new windows, each filled with as many as it takes
                capacity = window
                first, n = windows, -(-left // (window // length))
                windows += n
            else:
                first, n = open_runs[capacity].pop()
                tree.add(capacity, -1)
            each = capacity // length  # a window that took one is the tightest for the next, while it fits
            full = min(n, left // each)
            if full:
                rows.append((length, rank, rank + full * each, first, each, window - capacity))
                put(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                rows.append((length, rank, rank + left, first + full, left, window - capacity))
                put(capacity - left * length, first + full, 1)
                full, left = full + 1, 0
            put(capacity, first + full, n - full)
    return np.array(rows, np.int64).reshape(-1, 6)


def _pieces(batches, tokenizer: str, window: int) -> Iterator[pa.RecordBatch]:
    split, enc, seen = TaskContext.get().partitionId(), encoder(tokenizer), np.zeros(window + 1, np.int64)
    for part in slices(batches):
        ids, off = enc.encode(texts(part))
        data = ids.astype("<u4", copy=False).tobytes()
        n = np.diff(off)
        per = -(-n // window)  # full windows, then what is left
        doc = np.repeat(np.arange(len(n)), per)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * window
        length = np.minimum(window, n[doc] - start)
        at = off[doc] + start
        crc = np.fromiter((zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())), np.int64, len(doc))
        order = np.argsort(length, kind="stable")
        by = np.bincount(length, minlength=window + 1)
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.arange(len(doc)) - np.repeat(np.cumsum(by) - by, by)
        rank += seen[length]
        seen += by
        carried = [c for c in ("position",) if c in part.schema.names]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), split)), part.column("doc_id").cast(pa.int64()).take(pa.array(doc)), *map(pa.array, (start, length, crc, n[doc], rank)), *(part.column(c).take(pa.array(doc)) for c in carried)], ["split", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "local_rank", *carried])
    enc._forget()  # the worker may serve another operator next
    release()


def _place(batches, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    key = (rows[:, 0] << 44) + rows[:, 1]  # rows by length and rank
    order = np.argsort(key)
    key, rows = key[order], rows[order]
    for batch in batches:
        col = {name: batch.column(name) for name in batch.schema.names}
        length, rank = (col[x].to_numpy(zero_copy_only=False) for x in ("length", "rank"))
        row = rows[np.searchsorted(key, (length << 44) + rank, "right") - 1]
        each, k = row[:, 4], rank - row[:, 1]
        yield pa.RecordBatch.from_arrays([*(col[x] for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(row[:, 3] + k // each), pa.array(row[:, 5] + k % each * length)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """Every document's ids (and the end id 0), in pieces with the sequence and offset of each.

    Documents longer than a window are first cut into full windows and a rest. Best-fit
    decreasing runs on the number of pieces of each length (1 to `window`: a table whose size
    does not depend on the data) and gives each piece its place by its rank among those of its
    length: local rank in its split, plus the pieces of that length in earlier splits. Null texts
    are empty (one piece: the end id), null and repeated ids stay as rows of their own, other
    columns are not read, and an empty table gives no rows.
    """
    from pyspark.sql import Window

    tokenizer = tokenizer or default_path()
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(lambda b: _pieces(b, tokenizer, window), PIECE), "pieces")
    counts = pieces.groupBy("split", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("split").alias("s"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows = plan({r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}, window)
    ranked = pieces.join(base, (F.col("split") == F.col("s")) & (F.col("length") == F.col("l"))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("local_rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(lambda b: _place(b, rows), PACKED)


def _pack_stretch(found: pa.Table, window: int) -> pa.Table:
    """Best-fit decreasing for the pieces of one stretch; sequence_id counts from 0 in it."""
    length, position, start = (found.column(c).to_numpy() for c in ("length", "position", "start"))
    order = np.lexsort((start, position, length))
    by = np.bincount(length, minlength=window + 1)
    rank = np.empty(len(length), np.int64)
    rank[order] = np.arange(len(length)) - np.repeat(np.cumsum(by) - by, by)
    rows = plan({int(x): int(by[x]) for x in np.flatnonzero(by)}, window)
    batch = found.append_column("rank", pa.array(rank)).combine_chunks().to_batches()
    return pa.Table.from_batches(_place(batch, rows)).append_column("stretch", found.column("stretch"))


def pack_in_order(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, stretch: int | None = None) -> DataFrame:
    """As pack, but sequences follow the column `position` (from 0, gapless), as mix gives it.

    Each `stretch` of consecutive documents is packed by itself and its sequences come after those of
    the stretches before, so sources have their shares in every run of whole stretches.
    """
    tokenizer, stretch = tokenizer or default_path(), stretch or STRETCH_DOCS
    pieces = docs.select("doc_id", "text", "position").mapInArrow(lambda b: _pieces(b, tokenizer, window), f"{PIECE}, position long")
    pieces = materialize(pieces.withColumn("stretch", F.expr(f"position div {stretch}")), "pieces")
    packed = materialize(pieces.groupBy("stretch").applyInArrow(lambda t: _pack_stretch(t, window), f"{PACKED}, stretch long"), "packed")
    ends = sorted((r.stretch, r.n) for r in packed.groupBy("stretch").agg((F.max("sequence_id") + 1).alias("n")).collect())
    before, bases = 0, []
    for s, n in ends:
        bases.append((s, before))
        before += n
    base = docs.sparkSession.createDataFrame(bases, "stretch long, base long")
    return packed.join(F.broadcast(base), "stretch").withColumn("sequence_id", F.col("sequence_id") + F.col("base")).drop("stretch", "base")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
