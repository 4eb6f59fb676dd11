"""Rows in files of the shared folder, for jobs in which every row meets every other: no pair of blocks is shuffled.

A task holds some files' rows and reads the others one after the other, so it takes as much memory whatever the number of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources.scratch import filesystem, scratch_path

#: Rows of a file at most; and at least, where more files would only give more tasks than there are cores.
ROWS, LEAST_ROWS = 4096, 512
#: Rows that are held against a file at once; files of a side of a tile at most; rows of a batch that a worker hands on.
STRIP, SIDE, BATCH = 512, 8, 1 << 17


class File(NamedTuple):
    first: int
    rows: int
    path: str


def parallelism(spark: SparkSession) -> int:
    return 4 * spark.sparkContext.defaultParallelism


def stored(rows: DataFrame, name: str, key: str, least: int = LEAST_ROWS) -> list[File]:
    """Writes the rows in files that ascend by the integer key, none longer than ROWS (equal keys can lie in several)."""
    spark, count = rows.sparkSession, rows.count()
    n = max(1, ceil(count / ROWS), min(parallelism(spark), ceil(count / least)))
    most, root = min(ROWS, max(1, ceil(1.25 * count / n))), scratch_path(spark, name)
    fs, path = filesystem(root)
    fs.create_dir(path, recursive=True)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(root)
        whole = pa.Table.from_batches(held) if (held := list(batches)) else None
        if whole is None or not len(whole):
            return
        whole, found = whole.sort_by(key), []
        for at in range(0, len(whole), most):
            part, file = whole.slice(at, most).combine_chunks(), f"{uuid.uuid4().hex}.arrow"
            with fs.open_output_stream(f"{path}/{file}") as out, pa.ipc.new_stream(out, part.schema) as to:
                to.write_table(part)
            found.append((part.column(key)[0].as_py(), len(part), f"{root}/{file}"))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], ["first", "rows", "path"])

    return sorted(File(*r) for r in rows.repartitionByRange(n, key).mapInArrow(step, "first long, rows long, path string").collect())


def read(file: File) -> dict[str, np.ndarray | pa.Array]:
    """Columns by name: numbers as numpy, arrays of floats as a matrix, of whole numbers as all elements and the row of each, others as Arrow."""
    fs, path = filesystem(file.path)
    with fs.open_input_stream(path) as f:
        whole = pa.ipc.open_stream(f).read_all().combine_chunks()
    out = {}
    for name, kind in zip(whole.column_names, whole.schema.types):
        col = whole.column(name).combine_chunks()
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
        if pa.types.is_list(kind) and pa.types.is_integer(kind.value_type):
            out[name] = col.flatten().to_numpy(), np.repeat(np.arange(len(col)), col.value_lengths().to_numpy())
        elif pa.types.is_list(kind):
            out[name] = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
        else:
            out[name] = col.to_numpy() if pa.types.is_integer(kind) or pa.types.is_floating(kind) else col
    return out


def each(spark: SparkSession, tasks: list, work: Callable[..., Iterator[list[np.ndarray]]], schema: str) -> DataFrame:
    """The rows that work(task) yields as columns, a Spark task for each of the tasks."""
    names = [x.split()[0] for x in schema.split(", ")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                for cols in work(tasks[at]):
                    for k in range(0, len(cols[0]), BATCH):
                        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + BATCH]) for c in cols], names)

    return spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(step, schema)


def tiles(files: list[File], at_least: int) -> list[tuple[list[File], list[File]]]:
    """Pairs of runs of files that cover each pair of files once; a run with itself is (run, run)."""
    side = max(1, min(SIDE, int(len(files) / (2 * at_least) ** 0.5)))
    runs = [files[k : k + side] for k in range(0, len(files), side)]
    return [(x, y) for k, x in enumerate(runs) for y in runs[k:]]


def within(tile: tuple[list[File], list[File]]) -> Iterator[tuple[dict, dict, bool]]:
    """Each pair of files of a tile once, and whether it is one file with itself."""
    left, right = tile
    rows = [read(f) for f in right]
    for k, x in enumerate(rows if left == right else map(read, left)):
        for m, y in enumerate(rows):
            if left != right or k <= m:
                yield x, y, left == right and k == m


class Best:
    """The k best (score, id) of each row so far: larger scores first, then smaller ids."""

    def __init__(self, rows: int, k: int):
        self.score, self.id = np.full((rows, k), -np.inf), np.full((rows, k), np.iinfo(np.int64).max)
        self.new, self.waiting = [], 0

    @property
    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, r: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keep = (score > self.least[r]) | ((score == self.least[r]) & (ids < self.id[r, -1]))
        self.new.append((r[keep], score[keep], ids[keep]))
        self.waiting += int(keep.sum())
        if self.waiting >= self.score.size // 2:
            self.merge()

    def merge(self) -> None:
        n, k = self.score.shape
        held = np.isfinite(self.score)
        parts = [(np.nonzero(held)[0], self.score[held], self.id[held]), *self.new]
        r, s, i = (np.concatenate([p[x] for p in parts]) for x in range(3))
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        place = np.arange(len(r)) - np.searchsorted(r, np.arange(n))[r]
        keep = place < k
        self.score[:], self.id[:] = -np.inf, np.iinfo(np.int64).max
        self.score[r[keep], place[keep]], self.id[r[keep], place[keep]] = s[keep], i[keep]
        self.new, self.waiting = [], 0

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, rank from 1, score and id of all that are held."""
        self.merge()
        r, c = np.nonzero(np.isfinite(self.score))
        return r, (c + 1).astype(np.int32), self.score[r, c], self.id[r, c]


def where(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true in a matrix, a row after the other."""
    flat = flags.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))  # eight flags at once, as few are true
    if len(words) > whole // 32:
        at = np.flatnonzero(flat)
    else:
        at = np.concatenate([(8 * words[:, None] + np.arange(8)).ravel(), np.arange(whole, len(flat))])
        at = at[flat[at]]
    return np.divmod(at, max(1, flags.shape[1]))


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distances of all keys of x and y, as bytes."""
    return np.bitwise_count(x[:, None] ^ y[None, :]) if x.dtype == np.uint64 else distance(x.view(np.uint64), y.view(np.uint64))
