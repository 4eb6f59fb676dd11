"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of an Arrow operator works on; a longer single text is one step. Arrays over its words or ids
#: take about 15 times as much.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def helper(columns: list[str]) -> str:
    """A prefix for names of helper columns that no column of the table has."""
    return "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in columns), default=0))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.StringArray:
    """The column with null as the empty text, its offsets starting at 0."""
    arr = batch.column(column)
    if arr.null_count:
        arr = arr.fill_null("")
    return arr


def release() -> None:
    """Give memory that this worker no longer uses back to the machine: a worker lives on when its task has ended."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `size` bytes of the column, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.diff(flat(texts(batch, column))[1]))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch
        release()


def flat(arr: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, offsets from 0."""
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[raw]


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: byte starts, byte ends, words in each text.

    Works on UTF-8, where those six characters never are part of another one.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    space = _SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a text's first byte, and the end
    edge[off] = True
    first = ~space
    first[1:] &= space[:-1] | edge[1:-1]
    last = ~space
    last[:-1] &= space[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct byte strings raw[start:end] in order of first use, and each one's number."""
    if not len(starts):
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    # neighbours touch or leave gaps: an array of all pieces, gaps included, of which every second is a word
    cuts = np.empty(2 * len(starts) + 1, np.int64)
    cuts[0:-1:2], cuts[1::2], cuts[-1] = starts, ends, len(raw)
    kind = (pa.large_binary(), np.int64) if len(raw) >= 1 << 31 else (pa.binary(), np.int32)
    pieces = pa.Array.from_buffers(kind[0], 2 * len(starts), [None, pa.py_buffer(cuts.astype(kind[1])), pa.py_buffer(np.ascontiguousarray(raw))])
    found = pieces.take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
