"""Line dedup: repeated runs of lines across and within documents, later copies deleted.

Suffixes of the line-id sequences are grouped by prefix doubling: the rank of the run of 2^(k+1) lines at
a place is made of the ranks of its halves. Ranks are 128-bit digests of content instead of numbers in a
sorted order, so every document doubles its own ranks without a shuffle and equal runs have equal ranks
everywhere. One shuffle then gathers the suffixes that agree on their first run of MIN_WORDS words: the
LCP intervals at that depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import helper, slices, table, texts
from kindred.sources.scratch import materialize

#: Runs of at least so many words count as repeated; shorter repeated lines stay.
MIN_WORDS = 50
RUN = "rank binary, doc_id long, crc long, first int, n int, words int"


def digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def key_of(text: str) -> int:
    """Tells apart documents of one id; texts that agree on it and on the id are one document."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


class Ranks:
    """Ranks of the runs of 1, 2, 4, ... lines at every place, by doubling."""

    def __init__(self, lines: list[bytes]):
        self.levels = [[digest(x) for x in lines]]

    def level(self, k: int) -> list[bytes]:
        while len(self.levels) <= k:
            step, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append([digest(last[i] + last[i + step]) for i in range(max(0, len(last) - step))])
        return self.levels[k]

    def run(self, first: int, n: int) -> bytes:
        """The rank of any run: of the two overlapping runs of 2^k lines that cover it."""
        k = n.bit_length() - 1
        level = self.level(k)
        return digest(level[first] + level[first + n - (1 << k)] + n.to_bytes(8, "little"))


def shortest_runs(words: np.ndarray, least: int) -> set[tuple[int, int]]:
    """(first, lines) of the shortest run of `least` words from every line on, and up to every line.

    A longer repeated run is the union of such runs inside it, each as repeated as the whole: so
    deleting these deletes all of every maximal repeated run, and nothing else.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    to = np.searchsorted(total, total[:-1] + least, "left")
    forward = {(i, int(e) - i) for i, e in enumerate(to) if e <= n}
    since = np.searchsorted(total, total[1:] - least, "right") - 1
    return forward | {(int(s), i + 1 - int(s)) for i, s in enumerate(since) if total[i + 1] >= least}


def split_lines(text: str) -> tuple[list[str], np.ndarray]:
    lines = text.split("\n")
    return lines, np.fromiter((len(x.encode().split()) for x in lines), np.int64, len(lines))


def _runs(batches, least: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows = []
        for doc_id, text in zip(part.column("doc_id").to_pylist(), texts(part).to_pylist()):
            lines, n = split_lines(text)
            if n.sum() < least:
                continue
            ranks, crc = Ranks([x.strip(" \t\r\v\f").encode() for x in lines]), key_of(text)
            total = np.concatenate([[0], np.cumsum(n)])
            rows += [(ranks.run(first, k), doc_id, crc, first, k, int(total[first + k] - total[first])) for first, k in shortest_runs(n, least)]
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["rank", "doc_id", "crc", "first", "n", "words"])


def _delete(batches, columns: list[str], runs_name: str, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept_text, deleted, total, gone_words = [], [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column(runs_name).to_pylist()):
            if text is None:
                kept_text.append(None)
                deleted.append(0)
                total.append(0)
                gone_words.append(0)
                continue
            if not runs:
                kept_text.append(text)
                deleted.append(0)
                total.append(text.count("\n") + 1)
                gone_words.append(0)
                continue
            lines, n = split_lines(text)
            out = np.zeros(len(lines), bool)
            for r in runs:
                out[r["first"] : r["first"] + r["n"]] = True
            kept_text.append("\n".join(x for x, d in zip(lines, out) if not d))
            deleted.append(int(out.sum()))
            total.append(len(lines))
            gone_words.append(int(n[out].sum()))
        own = {c: batch.column(c) for c in columns} | {"text": pa.array(kept_text, pa.string())}
        yield pa.RecordBatch.from_arrays([*(own[c] for c in columns), pa.array(total, pa.int64()), pa.array(deleted, pa.int64()), pa.array(gone_words, pa.int64())], [*columns, *names])


COUNTS = ("n_lines", "n_deleted", "n_deleted_words")


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS, names: tuple[str, str, str] = COUNTS) -> DataFrame:
    """docs with the lines of later copies taken out of `text`, and n_lines, n_deleted, n_deleted_words (under `names`).

    A run is lines of one document in a row, `least` words or more together; lines are equal if they
    are after stripping spaces at both ends. Its first copy is that of the least (doc_id, text digest,
    place); every other copy goes, also within the document and where copies overlap. Nulls stay
    null; empty texts stay; a null id comes after all ids. Rows that agree in id and text are
    one document and lose the same lines. An empty table gives no rows. Columns of docs named like the three new ones are left out.
    """
    columns = [c for c in docs.columns if c not in names]
    p = helper(docs.columns)
    runs = materialize(docs.select("doc_id", "text").mapInArrow(lambda b: _runs(b, least), RUN), "runs")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "crc", "first")
    first = runs.groupBy("rank").agg(F.min(place).alias("original"), F.max(place).alias("last")).where("original <> last").select("rank", "original")
    later = runs.join(first, "rank").where(place != F.col("original"))
    by_doc = later.select("doc_id", "crc", "first", "n").distinct().groupBy("doc_id", "crc").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    by_doc = by_doc.select(F.col("doc_id").alias(f"{p}d"), F.col("crc").alias(f"{p}c"), F.col("runs").alias(f"{p}runs"))
    keyed = docs.select(*columns).mapInArrow(_keyed(columns, f"{p}crc"), f"{schema_of(docs, columns)}, {p}crc long")
    joined = keyed.join(by_doc, keyed["doc_id"].eqNullSafe(F.col(f"{p}d")) & (keyed[f"{p}crc"] == F.col(f"{p}c")), "left").select(*columns, f"{p}runs")
    return joined.mapInArrow(lambda b: _delete(b, columns, f"{p}runs", names), ", ".join([schema_of(docs, columns), *(f"`{x}` long" for x in names)]))


def schema_of(docs: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in columns)


def _keyed(columns: list[str], name: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = pa.array([0 if x is None else key_of(x) for x in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), crc], [*columns, name])

    return run


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_deleted", "n_deleted_words", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
