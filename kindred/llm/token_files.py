"""Token-id files: documents compressed one by one with a shared dictionary, and an index of offsets.

A file is MAGIC, a header, one zstandard frame a document, the index, and a footer:

    header  <HBx32sQ>   version, bytes an id, sha256 of the dictionary (zeros: none), ids before this file's first (or 2**64-1: see manifest)
    frame   zstandard frame of the document's ids, little-endian unsigned integers
    index   <qQII> a document: doc_id (null: NULL_ID), offset of its frame, its length in bytes, its number of ids
    footer  <QQI4s>     offset of the index, documents, crc32 of the index, MAGIC

Any document is read with two short reads: its index row, then its frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import slices, table, texts
from kindred.llm.tokenizer import default_path, encoder
from kindred.sources.scratch import filesystem, materialize, scratch_path

MAGIC = b"KTOK"
HEADER = struct.Struct("<HBx32sQ")
FOOTER = struct.Struct("<QQI4s")
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("n", "<u4")])
NULL_ID = -(2**63)
UNPLACED = 2**64 - 1
LEVEL = 3
#: The dictionary is trained on this many documents at most (those of least id hash), of each so many characters at most; and its size.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 600, 20_000, 65_536


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A zstandard dictionary from a bounded sample of serialised id arrays; empty if there's too little."""
    import zstandard

    hashed = docs.where("text is not null").select(F.xxhash64("doc_id").alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    least = hashed.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]  # hashes alone first: every task offers its least
    sample = hashed.where(F.col("h") <= least).orderBy("h", "text").limit(SAMPLE_DOCS).collect() if least is not None else []
    if not sample:
        return b""
    enc = encoder(tokenizer)
    ids, off = enc.encode(pa.array([r.text for r in sample], pa.string()))
    raw = [ids[a:b].astype(id_type(enc.size)).tobytes() for a, b in zip(off[:-1], off[1:])]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, raw)) // 10)), raw).as_bytes()
    except zstandard.ZstdError:
        return b""


def digest(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest() if dictionary else bytes(32)


class Writer:
    """Appends documents to one file."""

    def __init__(self, out, dictionary: bytes, width: str):
        import zstandard

        given = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **given).compress
        self.out, self.width, self.rows = out, width, []
        head = MAGIC + HEADER.pack(1, int(width[-1]), digest(dictionary), UNPLACED)
        out.write(head)
        self.at = len(head)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.pack(ids.astype(self.width).tobytes())
        self.out.write(frame)
        self.rows.append((NULL_ID if doc_id is None else doc_id, self.at, len(frame), len(ids)))
        self.at += len(frame)

    def close(self) -> None:
        index = np.array(self.rows, INDEX).tobytes()
        self.out.write(index + FOOTER.pack(self.at, len(self.rows), zlib.crc32(index), MAGIC))
        self.out.close()


class Reader:
    """Random access to the documents of one file (a seekable one, and the dictionary it was written with)."""

    def __init__(self, file, size: int, dictionary: bytes):
        import zstandard

        self.file = file
        head = self._read(0, len(MAGIC) + HEADER.size)
        version, width, sha, _ = HEADER.unpack(head[len(MAGIC) :])
        at, n, crc, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if head[: len(MAGIC)] != MAGIC or magic != MAGIC or version != 1:
            raise ValueError("not a token-id file")
        if sha != digest(dictionary):
            raise ValueError("written with another dictionary")
        index = self._read(at, size - FOOTER.size - at)
        if zlib.crc32(index) != crc:
            raise ValueError("damaged index")
        self.index = np.frombuffer(index, INDEX, n)
        given = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.unpack = zstandard.ZstdDecompressor(**given).decompress
        self.width = f"<u{width}"

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def document(self, k: int) -> np.ndarray:
        row = self.index[k]
        return np.frombuffer(self.unpack(self._read(int(row["offset"]), int(row["length"]))), self.width).astype("<u4")


def _write_part(batches, root: str, dictionary: bytes, tokenizer: str) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    enc, writer, total = encoder(tokenizer), None, 0
    for piece in slices(batches):
        if writer is None:
            fs, path = filesystem(f"{root}/part-{part:06d}-{uuid.uuid4().hex}.ktok")
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            writer = Writer(fs.open_output_stream(path), dictionary, id_type(enc.size))
        ids, off = enc.encode(texts(piece))
        for doc_id, a, b in zip(piece.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist()):
            writer.add(doc_id, ids[a:b])
        total += len(ids)
    if writer is not None:
        writer.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path.rsplit("/", 1)[1]], "n_docs": [len(writer.rows)], "n_tokens": [total]})


MANIFEST = "part long, path string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, root: str, tokenizer: str | None = None, partitions: int | None = None) -> DataFrame:
    """Encode every whole text and write the files under root; returns the manifest, one row a file.

    Documents are in ascending order of doc_id (null first; equal ids by text), each
    file a range of ids, so files in the order of `part` hold all ids in order. Each
    text is followed by id 0; a null text is an empty one. Only doc_id and text are read,
    whatever other columns there are. A file's name is new in every attempt of a task and
    the manifest names those of the attempts that counted, so lost executors do no harm.
    A table without rows gives an empty manifest.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    tokenizer = tokenizer or default_path()
    dictionary = train_dictionary(docs, tokenizer)
    fs, path = filesystem(f"{root}/dictionary.zdict")
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(dictionary)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(lambda b: _write_part(b, root, dictionary, tokenizer), MANIFEST), "manifest")


def _read_part(batches, root: str) -> Iterator[pa.RecordBatch]:
    dictionary = None
    for batch in batches:
        for row in batch.to_pylist():
            if dictionary is None:
                fs, path = filesystem(f"{root}/dictionary.zdict")
                with fs.open_input_stream(path) as f:
                    dictionary = f.read()
            fs, path = filesystem(f"{root}/{row['path']}")
            with fs.open_input_file(path) as f:
                reader, start = Reader(f, f.size(), dictionary), row["start"]
                for lo in range(0, len(reader.index), 4096):
                    out = []
                    for k in range(lo, min(lo + 4096, len(reader.index))):
                        ids = reader.document(k)
                        doc_id = int(reader.index[k]["doc_id"])
                        out.append((None if doc_id == NULL_ID else doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame, root: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files."""
    from pyspark.sql import Window

    spark = manifest.sparkSession
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file, not a document
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(n, "path").mapInArrow(lambda b: _read_part(b, root), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "token_files")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), root), root)
