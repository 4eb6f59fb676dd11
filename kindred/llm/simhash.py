"""SimHash near-duplicate classes: pigeonhole blocks, joins on blocks, Hamming verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import slices, table, texts
from kindred.operators.components import connected_components
from kindred.sources.scratch import materialize

SHINGLE_WORDS, MAX_BITS, SEED, BLOCKS = 3, 2, 42, 4
#: A block with more distinct fingerprints is linked through one-bit neighbours instead of by pairs.
FULL_BLOCK = 64
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """64 bits of one text; a text without words has 0."""
    from xxhash import xxh64_intdigest as hashed

    found = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not found:
        return 0
    if len(found) <= shingle:
        return hashed(b" ".join(found), SEED)
    n, total = len(found) - shingle + 1, np.zeros(64, np.int64)
    joined, ends = b" ".join(found), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    for at in range(0, n, AT_ONCE):
        to = min(n, at + AT_ONCE)
        h = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist())), "<u8", to - at)
        total += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches, shingle: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        fp = np.fromiter((fingerprint(x, shingle) for x in texts(part).cast(pa.binary()).to_pylist()), np.uint64, part.num_rows)
        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (64 bits in a long) of every whole text; a null text is an empty one."""
    return docs.select("doc_id", "text").mapInArrow(lambda b: _fingerprints(b, shingle), "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> list[int]:
    """Masks of every choice of blocks - max_bits blocks: two fingerprints within max_bits agree on one of them."""
    width = 64 // blocks
    own = [((1 << (width if i < blocks - 1 else 64 - width * i)) - 1) << (width * i) for i in range(blocks)]
    return [signed(sum(own[i] for i in chosen)) for chosen in combinations(range(blocks), blocks - max_bits)]


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) among distinct fingerprints whose closure is that of all links of max_bits or fewer.

    Blocks of up to FULL_BLOCK fingerprints are joined and verified pair by pair. The
    fingerprints of fuller blocks are linked exactly and without pairs: with max_bits 2, two
    are linked just when they share a value at most one bit from both, and every such value
    ties those around it to the least of them. That is 65 rows a fingerprint, whatever
    the size of the block.
    """
    if max_bits != 2:
        raise ValueError("full blocks are resolved for links of two bits")
    masks = block_masks(max_bits)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(sizes, ["t", "key"]), "blocks")
    light, full = shared.where(F.col("n") <= FULL_BLOCK), shared.where(F.col("n") > FULL_BLOCK)
    a, b = light.select("t", "key", F.col("fp").alias("u")), light.select("t", "key", F.col("fp").alias("v"))
    pairs = a.join(b, ["t", "key"]).where("u < v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits).select("u", "v")
    near = full.select("fp").distinct().select("fp", F.explode(F.array(F.lit(0), *[F.lit(signed(1 << i)) for i in range(64)])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    least = near.groupBy("z").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1")
    stars = near.join(least, "z").select("u", F.col("fp").alias("v")).where("u <> v")
    return pairs.union(stars).distinct()


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable by links) of every document.

    Exact copies share a fingerprint, so only distinct fingerprints are joined. Texts without
    words (null ones too) have fingerprint 0 and are linked like others. Rows of one id stay
    rows; null ids stay null and count for no minimum (component_id is null where a class has no
    id). Other columns are not read; an empty table gives no rows.
    """
    found = materialize(fingerprints(docs, shingle), "fingerprints")
    fps = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    parts = connected_components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    placed = fps.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = placed.join(named, "component").select("fp", "component_id")
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """The document of the least id of every class, with its columns; of rows that repeat an id, the first by text.

    A class without any id keeps all its rows.
    """
    classes = near_duplicates(docs, shingle).select(F.col("doc_id").alias("_id"), F.col("component_id").alias("_first")).where("_first is null or _id = _first").distinct()
    from pyspark.sql import Window

    kept = docs.join(classes, docs["doc_id"].eqNullSafe(F.col("_id")))
    again = Window.partitionBy("_id", F.when(F.col("_id").isNull(), F.monotonically_increasing_id())).orderBy("text")
    return kept.withColumn("_k", F.row_number().over(again)).where("_k = 1").select(*[docs[c] for c in docs.columns])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
