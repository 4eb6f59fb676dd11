"""Near copies by SimHash, then by an exact join for the pairs that it leaves apart.

SimHash links are op5's (three-word shingles, fingerprints of 64 bits, two bits, found by blocks of bits; see simhash.py).
Near copies of a similarity of 0.8 mostly differ in more bits than that, so an exact join of sets follows: five-word
shingles, a similarity (Jaccard, of sets of shingles) of 0.8 or more.

In any common order of shingles, two sets of such a similarity share one among the first n / 5 + 1 of each
(a prefix), and the smaller set has it among its first n / 9 + 1. Rare shingles come first, so blocks are
small; how rare they are is counted in BUCKETS hashed counters, as any order finds the same pairs. What meets is
verified on the whole sets, so its links are all pairs of 0.8 or more, and no others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm import simhash
from kindred.llm.common import distinct, flat, helper, lowered, release, slices, texts, words
from kindred.operators.components import connected_components
from kindred.sources.scratch import discard, materialize

SHINGLE_WORDS, SEED = 5, 42
#: Counters of shingles and of nodes by the first bits of their hashes; summed in CHUNKS pieces.
BUCKET_BITS, CHUNKS = 20, 64
BUCKETS = 1 << BUCKET_BITS
#: How often members are drawn from blocks before pairs are formed; it changes the work, not the links' closure.
DRAWS = 1
#: Text bytes whose shingles are made at once.
STEP_BYTES = 1 << 20
#: Longs of a set's sketch, in columns of their own.
SKETCH = [f"sketch_{i}" for i in range(8)]
#: An odd factor; a shingle's hash is a polynomial in it over the hashes of its words.
FACTOR = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    """All bits of a 64-bit hash spread over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(found: pa.StringArray, shingle: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each text's shingles, offsets); fewer words are one shingle, no words have none."""
    from xxhash import xxh64_intdigest as hashed

    raw, off = flat(found)
    raw = lowered(raw)
    starts, ends, per = words(raw, off)
    known, number = distinct(raw, starts, ends)
    word = np.fromiter((hashed(x, SEED) for x in known.to_pylist()), np.uint64, len(known))[number]
    n = np.where(per >= shingle, per - shingle + 1, np.minimum(per, 1))
    to = np.cumsum(n)
    doc = np.repeat(np.arange(len(per)), n)
    first, roll = np.cumsum(per) - per, np.zeros(len(word), np.uint64)
    word += np.uint64(1)
    for k in range(shingle):
        ahead = roll[: max(0, len(word) - k)]
        ahead *= np.uint64(FACTOR)
        ahead += word[k:]
    h = roll[np.repeat(first - to + n, n) + np.arange(len(doc))]
    for i in np.flatnonzero((per > 0) & (per < shingle)).tolist():
        whole = np.zeros(1, np.uint64)
        for x in word[first[i] : first[i] + per[i]]:
            whole = whole * np.uint64(FACTOR) + x
        h[to[i] - 1] = whole[0]
    h = mixed(h)
    for i, j in zip((to - n).tolist(), to.tolist()):
        h[i:j].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], np.concatenate([[0], np.cumsum(np.bincount(doc[fresh], minlength=len(per)))])


def shingle_set(text: bytes, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.binary()), shingle)[0]


def sketches(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The parity of each set's hashes by their last bits, as len(SKETCH) longs a set.

    A bit in which two sketches differ takes a hash that one of the sets has alone, so at least as many
    hashes are in one set only.
    """
    out = np.zeros((len(off) - 1, len(SKETCH)), np.uint64)
    np.bitwise_xor.at(out, (np.repeat(np.arange(len(off) - 1), np.diff(off)), (h >> np.uint64(6)) % np.uint64(len(SKETCH))), np.uint64(1) << (h & np.uint64(63)))
    return out


def _nodes(batches, shingle: int, fingerprinted: bool) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest as hashed

    for part in slices(batches, size=STEP_BYTES):
        fp = np.fromiter((simhash.fingerprint(x) if fingerprinted else 0 for x in texts(part).cast(pa.binary()).to_pylist()), np.uint64, part.num_rows)
        h, off = shingle_sets(texts(part), shingle)
        node = np.fromiter((hashed(h[i:j].tobytes(), SEED) for i, j in zip(off[:-1].tolist(), off[1:].tolist())), np.uint64, part.num_rows)
        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("row"), pa.array(node.view(np.int64)), pa.array(fp.view(np.int64))], ["doc_id", "row", "node", "fp"])


def _sets(batches, shingle: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, size=STEP_BYTES):
        h, off = shingle_sets(texts(part), shingle)
        sketch = [pa.array(x.view(np.int64)) for x in np.ascontiguousarray(sketches(h, off).T)]
        yield pa.RecordBatch.from_arrays([part.column("node"), part.column("least"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.view(np.int64))), *sketch], ["node", "least", "set", *SKETCH])


def buckets(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _counts(batches) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        values = batch.column(0)
        values = values.flatten() if pa.types.is_list(values.type) else values
        total += np.bincount(buckets(values.to_numpy(zero_copy_only=False)), minlength=BUCKETS)
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS)), pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(total, CHUNKS)], pa.binary())], ["chunk", "n"])
    del total
    release()


def _add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS // CHUNKS, np.int64)
    for batch in batches:
        for x in batch.column("n"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["chunk", "n"])


def bucket_counts(values: DataFrame) -> np.ndarray:
    """How many of the one column's hashes (or hashes in its lists) fall into each bucket: a table of one size for every input."""
    rows = values.mapInArrow(_counts, "chunk long, n binary").groupBy("chunk").applyInArrow(_add, "chunk long, n binary").collect()
    found = np.zeros((CHUNKS, BUCKETS // CHUNKS), np.int64)
    for r in rows:
        found[r.chunk] = np.frombuffer(zlib.decompress(r.n), np.int64)
    return found.ravel()


def _prefixes(batches, counts) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            h, n = part.column("set").flatten().to_numpy(zero_copy_only=False), part.column("set").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, counts.value[buckets(h)], doc))
            pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            first = pos <= (n - -(-4 * n // 5))[doc]
            doc, pos, order = doc[first], pos[first], order[first]
            node = part.column("node").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(node[doc]), pa.array(h[order]), pa.array(pos.astype(np.int32)), pa.array(n[doc].astype(np.int32))], ["node", "key", "pos", "size"])
    release()


def prefixes(fps: DataFrame) -> DataFrame:
    """(node, key, pos, size): the first shingles of each set, rare ones first, with their places and the set's size."""
    counts = fps.sparkSession.sparkContext.broadcast(bucket_counts(fps.select("set")))
    return fps.select("node", "set").mapInArrow(lambda b: _prefixes(b, counts), "node long, key long, pos int, size int")


def _among(batches, wanted) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(wanted.value[buckets(batch.column("node").to_numpy(zero_copy_only=False))]))
    release()


def verified(pairs: DataFrame, fps: DataFrame) -> DataFrame:
    """The pairs (u, v) of sets with a similarity of 0.8 or more; written, as it is read several times."""
    pairs = materialize(pairs, "pairs")
    ends = pairs.select("u").union(pairs.select("v"))
    wanted = fps.sparkSession.sparkContext.broadcast(bucket_counts(ends) > 0)  # so that few other sets are dealt out
    own = fps.select("node", "set").mapInArrow(lambda b: _among(b, wanted), "node long, set array<long>")
    with_u = pairs.join(own.select(F.col("node").alias("u"), F.col("set").alias("a")), "u")
    with_v = with_u.join(own.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    found = materialize(with_v.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v"), "links")
    discard(pairs)
    return found


def fingerprint_links(found: DataFrame) -> DataFrame:
    """(node, fp) -> edges (u, v) of nodes with the closure of all links of their fingerprints by SimHash.

    A set has several fingerprints where texts repeat its shingles in other numbers, and a fingerprint several
    sets; each node is tied to the least node of each of its fingerprints' classes.
    """
    own = found.select("node", "fp").distinct()
    parts = connected_components(simhash.links(own.select("fp").distinct())).withColumnRenamed("node", "fp")
    placed = materialize(own.join(parts, "fp", "left").select("node", F.coalesce("component", "fp").alias("class")).distinct(), "fingerprint_classes")
    least = placed.groupBy("class").agg(F.min("node").alias("u"))
    edges = materialize(placed.join(least, "class").where("node <> u").select("u", F.col("node").alias("v")).distinct(), "fingerprint_links")
    discard(placed)
    return edges


def apart(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """The pairs (node, pivot) of different components."""
    homes = placed.select(F.col("node").alias("pivot"), F.col("part").alias("home"))
    return pairs.join(placed, "node").join(homes, "pivot").where("part <> home")


def links(fps: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, set, sketch) distinct sets -> edges (u, v) with the closure of all pairs of a similarity of 0.8 or more, and of the known edges.

    What the known edges join is not held against each other again.

    A block has the sets with a key in their prefix; its pivot is its least member. Every set is first held
    against the pivot that it shares most blocks with, then against all its pivots in other components, then
    against members drawn from each block whose pivot it is still apart from. What these join needs no further pairs: only members outside the component of their block's pivot are held
    against the block's members of other components. A block full of near copies thus costs its size, not
    its square. A pair that shares several keys in a row meets at the first of them only. At the first key that two sets share, what follows must suffice for the similarity, which bounds
    its places; in the smaller set it is among the first n / 9 + 1, so blocks without such a member go.
    Of a pair of such a similarity at most a ninth of both sizes is in one set only, so pairs whose sketches differ in more bits go before they are formed.
    """
    keys = materialize(prefixes(fps), "prefixes")
    early = F.col("size") >= 9 * F.col("pos")
    dealt = keys.repartition("key")  # one exchange for the aggregate and for the join
    least = dealt.groupBy("key").agg(F.min("node").alias("pivot"), F.min_by("size", "node").alias("pivot_size"), F.count("*").alias("n"), F.count_if(early).alias("early")).where("n > 1 and early > 0").select("key", "pivot", "pivot_size")
    shared = materialize(dealt.join(least, "key").select("key", "node", "pos", "size", "pivot", "pivot_size"), "shared")
    discard(keys)
    alike = 5 * F.least("size", "pivot_size") >= 4 * F.greatest("size", "pivot_size")  # else the similarity is under 0.8
    stars = materialize(shared.where((F.col("node") != F.col("pivot")) & alike).groupBy("node", "pivot").agg(F.count("*").alias("n")), "stars")
    open_ = stars if known is None else apart(stars, placed_by(known, fps))
    nearest = open_.groupBy("node").agg(F.max_by("pivot", F.struct("n", "pivot")).alias("pivot"))
    found = verified(nearest.select(F.col("pivot").alias("u"), F.col("node").alias("v")), fps)
    if known is not None:
        found = known.union(found)
    placed = placed_by(found, fps)
    found = found.union(verified(apart(stars, placed).select(F.col("pivot").alias("u"), F.col("node").alias("v")), fps))
    placed = placed_by(found, fps)
    for draw in range(DRAWS):
        order = F.xxhash64("node", "key", F.lit(draw))  # another member for each key
        dealt = shared.repartition("key")
        drawn = dealt.groupBy("key").agg(F.min_by("node", order).alias("other"), F.min_by("size", order).alias("other_size"))
        beyond = dealt.join(drawn, "key").where(5 * F.least("size", "other_size") >= 4 * F.greatest("size", "other_size"))
        for end in ("node", "pivot", "other"):
            beyond = beyond.join(placed.select(F.col("node").alias(end), F.col("part").alias(f"{end}_part")), end)
        beyond = beyond.where("node_part <> pivot_part and node_part <> other_part").select(F.least("other", "node").alias("u"), F.greatest("other", "node").alias("v")).distinct()
        found = found.union(verified(beyond, fps))
        placed = placed_by(found, fps)
    before = F.lag("key").over(Window.partitionBy("node").orderBy("pos"))  # a pair that shares it too has met there
    sketched = placed.join(fps.select("node", *SKETCH), "node")
    members = materialize(shared.join(sketched, "node").select("key", "node", "pos", "size", "part", before.alias("before"), *SKETCH), "members")
    smaller = members.where(early).select("key", *(F.col(c).alias(f"{c}_u") for c in ("node", "pos", "size", "part", "before", *SKETCH)))
    differing = sum((F.bit_count(F.col(f"{c}_u").bitwiseXOR(F.col(c))) for c in SKETCH), F.lit(0))
    enough = 9 * F.least(F.col("size_u") - F.col("pos_u"), F.col("size") - F.col("pos")) >= 4 * (F.col("size_u") + F.col("size"))
    met = smaller.join(members, "key").where((F.col("size_u") <= F.col("size")) & (F.col("part_u") != F.col("part")) & F.coalesce(F.col("before_u") != F.col("before"), F.lit(True)) & enough & (9 * differing <= F.col("size_u") + F.col("size")))
    rest = met.select(F.least("node_u", "node").alias("u"), F.greatest("node_u", "node").alias("v")).distinct()
    return found.union(verified(rest, fps))


def placed_by(edges: DataFrame, fps: DataFrame) -> DataFrame:
    """node, and its component by the edges so far."""
    parts = connected_components(edges)
    return materialize(fps.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("part")), "placed")


def similar(docs: DataFrame, shingle: int = SHINGLE_WORDS, fingerprinted: bool = False) -> DataFrame:
    """doc_id, component_id (least doc_id reachable by links) of every document.

    Links are pairs of sets of a similarity of 0.8 or more; if fingerprinted, those of SimHash first, closed together. Only distinct sets are joined. Texts without words (null ones too) have the empty set and form one class. Rows of one id stay
    rows; null ids stay null and count for no minimum (component_id is null where a class has
    no id). Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    found = materialize(rows.mapInArrow(lambda b: _nodes(b, shingle, fingerprinted), "doc_id long, row long, node long, fp long"), "nodes")
    known = fingerprint_links(found) if fingerprinted else None
    first = found.groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"))
    # texts are dealt out, not their larger sets; sets are made anew from one text of each
    chosen = rows.groupBy("row").agg(F.any_value("text").alias("text")).join(first, "row").select("node", "least", "text")
    fps = materialize(chosen.mapInArrow(lambda b: _sets(b, shingle), ", ".join(["node long, least long, set array<long>", *(f"{x} long" for x in SKETCH)])), "distinct")
    parts = materialize(connected_components(links(fps, known)), "parts")
    placed = fps.join(parts, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = materialize(placed.join(named, "component").select("node", "component_id"), "classes")
    discard(fps, parts)
    return found.select("doc_id", "node").join(classes, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """The document of the least id of every class, with its columns; of rows that repeat an id, the first by text.

    Classes are closed over SimHash links and similar sets. A class without any id keeps all its rows.
    """
    p = helper(docs.columns)
    classes = similar(docs, shingle, fingerprinted=True).select(F.col("doc_id").alias(f"{p}id"), F.col("component_id").alias(f"{p}first")).where(F.col(f"{p}first").isNull() | (F.col(f"{p}id") == F.col(f"{p}first"))).distinct()
    kept = docs.join(classes, docs["doc_id"].eqNullSafe(F.col(f"{p}id")))
    again = Window.partitionBy(f"{p}id", F.when(F.col(f"{p}id").isNull(), F.monotonically_increasing_id())).orderBy("text")
    return kept.withColumn(f"{p}k", F.row_number().over(again)).where(F.col(f"{p}k") == 1).select(*[docs[c] for c in docs.columns])
