"""Probabilistic suffix tree over words, and the log10 probability of whole texts.

States are contexts of up to DEPTH words. A context becomes a state if it is used LEAST times or more, in
a corpus of any size, and if what follows it diverges from what follows its longest retained suffix.
A state's next-word distribution is discounted and interpolated with that suffix's; the root
is the add-half unigram over every word of the corpus.

The tree is never in one place. The corpus is cut into chunks; a chunk asks for what it holds: sorted
64-bit hashes of its distinct sequences go to buckets (ranges of hashes), with how often each occurs in its training
texts. A bucket adds up and answers each chunk in the order that it asked in. Round 1 counts words, round 2
pairs; of longer sequences only those are asked for whose two parts are known from LEAST uses on, as no other can be.
Contexts are asked for one round after their continuations are counted: the chunk that a bucket named as a
continuation's owner adds what it contributes to the divergence. Everything that is dealt out is distinct within its
chunk, so no word, pair or text weighs more in a bucket than it has chunks. What a chunk knows is kept in files in the
shared folder, a file for each thing learned and a new name in every attempt of a task; tables name those that count.
"""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import distinct, flat, id_crc, lowered, slices, table, texts, words
from kindred.llm.token_files import filesystem
from kindred.sources.scratch import discard, materialize, scratch_path

DEPTH, DISCOUNT = 3, 0.5
#: A context or continuation has a place in the tree from so many uses on.
LEAST = 2
#: No word holds white space, so this name of the end is free.
END = b"\n"
#: Text bytes of a chunk; a longer single text is one.
CHUNK_BYTES = 4 << 20
#: Tokens that a bucket is made for.
BUCKET_TOKENS = 1 << 21
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
CHUNKS, ASKED = "chunk long, files string", "bucket long, chunk long, keys binary, more binary"
ANSWER = "chunk long, kind int, bucket long, answer binary, total long, distinct long, states long"


def hashes(found: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(found.to_pylist() or [b""], object), categorize=False).view(np.uint64)[: len(found)]


END_HASH = hashes(pa.array([END]))[0]


def packed(arrays: list[np.ndarray]) -> bytes:
    """One-dimensional arrays, compressed by planes of bytes."""
    import zstandard

    planes = [(x.dtype.str, np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()) for x in map(np.ascontiguousarray, arrays)]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes, 5))


def unpacked(data) -> list[np.ndarray]:
    import zstandard

    out = []
    for kind, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
    return out


def small(n: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    return n.astype(np.min_scalar_type(int(n.max()) if len(n) else 0))


def extended(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of sequences that are one word longer."""
    h = before * _FACTOR + word
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, place of each key among them)."""
    code, found = pd.factorize(keys)
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[code]


class Chunk:
    """Some texts as word numbers, with all that is known so far of the sequences that end at each place.

    count(d) is how often the sequence of d words that ends at each place occurs in all training texts (0 if
    fewer than LEAST times, for d > 1), rest(d) the weight that a state of d words leaves to its suffix (0: no state),
    owned(d) the places of the sequences of d words whose contribution to their context this chunk adds.
    """

    def __init__(self, uid: int, root: str, files: dict[str, str]):
        self.uid, self.root, self.files, self.parts = uid, root, dict(files), {}

    def put(self, name: str, *arrays: np.ndarray) -> None:
        fs, path = filesystem(f"{self.root}/{self.uid}-{name}-{uuid.uuid4().hex}")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as out:
            out.write(packed(list(arrays)))
        self.files[name] = path.rsplit("/", 1)[1]

    def part(self, name: str) -> list[np.ndarray]:
        if name not in self.parts:
            fs, path = filesystem(f"{self.root}/{self.files[name]}")
            with fs.open_input_file(path) as f:
                self.parts[name] = unpacked(f.read())
        return self.parts[name]

    def opened(self) -> Chunk:
        self.per, self.held_out, order, self.h, word = self.part("words")
        self.number = order[word]
        self.first = np.zeros(len(word), bool)
        self.first[np.cumsum(self.per) - self.per] = True
        self.keys = {1: self.h[self.number]}
        return self

    def row(self) -> tuple[int, str]:
        return self.uid, json.dumps(self.files)

    def key(self, d: int) -> np.ndarray:
        if d not in self.keys:
            self.keys[d] = extended(np.concatenate([np.zeros(1, np.uint64), self.key(d - 1)[:-1]]), self.keys[1])
        return self.keys[d]

    def count(self, d: int) -> np.ndarray:
        found = self.part(f"count{d}")[0]
        return found[self.number] if d == 1 else found

    def rest(self, d: int) -> np.ndarray:
        found = self.part(f"rest{d}")[0]
        return found[self.number] if d == 1 else found

    def before(self, values: np.ndarray) -> np.ndarray:
        """At each place the value of the place before; 0 at a text's first."""
        out = np.concatenate([values[:1], values[:-1]])
        out[self.first] = 0
        return out

    def sequences(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, sorted distinct hashes, number of each place) of the sequences of d words worth counting."""
        n = self.count(d - 1)
        at = np.flatnonzero((n >= LEAST) & (self.before(n) >= LEAST))
        return at, *grouped(self.key(d)[at])

    def contexts(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, sorted distinct hashes, number of each place) of contexts of d words, by the place of the word after them."""
        at = np.flatnonzero(self.before(self.count(d)) >= LEAST)
        return at, *grouped(self.key(d)[at - 1])

    def probability(self, depth: int, scale: float) -> np.ndarray:
        """P(word | longest state of up to `depth` words) at each place."""
        p = (self.count(1) + 0.5) / scale
        for d in range(1, depth + 1):
            r = self.before(self.rest(d))
            at = np.flatnonzero(r)
            n = self.count(d + 1)[at].astype(float)
            p[at] = np.where(n > 0, n - DISCOUNT, 0) / self.count(d)[at - 1] + r[at] * p[at]
        return p

    def asks(self, step: tuple[str, int], scale: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """(sorted distinct hashes, columns that go with them)."""
        kind, d = step
        train = ~np.repeat(self.held_out.astype(bool), self.per)
        if kind == "count":
            if d == 1:
                return self.h, [small(np.bincount(self.number[train], minlength=len(self.h)))]
            at, keys, code = self.sequences(d)
            return keys, [small(np.bincount(code[train[at]], minlength=len(keys)))]
        at, keys, code = self.contexts(d)
        place = np.full(len(self.number), -1)
        place[at] = code
        own = self.part(f"owned{d + 1}")[0]
        c, n, uses = place[own], self.count(d + 1)[own].astype(float), self.count(d)[own - 1]
        below = self.probability(d - 1, scale)[own]
        used = np.zeros(len(keys), np.int64)
        used[c] = uses
        seen, covered, divergence = (np.bincount(c, x, len(keys)) for x in (n, below, n * np.log(n / uses / below)))
        return keys, [small(np.bincount(c, minlength=len(keys))), small(used), small(seen.astype(np.int64)), covered.astype(np.float32), divergence.astype(np.float32)]

    def hears(self, step: tuple[str, int], answer: np.ndarray) -> None:
        kind, d = step
        if kind == "count":
            n, mine = answer >> 1, answer & 1
            if d == 1:
                self.put("count1", small(n))
                return
            n[n < LEAST] = 0
            at, keys, code = self.sequences(d)
            out = np.zeros(len(self.number), n.dtype)
            out[at] = n[code]
            first = np.full(len(keys), len(self.number))
            first[code[::-1]] = at[::-1]
            self.put(f"count{d}", small(out))
            self.put(f"owned{d}", np.sort(first[(mine > 0) & (n > 0)]).astype(np.int32))
            return
        at, _, code = self.contexts(d)
        out = np.zeros(len(self.h if d == 1 else self.number), np.float32)
        out[self.number[at - 1] if d == 1 else at - 1] = answer[code]
        self.put(f"rest{d}", out)


def _rows(chunks: list[Chunk]) -> pa.RecordBatch:
    uid, files = zip(*(x.row() for x in chunks)) if chunks else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(files, pa.string())], ["chunk", "files"])


def _chunks(batches, root: str) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 32
    for part in slices(batches, "text", CHUNK_BYTES):
        raw, off = flat(texts(part))
        raw = lowered(raw)
        starts, ends, per = words(raw, off)
        found, number = distinct(raw, starts, ends)
        h = np.append(hashes(found), END_HASH)
        uses = np.append(np.bincount(number, minlength=len(found)), len(per))
        last = np.cumsum(per + 1) - 1
        word = np.full(int(last[-1]) + 1, len(found))
        body = np.ones(len(word), bool)
        body[last] = False
        word[body] = number
        by_hash, by_use = np.argsort(h), np.argsort(-uses)
        rank, place = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        rank[by_use], place[by_hash] = np.arange(len(h)), np.arange(len(h))
        doc_id = part.column("doc_id").cast(pa.int64())
        chunk = Chunk(uid, root, {})
        chunk.put("ids", doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        chunk.put("words", per + 1, part.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8), small(place[by_use]), h[by_hash], small(rank[word]))
        yield _rows([chunk])
        uid += 1


def _open(batches, root: str) -> Iterator[Chunk]:
    for batch in batches:
        for uid, files in zip(batch.column("chunk").to_pylist(), batch.column("files").to_pylist()):
            yield Chunk(uid, root, json.loads(files)).opened()


def _ask(batches, root: str, steps: list[tuple[str, int]], bits: int, scale: float) -> Iterator[pa.RecordBatch]:
    for chunk in _open(batches, root):
        for kind, step in enumerate(steps):
            keys, more = chunk.asks(step, scale)
            cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
            cuts = np.concatenate([[0], cuts, [len(keys)]]).astype(np.int64)
            full = np.flatnonzero(np.diff(cuts))
            own = [(int(kind << bits | b), chunk.uid, keys[a:z].tobytes(), packed([x[a:z] for x in more])) for b, a, z in zip(full, cuts[full], cuts[full + 1])]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own) if own else [()] * 4, kinds)], ["bucket", "chunk", "keys", "more"])


def _answer(asked: pa.Table, steps: list[tuple[str, int]], bits: int, total: int) -> pa.Table:
    asked = asked.sort_by("chunk")
    bucket = asked.column("bucket")[0].as_py()
    kind = bucket >> bits
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in asked.column("keys")]
    more = [unpacked(x.as_buffer()) for x in asked.column("more")]
    size = [len(x) for x in keys]
    found, code = grouped(np.concatenate(keys))
    columns = [np.bincount(code, np.concatenate([m[k] for m in more]), len(found)) for k in range(len(more[0])) if steps[kind][0] == "count" or k != 1]
    stats = [0, 0, 0]
    if steps[kind][0] == "count":
        n = columns[0].astype(np.int64)
        first = np.full(len(found), len(code))
        first[code[::-1]] = np.arange(len(code))[::-1]
        out = n[code] << 1
        out[first] |= 1
        stats = [int(n.sum()), int((n > 0).sum()), 0]
    else:
        kinds, seen, covered, divergence = columns
        uses = np.zeros(len(found))
        np.maximum.at(uses, code, np.concatenate([m[1] for m in more]))
        left = np.maximum(0.0, uses - seen)
        covered = np.minimum(1 - 1e-12, covered)
        divergence += np.where(left > 0, left * np.log(np.maximum(left, 1e-300) / np.maximum(uses, 1) / (1 - covered)), 0.0)
        kept = (kinds > 0) & (divergence > 0.5 * (kinds + 1) * np.log(max(2, total)))
        rest = np.where(kept, np.maximum(1e-12, (uses - seen + DISCOUNT * kinds) / np.maximum(uses, 1)), 0)
        out, stats = rest.astype(np.float32)[code], [0, 0, int(kept.sum())]
    ends = np.cumsum(size)
    answers = [packed([small(x) if x.dtype == np.int64 else x]) for x in np.split(out, ends[:-1])]
    own = [[x if i == 0 else 0 for i in range(len(size))] for x in stats]  # said once
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    rows = [asked.column("chunk").combine_chunks(), [kind] * len(size), [bucket] * len(size), answers, *own]
    return pa.table([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(rows, kinds)], [x.split()[0] for x in ANSWER.split(", ")])


def _hear(chunks: pa.Table, answers: pa.Table, root: str, steps: list[tuple[str, int]]) -> pa.Table:
    answers, done = answers.sort_by("bucket"), []
    for chunk in _open(chunks.to_batches(), root):
        for kind, step in enumerate(steps):
            own = answers.filter(pc.equal(answers.column("kind"), kind))
            said = [unpacked(x.as_buffer())[0] for x in own.column("answer")]
            said = np.concatenate(said) if said else np.zeros(0)
            chunk.hears(step, said.astype(np.int64 if step[0] == "count" else np.float32))
        done.append(chunk)
    return pa.Table.from_batches([_rows(done)])


def _score(batches, root: str, scale: float, depth: int) -> Iterator[pa.RecordBatch]:
    for chunk in _open(batches, root):
        doc_id, none = chunk.part("ids")
        text = np.repeat(np.arange(len(chunk.per)), chunk.per)
        n = chunk.count(1)
        sums = [np.bincount(text, np.log10(x), len(chunk.per)) for x in ((n + 0.5) / scale, chunk.probability(depth, scale))]
        known = np.bincount(text, n > 0, len(chunk.per)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(doc_id, mask=none.astype(bool)), pa.array(chunk.held_out.astype(bool)), pa.array(chunk.per.astype(np.int64)), pa.array(known), *map(pa.array, sums)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def rounds(depth: int) -> list[list[tuple[str, int]]]:
    """What is asked together: sequences of d words, and contexts once their continuations are counted."""
    counts = [("count", d) for d in range(1, depth + 2)]
    contexts = [("context", d) for d in range(1, depth + 1)]
    return [counts[i : i + 1] + (contexts[i - 2 : i - 1] if i >= 2 else []) for i in range(depth + 2)]


def score_texts(docs: DataFrame, held_out, depth: int = DEPTH, sizes: list | None = None) -> DataFrame:
    """Learn from documents for which held_out is false, score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty: its one token is the end. Null and repeated ids stay rows; other columns
    are not read. Without training documents all words are unknown. An empty table gives no rows. `sizes`
    gets, for each round, the number of distinct sequences that training texts hold and of states.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    root = scratch_path(spark, "chunks")
    chunks = materialize(docs.mapInArrow(lambda b: _chunks(b, root), CHUNKS), "chunks")
    wide = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits, total, scale, tasks = wide.bit_length(), 0, 1.0, max(1, min(wide, chunks.count()))  # the table of chunks is small, what they stand for is not
    for steps in rounds(depth):
        asked = chunks.repartition(tasks, "chunk").mapInArrow(lambda b: _ask(b, root, steps, bits, scale), ASKED)  # noqa: B023
        answers = materialize(asked.groupBy("bucket").applyInArrow(lambda t: _answer(t, steps, bits, total), ANSWER), "answers")  # noqa: B023
        stats = answers.groupBy("kind").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct"), F.sum("states").alias("states")).collect()
        if steps == [("count", 1)]:
            total, different = (stats[0].total, stats[0].distinct) if stats else (0, 0)
            scale = total + 0.5 * (different + 1)
            bits = max(bits, (total // BUCKET_TOKENS).bit_length())
        if sizes is not None:
            sizes += [(*steps[r.kind], r.distinct, r.states) for r in stats]
        heard = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda a, b: _hear(a, b, root, steps), CHUNKS)  # noqa: B023
        before, chunks = chunks, materialize(heard, "chunks")
        discard(before, answers)
    scored = chunks.repartition(tasks, "chunk").mapInArrow(lambda b: _score(b, root, scale, depth), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), F.pmod(id_crc(F.col("doc_id")), F.lit(5)) == 1)
