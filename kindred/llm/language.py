"""Language identification by segmentation-marginalised unigrams.

Words longer than LONGEST_WORD bytes (LONGEST_LEARNED where pieces are learned) are cut between letters,
and segmentations are summed within each part: so scripts without spaces are learned from like others.
Each language has a probability for every piece of a fixed public vocabulary. A word's
probability in a language is the sum over all ways to cut it into pieces (a forward pass); a
text's is the product over its words. Pieces never cross white space, so each
distinct word is scored once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import distinct, flat, id_crc, lowered, release, slices, table, texts, words
from kindred.llm.tokenizer import byte_letters, default_path
from kindred.sources.scratch import materialize

#: About this many labelled documents of each language are learned from, chosen by id hash.
SAMPLE_DOCS = 2000
ROUNDS, LONGEST = 3, 16
#: Bytes of a word that pieces are learned from, and that is scored, at once.
LONGEST_LEARNED, LONGEST_WORD = 31, 1024
#: Before a part that is not a word's first; no word holds it.
GOES_ON = b"\n"
#: Bytes of the words that one step has a lattice for.
LATTICE_BYTES = 1 << 16
#: Share of every language's probability spread over all pieces alike.
FLOOR = 1e-4
#: Text bytes that are scored at once.
SCORED_BYTES = 1 << 20
#: Distinct words whose scores a Python worker remembers.
REMEMBERED = 150_000
UNDETERMINED = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Pieces of up to LONGEST bytes of a byte-level vocabulary, found by hash."""

    def __init__(self, path: str):
        back = {v: k for k, v in byte_letters().items()}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        as_bytes = sorted({b for b in (bytes(back[c] for c in p) for p in vocabulary if all(c in back for c in p)) if len(b) <= LONGEST and not b[1:].strip(b"\t\n\v\f\r ") != b[1:]} | {bytes([i]) for i in range(256)})
        self.size = len(as_bytes)
        self.hashes, self.numbers = [], []
        for n in range(1, LONGEST + 1):
            own = [(i, b) for i, b in enumerate(as_bytes) if len(b) == n]
            h = self.hash_columns(np.frombuffer(b"".join(b for _, b in own), np.uint8).reshape(-1, n))[-1][:, 0] if own else np.zeros(0, np.uint64)
            order = np.argsort(h)
            self.hashes.append(h[order])
            self.numbers.append(np.array([i for i, _ in own], np.int32)[order])

    @staticmethod
    def hash_columns(codes: np.ndarray) -> list[np.ndarray]:
        """For lengths 1, 2, ... the hashes of all substrings of each row."""
        one = codes.astype(np.uint64) + np.uint64(1)
        out = [one * _BASE]
        for n in range(2, min(LONGEST, codes.shape[1]) + 1):
            out.append((out[-1][:, :-1] + one[:, n - 1 :]) * _BASE)
        return out

    def lattice(self, codes: np.ndarray) -> list[np.ndarray]:
        """Piece numbers [row, start] for lengths 1, 2, ...; self.size where there is none."""
        found = []
        for h, have, number in zip(self.hash_columns(codes), self.hashes, self.numbers):
            if len(have):
                at = np.minimum(np.searchsorted(have, h), len(have) - 1)
                found.append(np.where(have[at] == h, number[at], self.size))
            else:
                found.append(np.full(h.shape, self.size, np.int32))
        return found


def forward(lattice: list[np.ndarray], p: np.ndarray, states: list | None = None) -> np.ndarray:
    """log of the summed probability of all segmentations, [row, language]; p has a last row of zeros."""
    n, length = lattice[0].shape
    alpha, scale = [np.ones((n, p.shape[1]))], np.zeros((n, p.shape[1]))
    for end in range(1, length + 1):
        now = sum(alpha[-k] * p[lattice[k - 1][:, end - k]] for k in range(1, min(len(lattice), end) + 1))
        alpha.append(now)
        if states is None:
            if length > 32 and end % 8 == 0:
                scale += np.log(now)
                alpha = [a / now for a in alpha[-LONGEST:]]
            alpha = alpha[-LONGEST:]
    if states is not None:
        states.extend(alpha)
    return np.log(alpha[-1]) + scale


def expected(lattice: list[np.ndarray], p: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
    """Adds the expected number of uses of each piece (forward-backward), one language; words of up to 32 bytes."""
    alpha: list[np.ndarray] = []
    forward(lattice, p[:, None], alpha)
    n, length = lattice[0].shape
    beta, used, weight = [np.zeros(n) for _ in range(length)] + [counts / alpha[-1][:, 0]], [], []
    for start in range(length - 1, -1, -1):
        for k in range(1, min(len(lattice), length - start) + 1):
            piece = lattice[k - 1][:, start]
            through = p[piece] * beta[start + k]
            beta[start] += through
            used.append(piece)
            weight.append(alpha[start][:, 0] * through)
    out += np.bincount(np.concatenate(used), np.concatenate(weight), len(out))


def by_length(found: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, byte matrix) of the words of each length, a space before every word that is not the rest of one."""
    raw, off = flat(found)
    length = np.diff(off)
    later = np.zeros(len(length), bool)
    later[length > 0] = raw[off[:-1][length > 0]] == GOES_ON[0]
    for n in np.unique(length):
        for rest in (False, True):
            rows = np.flatnonzero((length == n) & (later == rest))
            step = max(1, LATTICE_BYTES // (int(n) + 1))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                codes = np.full((len(part), n + 1), 32, np.uint8)
                codes[:, 1:] = raw[off[part][:, None] + np.arange(n)]
                yield part, codes[:, 2:] if rest else codes


def cut(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word) of the rests of words over `limit` bytes, cut between letters; shortens those words' ends."""
    first, last, word = [], [], []
    for i in np.flatnonzero(ends - starts > limit).tolist():
        at, end = int(starts[i]), int(ends[i])
        ends[i] = 0
        while at < end:
            to = min(end, at + limit)
            while to < end and to > at + 1 and raw[to] & 0xC0 == 0x80:  # within a letter
                to -= 1
            if ends[i]:
                first.append(at)
                last.append(to)
                word.append(i)
            else:
                ends[i] = to
            at = to
    return np.array(first, np.int64), np.array(last, np.int64), np.array(word, np.int64)


def tokens_of(batch: pa.RecordBatch, limit: int = LONGEST_WORD) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words and rests of words, number of each in the texts, text of each) of a slice."""
    raw, off = flat(texts(batch))
    raw = lowered(raw)
    starts, ends, per = words(raw, off)
    text = np.repeat(np.arange(len(per)), per)
    rest_starts, rest_ends, word = cut(raw, starts, ends, limit)
    found, number = distinct(raw, starts, ends)
    if len(word):
        rests, rest = distinct(raw, rest_starts, rest_ends)
        number, text = np.concatenate([number, rest + len(found)]), np.concatenate([text, text[word]])
        found = pa.concat_arrays([found.cast(pa.binary()), pa.array([GOES_ON + x for x in rests.to_pylist()], pa.binary())])
    return found, number, text


def _word_counts(batches) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found, number, text = tokens_of(part, LONGEST_LEARNED)
        lang = part.column("lang").dictionary_encode()
        key, n = np.unique(lang.indices.to_numpy()[text].astype(np.int64) * max(1, len(found)) + number, return_counts=True)
        yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(key // max(1, len(found)))).cast(pa.string()), found.take(pa.array(key % max(1, len(found)))).cast(pa.binary()), pa.array(n.astype(np.int64))], ["lang", "word", "n"])


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _expected(batches, path: str, langs: list[str], p: np.ndarray) -> Iterator[pa.RecordBatch]:
    own, total = pieces(path), np.zeros((len(langs), p.shape[0]))
    for batch in batches:
        lang = np.array([langs.index(x) for x in batch.column("lang").to_pylist()], np.int64)
        count = batch.column("n").to_numpy().astype(float)
        for rows, codes in by_length(batch.column("word")):
            for k in np.unique(lang[rows]):
                mine = lang[rows] == k
                expected(own.lattice(codes[mine]), p[:, k], count[rows[mine]], total[k])
        release()
    k, piece = np.nonzero(total[:, :-1])
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(piece), pa.array(total[k, piece])], ["k", "piece", "n"])


class Model:
    """langs, log prior of each, and p[piece, language] with a last row of zeros."""

    def __init__(self, langs: list[str], prior: np.ndarray, p: np.ndarray, path: str):
        self.langs, self.prior, self.p, self.path = langs, prior, p, path


def learn(docs: DataFrame, path: str | None = None, sample: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model:
    """Fit on text and non-null lang of the given labelled documents.

    About `sample` documents of each language, chosen by a hash of the id, are counted into
    distinct words; each round of expectation-maximisation runs over that table on the executors
    and returns one number a piece and language.
    """
    path = path or default_path()
    docs = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = sorted((r.lang, r.n) for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect())
    langs = [x for x, _ in sizes]
    v = pieces(path).size
    p = np.full((v + 1, len(langs)), 1 / v)
    p[-1] = 0
    if not langs:
        return Model([], np.zeros(0), p, path)
    unit = 1 << 30
    share = F.create_map(*[x for lang, n in sizes for x in (F.lit(lang), F.lit(min(unit, -(-unit * sample // n))))])
    chosen = docs.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(unit)) < share[F.col("lang")])
    counts = materialize(chosen.select("text", "lang").mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    for _ in range(rounds):
        now = np.zeros_like(p)
        q = p
        for r in counts.mapInArrow(lambda b: _expected(b, path, langs, q), "k long, piece long, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas().itertuples():
            now[r.piece, r.k] = r.n
        total = now[:-1].sum(0)
        p = np.zeros_like(now)
        p[:-1] = (1 - FLOOR) * np.where(total > 0, now[:-1] / np.maximum(total, 1e-300), 1 / v) + FLOOR / v
    n = np.array([x for _, x in sizes], float)
    return Model(langs, np.log(n / n.sum()), p, path)


_SCORES: dict = {}


def word_scores(found: pa.Array, model: Model, key: str) -> np.ndarray:
    """Log probability [word, language] of distinct words, remembered in the worker."""
    own, held = pieces(model.path), _SCORES.get(key)
    if held is None or len(held[0]) > REMEMBERED:
        _SCORES.clear()
        held = _SCORES[key] = ({}, [np.zeros((0, len(model.langs)))])
    known, store = held
    names = found.to_pylist()
    new = [i for i, x in enumerate(names) if x not in known]
    if new:
        fresh = np.zeros((len(new), len(model.langs)))
        for rows, codes in by_length(found.take(pa.array(new))):
            fresh[rows] = forward(own.lattice(codes), model.p)
        first = len(store[0])
        store[0] = np.concatenate([store[0], fresh])
        known.update((names[i], first + j) for j, i in enumerate(new))
    return store[0][np.fromiter(map(known.__getitem__, names), np.int64, len(names))]


def judged(part: pa.RecordBatch, model: Model, key: str) -> tuple[pa.Array, pa.Array]:
    """(lang_pred, score) of a slice."""
    n = part.num_rows
    lettered = np.array([any(map(str.isalpha, x)) for x in texts(part).to_pylist()], bool)
    pred, score = np.full(n, UNDETERMINED, object), np.zeros(n)
    if model.langs:
        found, number, text = tokens_of(part)
        total = np.tile(model.prior, (n, 1))
        if len(found):
            own = word_scores(found, model, key)[number]
            for k in range(len(model.langs)):
                total[:, k] += np.bincount(text, own[:, k], n)
        total -= total.max(1, keepdims=True)
        best = total.argmax(1)
        odds = np.exp(total)
        pred[lettered] = np.array(model.langs, object)[best[lettered]]
        score[lettered] = (odds[np.arange(n), best] / odds.sum(1))[lettered]
    return pa.array(pred, pa.string()), pa.array(score)


def _predict(batches, model: Model, key: str, columns: list[str], names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, size=SCORED_BYTES):
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *judged(part, model, key)], [*columns, *names])
    _SCORES.clear()  # the worker may serve another operator next
    release()


def with_language(docs: DataFrame, model: Model, columns: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns (of which text may be none), lang_pred and score (under `names`) of every document; only its text is looked at.

    A null text or one without a letter is `und` with score 0, and so is everything if no
    document was labelled. Of equally probable languages the first by name wins. Rows with
    null or repeated ids stay rows.
    """
    import uuid

    key = uuid.uuid4().hex
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for c in columns for f in docs.schema.fields if f.name == c)
    read = docs.select(*columns, *(["text"] if "text" not in columns else []))
    return read.mapInArrow(lambda b: _predict(b, model, key, columns, names), f"{schema}, `{names[0]}` string, `{names[1]}` double")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; other columns are not read."""
    held = F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2
    return with_language(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(F.pmod(id_crc(F.col("doc_id")), F.lit(4)) != 2)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(learnable(docs)))
