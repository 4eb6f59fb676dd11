"""Whole texts to ids of a public tokenizer, each distinct piece of text encoded once in a worker."""

from __future__ import annotations

import os
import re
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa

from kindred.llm.common import flat

#: Distinct pieces whose ids a Python worker remembers; beyond it, it keeps those met most often, half as many at most.
REMEMBERED = 150_000
#: Appended to every document.
END_ID = 0

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
#: Last bytes of white space beyond ASCII (U+0085, U+00A0, U+1680, U+2000.. U+3000).
_WIDE_SPACE_END = np.zeros(256, bool)
_WIDE_SPACE_END[[0x85, 0xA0, 0xA8, 0xA9, 0xAF, 0x9F, *range(0x80, 0x8B)]] = True


#: A piece that the tokenizer doesn't split further: letters, digits or marks (no apostrophe, which can begin a contraction).
_WHOLE = re.compile(r" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)").fullmatch


_ID = attrgetter("id")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = byte_letters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def safe_cuts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places where a byte-level BPE text can be cut without changing its ids.

    The tokenizer first splits by letters, digits, marks and white space, a space going with
    what follows. No such piece holds white space after something else, nor a mark after a
    letter; so before white space that follows a non-space, and before an ASCII mark that
    follows an ASCII letter, pieces end. Where the byte before may end a wide space, no cut.
    A single line feed stays alone, so a piece also ends between it and a visible ASCII character.
    """
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw) > 1:
        here, before = raw[1:], raw[:-1]
        lead = np.concatenate([[0xC3], raw[:-2]]) if len(raw) > 2 else np.full(len(before), 0xC3, np.uint8)
        wide = _WIDE_SPACE_END[before] & (lead != 0xC3)
        space = _ASCII_SPACE[here] & ~_ASCII_SPACE[before] & ~wide
        cut[1:-1] = space | (_MARK[here] & _LETTER[before])
        cut[2:-1] |= space[:-1] & (before[1:] == 10) & (here[1:] > 32) & (here[1:] < 127)
    cut[off] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of a `tokenizers` file with byte-level BPE."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        added = self.model.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that take in what surrounds them")
        self.added = {t.content for t in added}
        longest = sorted((x.encode() for x in self.added), key=len, reverse=True)
        self.find_added = re.compile(b"|".join(map(re.escape, longest))).finditer if longest else None
        self.size = self.model.get_vocab_size()
        self.merge = self.model.model.tokenize
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lens = np.zeros(1 << 16, np.int64)
        self.met = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _keep_frequent(self) -> None:
        """Forget pieces met in one step only, and all but the REMEMBERED // 2 met in most steps."""
        met = self.met[: len(self.at)]
        kept = np.flatnonzero(met > 1)
        if len(kept) > REMEMBERED // 2:
            kept = np.sort(kept[np.argsort(-met[kept], kind="stable")[: REMEMBERED // 2]])
        pieces = list(self.at)  # in order of their numbers
        starts, lens, met, ids = self.starts[kept], self.lens[kept], met[kept], self.ids
        self._forget()
        to = np.cumsum(lens)
        total = int(to[-1]) if len(to) else 0
        self.ids = np.zeros(max(1 << 20, total), np.uint32)
        self.ids[:total] = ids[np.arange(total) + np.repeat(starts - (to - lens), lens)]
        room = max(1 << 16, len(kept))
        self.starts, self.lens, self.met = np.zeros(room, np.int64), np.zeros(room, np.int64), np.zeros(room, np.int32)
        self.starts[: len(kept)], self.lens[: len(kept)], self.met[: len(kept)] = to - lens, lens, met // 2
        self.at = {pieces[i]: k for k, i in enumerate(kept.tolist())}
        self.used = total

    def _learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 8192):
            part = new[i : i + 8192]
            whole = [i for i, x in enumerate(part) if _WHOLE(x) and x not in self.added]
            letters = "\0".join([part[i] for i in whole]).encode().decode("latin-1").translate(_LETTERS).split(_LETTERS[0])
            got: list = [None] * len(part)
            for i, x in zip(whole, letters):
                got[i] = list(map(_ID, self.merge(x)))
            rest = [i for i, x in enumerate(got) if x is None]
            for i, e in zip(rest, self.model.encode_batch_fast([part[i] for i in rest], add_special_tokens=False)):
                got[i] = e.ids
            lens = np.fromiter(map(len, got), np.int64, len(got))
            flat_ids = np.fromiter(chain.from_iterable(got), np.uint32, int(lens.sum()))
            n, to = len(self.at), self.used + len(flat_ids)
            while to > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while n + len(part) > len(self.lens):
                self.starts, self.lens, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens, self.met))
            self.ids[self.used : to] = flat_ids
            self.lens[n : n + len(part)] = lens
            self.starts[n : n + len(part)] = self.used + np.cumsum(lens) - lens
            self.at.update(zip(part, range(n, n + len(part))))
            self.used = to

    def _cut_added(self, raw: np.ndarray, off: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Cuts with each added token of the file (such as <|endoftext|>) as one piece."""
        data = raw.tobytes()
        if self.find_added is None or next(self.find_added(data), None) is None:
            return cuts
        spans = np.array([m.span() for a, b in zip(off[:-1].tolist(), off[1:].tolist()) for m in self.find_added(data, a, b)], np.int64).reshape(-1, 2)
        inside = np.searchsorted(spans[:, 0], cuts, "left") > np.searchsorted(spans[:, 1], cuts, "right")
        return np.union1d(np.union1d(cuts[~inside], spans.ravel()), off)

    def encode(self, arr: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text); every text ends with END_ID. No nulls."""
        raw, off = flat(arr)
        cuts = self._cut_added(raw, off, safe_cuts(raw, off))
        first = np.searchsorted(cuts, off)  # the piece that begins at each text
        if len(cuts) > 1:
            pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
            known = pieces.dictionary.to_pylist()
            if len(self.at) > REMEMBERED:
                self._keep_frequent()
            self._learn([x for x in known if x not in self.at])
            number = np.fromiter(map(self.at.__getitem__, known), np.int64, len(known))
            self.met[number] += 1
            number = number[pieces.indices.to_numpy()]
            lens, starts = self.lens[number], self.starts[number]
        else:
            lens = starts = np.zeros(0, np.int64)
        # one more place after each text for the end id
        before = np.concatenate([[0], np.cumsum(lens)])
        offsets = before[first] + np.arange(len(off))
        out = np.full(int(before[-1]) + len(off) - 1, END_ID, np.uint32)
        ours = np.ones(len(out), bool)
        ours[offsets[1:] - 1] = False
        out[ours] = self.ids[np.arange(int(before[-1])) + np.repeat(starts - before[:-1], lens)]
        return out, offsets


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
