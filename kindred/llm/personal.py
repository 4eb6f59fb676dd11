"""Personal data by offset-preserving deobfuscation.

Plain identifiers are found in the text as it is. Transducers then rewrite homoglyphs, invisible
characters, spelled digits and at/dot disguises, keeping for every written character the span it
came from; identifiers found in the rewriting are mapped back to source characters.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kindred.llm.common import slices, table, texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of local@domain; goes from @ to @, each character is looked at once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]


def cards(text: str) -> list[Span]:
    return [m.span() for m in _CARD.finditer(text) if 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


FINDERS: dict[str, Callable[[str], list[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁԛԝһАВЕКМНОРСТУХІЈЅοινανρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdqwhABEKMHOPCTYXIJSoivavptuxABEZHIKMNOPTYX"))
#: Marks that look like @ . + and -.
LOOKALIKES |= {"。": ".", "․": ".", "‧": ".", "·": ".", "∙": ".", "•": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " "}
_INVISIBLE = frozenset("­​‌‍⁠﻿")
_STRANGE = re.compile("[ ­·Ͱ-ԯ٠-٩۰-۹०-९ -⁯℀-⅏∀-⋿①-⓿　-〿ﬀ-ﬆ﹐-￯\U0001d400-\U0001d7ff]")
#: Words for digits in four languages.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
#: Gaps in a disguise have up to three characters, names and labels as many as addresses allow, so every pattern takes time in proportion to the text.
_BETWEEN = r"[\s,/_()-]{1,3}"
_DOT_BETWEEN = r"(?:\s{0,3}[\[({<]\s{0,3}(?:dot|punkt|point|punto|\.)\s{0,3}[\])}>]\s{0,3}|[\s_-]{1,3}(?:dot|punkt|point|punto)[\s_-]{1,3}|\s{0,3}\.\s{0,3})"
_SPOKEN = re.compile(rf"(?<!\w)(?:(?:plus\s{{1,3}}|\+\s{{0,3}}))?(?:(?:double|triple)\s{{1,3}})?(?:{_DIGIT_WORD}|[0-9]+)(?:(?:{_DOT_BETWEEN}|{_BETWEEN})(?:(?:double|triple)\s{{1,3}})?(?:{_DIGIT_WORD}|[0-9]+))+(?!\w)", re.I)
_SPOKEN_PART = re.compile(rf"(?P<plus>plus|\+)|(?P<times>double|triple)|(?P<word>{_DIGIT_WORD}(?!\w))|(?P<digits>[0-9]+)|(?P<dot>{_DOT_BETWEEN})|(?P<gap>{_BETWEEN})", re.I)
_HINT_SPOKEN = re.compile(rf"(?<!\w){_DIGIT_WORD}[\s,/_-]{{1,3}}{_DIGIT_WORD}[\s,/_-]{{1,3}}", re.I)
_HINT_DOT = re.compile(r"[\[({<]\s{0,3}(?:at|dot|@|\.|arroba|punkt|point|punto)\s{0,3}[\])}>]|[\s_-](?:dot|punkt|punto)[\s_-]|&#|&commat|&period|\s@\s|\S@\s|\s@\S", re.I)
_HINT_LEET = re.compile(r"[0-9.][OoIl|]{1,3}[0-9.]")
_ENTITY_AT, _ENTITY_DOT = re.compile(r"&#0*64;|&#x0*40;|&commat;", re.I), re.compile(r"&#0*46;|&#x0*2e;|&period;", re.I)
_BOXED_AT = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:at|@|arroba)\s{0,3}[\])}>]\s{0,3}", re.I)
_BOXED_DOT = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:dot|\.|punkt|point|punto)\s{0,3}[\])}>]\s{0,3}", re.I)
_NAME = r"[A-Za-z0-9_%+-]{1,64}"
_BARE = re.compile(rf"(?<![\w.@%+-])(?:{_NAME}(?:\s{{1,3}}dot\s{{1,3}}|\.)){{0,4}}{_NAME}(?:\s{{1,3}}at\s{{1,3}}|\s{{0,3}}@\s{{0,3}})[A-Za-z0-9-]{{1,63}}(?:(?:\s{{1,3}}(?:dot|punkt|punto)\s{{1,3}}|\s\.\s|\.)[A-Za-z0-9-]{{1,63}}){{0,4}}(?:\s{{1,3}}(?:dot|punkt|punto)\s{{1,3}}|\s\.\s)[A-Za-z][A-Za-z0-9-]{{0,62}}", re.I)
_BARE_AT, _BARE_DOT = re.compile(r"\s{1,3}at\s{1,3}|\s{0,3}@\s{0,3}", re.I), re.compile(r"\s{1,3}(?:dot|punkt|punto)\s{1,3}|\s\.\s", re.I)
_SNAKE = re.compile(r"(?<![A-Za-z0-9.])[A-Za-z0-9.]{1,64}[_-]at[_-][A-Za-z0-9]{1,63}(?:[_-]dot[_-][A-Za-z0-9]{1,63})+", re.I)
_SNAKE_AT, _SNAKE_DOT = re.compile(r"[_-]at[_-]", re.I), re.compile(r"[_-]dot[_-]", re.I)


class Rewriting:
    """A text and, for each of its characters, the source span it stands for."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.start = start if start is not None else list(range(len(text)))
        self.end = end if end is not None else list(range(1, len(text) + 1))

    def edited(self, edits: list[tuple[int, int, str]]) -> Rewriting:
        """edits: disjoint (from, to, new text) in order; each new character stands for all that it replaces."""
        if not edits:
            return self
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        return Rewriting("".join(text), start + self.start[at:], end + self.end[at:])

    def source(self, a: int, b: int) -> Span:
        return self.start[a], self.end[b - 1]


def plain_letters(r: Rewriting) -> Rewriting:
    """Homoglyphs, compatibility forms, digits of other scripts; invisible characters go."""
    edits = []
    for m in _STRANGE.finditer(r.text):
        c = m[0]
        if c in _INVISIBLE:
            new = ""
        elif c in LOOKALIKES:
            new = LOOKALIKES[c]
        elif (d := unicodedata.digit(c, None)) is not None:
            new = str(d)
        else:
            new = unicodedata.normalize("NFKC", c)
            new = new if new.isascii() and new else c
        if new != c:
            edits.append((m.start(), m.end(), new))
    return r.edited(edits)


def plain_digits(r: Rewriting) -> Rewriting:
    """O, o, I, l and | between digits or dots are digits."""
    swap = str.maketrans("OoIl|", "00111")
    return r.edited([(m.start() + 1, m.end() - 1, m[0][1:-1].translate(swap)) for m in _HINT_LEET.finditer(r.text)])


def spoken_digits(r: Rewriting) -> Rewriting:
    """Runs of spelled digits, three or more of them, become digits; single gaps between them go."""
    edits = []
    for m in _SPOKEN.finditer(r.text):
        if len(re.findall(rf"(?<!\w){_DIGIT_WORD}(?!\w)", m[0], re.I)) < 3:
            continue
        new, times = [], 1
        for p in _SPOKEN_PART.finditer(r.text, m.start(), m.end()):
            kind, said = p.lastgroup, p[0].lower()
            if kind == "times":
                times = 2 if said == "double" else 3
            elif kind in ("word", "digits"):
                new.append((p.start(), p.end(), None if kind == "digits" and times == 1 else DIGIT_WORDS.get(said, said) * times))
                times = 1
            elif kind in ("plus", "dot"):
                new += [(p.start(), p.end(), "+" if kind == "plus" else ".")]
        at = m.start()
        for a, b, put in new:  # what stands between the parts goes
            if a > at:
                edits.append((at, a, ""))
            if put is not None:  # digits stay as they are, each with its own place
                edits.append((a, b, put))
            at = b
        if at < m.end():
            edits.append((at, m.end(), ""))
    return r.edited(edits)


def signs(r: Rewriting) -> Rewriting:
    """Disguises of @ and of the dots of an address."""
    for pattern, new in ((_ENTITY_AT, "@"), (_ENTITY_DOT, "."), (_BOXED_AT, "@"), (_BOXED_DOT, ".")):
        r = r.edited([(*m.span(), new) for m in pattern.finditer(r.text)])
    for whole, at, dot in ((_BARE, _BARE_AT, _BARE_DOT), (_SNAKE, _SNAKE_AT, _SNAKE_DOT)):
        edits = []
        for m in whole.finditer(r.text):
            edits += sorted({(*p.span(), new) for pattern, new in ((at, "@"), (dot, ".")) for p in pattern.finditer(r.text, *m.span())})
        r = r.edited(edits)
    return r


_RUN = re.compile(r"[0-9]{9,15}")


def disguised(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) found in the rewriting only, in source characters."""
    strange, spoken = _STRANGE.search(text), _HINT_SPOKEN.search(text)
    if not (strange or spoken or _HINT_DOT.search(text) or _HINT_LEET.search(text)):
        return []
    r = Rewriting(text)
    if strange:
        r = plain_letters(r)
    if _HINT_LEET.search(r.text):
        r = plain_digits(r)
    before = r
    if _HINT_SPOKEN.search(r.text):
        r = spoken_digits(r)
    if _HINT_DOT.search(r.text):
        r = signs(r)
    found = [(kind, *r.source(a, b)) for kind, find in FINDERS.items() for a, b in find(r.text)]
    if r is not before:  # spelled numbers are said without the plus of the written form
        found += [("phone", s, e) for m in _RUN.finditer(r.text) for s, e in [r.source(*m.span())] if sum(c.isalpha() for c in text[s:e]) > len(m[0]) and not luhn_card(m[0])]
    return found


def luhn_card(digits: str) -> bool:
    return 12 <= len(digits) <= 19 and luhn(digits)


def find_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans that the rewriting adds), each by start, then kind.

    Base spans always stay. A found span is added unless it lies within a base span, or
    within one already added, of any kind.
    """
    order = {k: i for i, k in enumerate(KINDS)}
    base = sorted(((k, a, b) for k, find in FINDERS.items() for a, b in find(text)), key=lambda x: (x[1], order[x[0]]))
    starts, reach = [a for _, a, _ in base], list(accumulate((b for _, _, b in base), max))
    more: list[tuple[str, int, int]] = []
    last = -1  # the furthest end of those added, all of which start no later
    for k, a, b in sorted(set(disguised(text)), key=lambda x: (x[1], -x[2], order[x[0]])):
        i = bisect_right(starts, a)
        if (not i or reach[i - 1] < b) and last < b:
            more.append((k, a, b))
            last = b
    return base, more


def listed(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _find(batches) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows = []
        for text in texts(part).to_pylist():
            base, more = find_spans(text)
            n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
        cols = [pa.array(c) for c in zip(*rows)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *cols], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every whole text, in code points of the source.

    n_<kind> and base_sha256 are of the plain spans, `spans` lists those and the added ones. A null
    text is an empty one; null and repeated ids stay rows; other columns are not read. Time goes
    with the length of a text, whatever it holds.
    """
    return docs.select("doc_id", "text").mapInArrow(_find, SCHEMA)


def op9_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
