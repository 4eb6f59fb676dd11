import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.llm import language, lines, mixing, neighbours, packing, personal, quality, simhash, suffix_tree, token_files
from kindred.llm.common import id_crc
from kindred.llm.tokenizer import default_path, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, block string, rank int, word string, slot long, u long"
LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"), (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"),
    (3, None, None, None), (4, "", "en", "a"), (5, "  \n\t ", None, "b"), (None, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", None), (7, LONG + "\nshort\n" + LONG, "en", "a"),
    (7, LONG + "\nshort\n" + LONG, "en", "a"), (8, "intro line\n" + LONG + "\nend", "en", "b"), (9, "x" * 5000 + " " + "ab " * 3000, "en", "a"), (10, "12345 !!! ###", "de", "c"), (11, "Der Hund und die Katze sind im Haus.", "de", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, None, 0.5, "b", 1, "w", 3, 4) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def held(remainder, n):
    return F.pmod(id_crc(F.col("doc_id")), F.lit(n)) == remainder


def test_empty_tables(spark, empty, tmp_path):
    root = f"file://{tmp_path}/t"
    assert token_files.read_token_files(token_files.write_token_files(empty, root), root).count() == 0
    for df in (packing.pack(empty), simhash.near_duplicates(empty), simhash.keep_one(empty), quality.judge(empty), personal.personal_data(empty), lines.dedup_lines(empty), mixing.mix(empty), mixing.in_order(empty), language.identify(empty, language.learn(empty)), suffix_tree.score_texts(empty, held(1, 5))):
        assert df.count() == 0
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def ids_of(text):
    return [*encoder(default_path()).model.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(odd, tmp_path):
    root = f"file://{tmp_path}/t"
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(token_files.write_token_files(odd, root), root).collect()), key=lambda r: r[1])
    want, at = [], 0
    for doc_id, text in sorted(((r[0] if r[0] is not None else -1, r[1]) for r in ROWS), key=lambda r: (r[0], r[1] or "")):
        ids = ids_of(text)
        want.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want


def test_tokenizer_cuts_change_nothing():
    import pyarrow as pa

    texts = ["", " ", "it's we'll x'", "  a  b", " x 　y", "a\u0085 b", "à  à", "<|endoftext|> x", "a.b,c !d 123abc", "日本 語。 ok", "…  …", "tab\t\tx \n"]
    ids, off = encoder(default_path()).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [ids_of(t) for t in texts]


def test_frequent_pieces_are_learned_once(monkeypatch):
    """A full memory gives up rare pieces only, and ids stay those of whole texts."""
    from kindred.llm import tokenizer

    monkeypatch.setattr(tokenizer, "REMEMBERED", 100)
    enc, learned = tokenizer.Encoder(tokenizer.default_path()), []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda new: (learned.extend(new), learn(new)))
    for k in range(40):
        texts = ["often these words are met", "\n\n9", "a\nb\n\nc \nd\n\u3000e\u00a0\nf\n!", "", " ".join(f"rare{k}x{i}" for i in range(30)), "again they're here"]
        ids, off = enc.encode(pa.array(texts))
        for text, a, b in zip(texts, off[:-1], off[1:]):
            assert ids[a:b].tolist() == [*enc.model.encode(text, add_special_tokens=False).ids, tokenizer.END_ID]
    assert learned.count(" words") == learned.count("often") == 1
    assert len(enc.at) < 300


def test_added_token_is_one_id():
    import pyarrow as pa
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(default_path())
    mark = "<|endoftext|>"
    texts = ["end of one" + mark + "next text", mark, mark + mark, "a " + mark + " b\n" + mark + "\n", "cut <|endof", "text|> here", "x<" + mark + ">it's", "<|endoftext" + mark, "plain", "é" + mark + "\u3000日本", ""]
    ids, off = encoder(default_path()).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [[*fresh.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def best_fit(lengths, window):
    left = []
    for x in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= x]
        if fits:
            left[min(fits)[1]] -= x
        else:
            left.append(window - x)
    return Counter(left)


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 65, 300).tolist()
        rows, used = packing.plan(Counter(lengths), 64), {}
        for length, a, b, first, each, offset in rows.tolist():
            for k in range(b - a):
                used.setdefault(first + k // each, []).append((offset + k % each * length, length))
        assert sorted(x for w in used.values() for _, x in w) == sorted(lengths)
        for w in used.values():
            w.sort()
            assert all(a == sum(x for _, x in w[:i]) for i, (a, _) in enumerate(w))
        assert Counter(64 - sum(x for _, x in w) for w in used.values()) == best_fit(lengths, 64)


def test_pack_holds_every_id_once(odd):
    rows = packing.pack(odd, window=64).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(r[1])) for r in ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert all(a == sum(n for _, n in s[:i]) for i, (a, _) in enumerate(s)) and sum(n for _, n in s) <= 64
    text = {r[0]: r[1] for r in ROWS}
    assert all(r.ids_crc32 == crc(ids_of(text[r.doc_id])[r.start : r.start + r.length]) for r in rows)


def brute_components(fps):
    comp = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    return comp


@pytest.mark.parametrize("full", [1, 64])
def test_links_against_brute_force(spark, monkeypatch, full):
    monkeypatch.setattr(simhash, "FULL_BLOCK", full)
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(0, 2**63, 30)]
    fps = list(dict.fromkeys(fps + [f ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))) for f in fps for _ in range(3)] + [f ^ 7 for f in fps]))
    from kindred.operators.components import connected_components

    got = {r.node: r.component for r in connected_components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    want, least = brute_components(fps), {}
    for f, c in zip(fps, want):
        least[c] = min(least.get(c, f), f)
    assert {f: got.get(f, f) for f in fps} == {f: least[c] for f, c in zip(fps, want)}


def test_simhash_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS)
    assert {r.component_id for r in rows if r.fp == 0} == {3}
    assert {r.doc_id for r in rows if r.component_id == 1} == {1, 2}
    assert sorted(r.doc_id or 0 for r in simhash.keep_one(odd).collect()) == [0, 1, 3, 7, 8, 9, 10, 11]


def test_language(odd, spark):
    rows = {r.doc_id: r for r in language.identify(odd, language.learn(odd, rounds=2)).collect()}
    assert len(rows) == len({r[0] for r in ROWS})
    assert {rows[i].lang_pred for i in (3, 4, 5, 10)} == {"und"}
    assert rows[1].lang_pred == "en" and rows[11].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_languages_without_spaces(spark):
    """Two languages that share most letters and write no spaces: learned from words cut at letters."""
    rng = np.random.default_rng(7)
    shared, only = [chr(0x4E00 + i) for i in range(300)], {"ja": [chr(0x3042 + i) for i in range(40)], "zh": [chr(0x5000 + i) for i in range(40)]}
    likely = {k: rng.dirichlet(np.full(300, 0.3)) for k in only}
    rows = []
    for i in range(600):
        k = ("ja", "zh")[i % 2]
        text = "".join(rng.choice(shared, 60, p=likely[k])) + "".join(rng.choice(only[k], 3))
        rows.append((i, text, k if i < 400 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = language.with_language(docs, language.learn(docs), ["doc_id"]).where("doc_id >= 400").collect()
    assert len(got) == 200 and sum(r.lang_pred == ("ja", "zh")[r.doc_id % 2] for r in got) >= 190


def test_long_words_are_cut_at_letters():
    found = ["aé" * 40 + " kurz " + "日本語" * 50, "", "x" * 100, "plain words"]
    batch = language.pa.record_batch({"text": found})
    for limit in (31, 7):
        names, number, text = language.tokens_of(batch, limit)
        pieces = [[names[n].as_py() for n in number[text == i]] for i in range(len(found))]
        for x, own in zip(found, pieces):
            firsts = sum(not p.startswith(b"\n") for p in own)
            assert firsts == len(x.split()) and all(len(p.lstrip(b"\n")) <= limit and p.lstrip(b"\n").decode() for p in own)
            assert Counter("".join(p.lstrip(b"\n").decode() for p in own)) == Counter("".join(x.split()))


def test_forward_sums_all_segmentations():
    own = language.pieces(default_path())
    rng = np.random.default_rng(1)
    p = np.append(rng.random(own.size) / own.size, 0)[:, None]
    codes = np.frombuffer(b" there", np.uint8)[None, :]
    lattice = own.lattice(codes)

    def total(at):
        return 1.0 if at == 6 else sum(p[lattice[n - 1][0, at], 0] * total(at + n) for n in range(1, 7 - at))

    assert np.isclose(language.forward(lattice, p)[0, 0], np.log(total(0)))
    long = np.tile(codes, (1, 30))
    assert np.isfinite(language.forward(own.lattice(long), p)).all()


def test_quality(odd):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    want = Counter()
    for doc_id, text, *_ in ROWS:
        w = word.findall(text or "")
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(windows)
        repeated = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(8)}
        seen, dup = set(), 0
        for x in (text or "").split("\n"):
            if word.search(x):
                dup += x in seen
                seen.add(x)
        want[doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated), len(w) < 20 or 100 * len(repeated) > 30 * len(w)] += 1
    rows = quality.judge(odd).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)


def test_estimate_learns_accuracies():
    good, bad = ((0, 1, 0), 900), ((-1, 0, -1), 100)
    model = quality.estimate([good, bad], 3)
    assert quality.posterior(good[0], model) > quality.THRESHOLD and quality.posterior(bad[0], model) < 0.1


@pytest.mark.parametrize("text, found", [
    ("mail a.b@c.org now", []), ("to john [at] mail [dot] com please", [("email", "john [at] mail [dot] com")]), ("bоb@exаmple.com", [("email", "bоb@exаmple.com")]),
    ("ring plus one four one five five five five two six seven one", [("phone", "plus one four one five five five five two six seven one")]), ("the cat sat at the door. one two.", []), ("192[.]168[.]1[.]10", [("ip", "192[.]168[.]1[.]10")]), ("look at example.com now", []),
])
def test_disguises(text, found):
    assert [(k, text[a:b]) for k, a, b in personal.find_spans(text)[1]] == found


def test_emails_are_leftmost_matches():
    for t in ("a@b.c@d.e", "@x.y a@b", "a@b@c.d", "x@@y.z", "q@a.b-c.d..e"):
        assert personal.emails(t) == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]


def plain_spans(text):
    """The contract's patterns as they stand, one after the other."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    kinds = ["email", "ip", "card", "phone"]
    return sorted(out, key=lambda x: (x[1], kinds.index(x[0])))


def test_base_spans_against_the_patterns():
    rng, parts = np.random.default_rng(2), ["1", "12", "255", "256", "4111 1111 1111 1111", "+49 (30) 123-4567", "+1.2.3.4", ".", "..", " ", "-", "@", "a", "x.y", "é", "(", ")", "+", "0" * 20, "\n", "john@x.org", "8.8.8.8"]
    found = Counter()
    for _ in range(4000):
        text = "".join(rng.choice(parts, int(rng.integers(1, 14))))
        base, more = personal.find_spans(text)
        assert base == plain_spans(text), text
        found.update(k for k, _, _ in base)
    assert min(found[k] for k in personal.KINDS) > 100


@pytest.mark.parametrize("unit", ["7", "-", " ", "@", "[", "a", ".", "a.", "1.", "1 ", "a@", "@ ", "+1", "one ", "( at ", "_at_", "at ", "1.1.1.", "a dot "])
def test_long_texts_take_time_in_proportion(unit):
    text = "x [at] y, one two three, " + unit * (300_000 // len(unit)) + " joe at example dot org"
    began = time.process_time()
    personal.find_spans(text)
    assert time.process_time() - began < 15  # quadratic ones take many minutes


def test_planted_disguises():
    """Disguises in running text: how many are found, where they stand; clean text has none."""
    rng = np.random.default_rng(6)
    ways = ["{a} at {b} dot com", "{a} [at] {b} [dot] com", "{a}(at){b}(dot)com", "{a} at {b}.com", "{a}&#64;{b}.com", "{a}_at_{b}_dot_com", "{a}\u200b@{b}.com", "{a} [at] {b}.com", "call plus four nine three zero one two three four five six seven", "{a}@{b}\u3002com"]
    filler, hit, wrong, n = [f"word{i}" for i in range(50)] + ["at", "one", "(", "3.5"], 0, 0, 0
    for i in range(300):
        way = ways[i % len(ways)].format(a=f"jo{i}", b=f"ex{i}")
        before, after = (" ".join(rng.choice(filler[:50], 12)) for _ in "ab")
        text = f"{before}, {way}; {after}"
        base, more = personal.find_spans(text)
        first, last = len(before) + 2, len(before) + 2 + len(way)
        n += 1
        hit += any(a < last and b > first for _, a, b in base + more)
        wrong += any(b <= first or a >= last for _, a, b in base + more)
        clean = " ".join(rng.choice(filler, 60))
        wrong += bool(personal.find_spans(clean)[1])
    assert hit / n >= 0.85 and wrong == 0, (hit, n, wrong)


def test_personal_odd_rows(odd):
    assert personal.personal_data(odd).count() == len(ROWS)


def brute_lines(docs, least):
    """Deletes every line in a run of `least` words that has an earlier copy, trying all pairs of places."""
    docs = sorted(docs)
    split = [t.split("\n") for _, t in docs]
    gone = [set() for _ in docs]
    places = [(d, i) for d, x in enumerate(split) for i in range(len(x))]
    for a, p in enumerate(places):
        for q in places[:a]:
            n = 0
            while p[1] + n < len(split[p[0]]) and q[1] + n < len(split[q[0]]) and split[p[0]][p[1] + n].strip() == split[q[0]][q[1] + n].strip():
                n += 1
                if sum(len(x.split()) for x in split[p[0]][p[1] : p[1] + n]) >= least:
                    gone[p[0]] |= set(range(p[1], p[1] + n))
    return {docs[d][0]: "\n".join(x for i, x in enumerate(split[d]) if i not in gone[d]) for d in range(len(docs))}


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(6)
    pool = [" ".join(f"w{j}{k}" for k in range(int(rng.integers(0, 5)))) for j in range(6)]
    docs = [(i, "\n".join(pool[int(j)] for j in rng.integers(0, 6, int(rng.integers(1, 12))))) for i in range(25)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), 6).collect()}
    assert got == brute_lines(docs, 6)


def test_lines_odd_rows(odd):
    rows = lines.dedup_lines(odd).collect()
    assert len(rows) == len(ROWS)
    kept = {r.doc_id: r.text for r in rows}
    assert kept[7] == LONG + "\nshort" and kept[8] == "intro line\nend" and kept[3] is None


def test_mix_keeps_shares(odd, spark):
    rows = mixing.mix(odd, block=2).collect()
    assert sorted(r.position for r in rows) == list(range(len(ROWS)))
    weights = {"a": 5, "b": 2, "c": 1, "d": 3}
    slots = mixing.period(weights)
    for s, w in weights.items():
        for t in range(1, 12):
            assert abs(sum(x < t for x in slots[s]) - t * w / 11) < 1
    blocks = {"a": 40, "b": 3, "c": 17, "d": 0}
    lanes = mixing.schedule(blocks, weights)
    taken = sorted(int(lanes[s].slot(np.array([j]))[0]) for s, n in blocks.items() for j in range(n))
    assert taken == list(range(60))


def simulated(blocks, weights):
    """Slot by slot, whenever a source ends the others anew: (source, block of it) of every slot."""
    out, done = [], dict.fromkeys(blocks, 0)
    while left := sorted(s for s in blocks if done[s] < blocks[s]):
        total, since, now, ended = sum(weights[s] for s in left), dict.fromkeys(left, 0), 0, False
        while not ended:
            ready = [(-(-(since[s] + 1) * total // weights[s]), s) for s in left if since[s] * total // weights[s] <= now]
            s = min(ready)[1]
            out.append((s, done[s]))
            since[s] += 1
            done[s] += 1
            now += 1
            assert all(abs(since[x] - now * weights[x] / total) < 1 for x in left)
            ended = done[s] == blocks[s]
    return out


def test_schedule_against_simulation():
    rng = np.random.default_rng(3)
    for _ in range(30):
        names = [f"s{i}" for i in range(int(rng.integers(1, 7)))]
        blocks = {s: int(rng.integers(0, 60)) for s in names}
        weights = mixing.target_weights({s: max(1, int(n)) for s, n in zip(names, rng.integers(1, 10**6, len(names)))})
        lanes = mixing.schedule(blocks, weights)
        got = sorted((int(lanes[s].slot(np.array([j]))[0]), s, j) for s, n in blocks.items() for j in range(n))
        assert [x[0] for x in got] == list(range(len(got))) and [(s, j) for _, s, j in got] == simulated(blocks, weights)


def test_mix_of_unequal_sources(spark):
    """A source with a third of all rows, one without name and one named None; every run of blocks before the first end has its shares."""
    rows = [(i, f"text {i}", "hot" if i % 3 == 0 else None if i % 3 == 1 and i % 2 else "None" if i % 9 == 1 else f"s{i % 5}", "x", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot string, _rank int").repartition(5)
    got = mixing.mix(docs, block=4).collect()
    assert sorted(r.position for r in got) == list(range(3000))
    blocks = {s: -(-n // 4) for s, n in Counter(r.source for r in got).items()}
    weights = mixing.target_weights(Counter(r[2] for r in rows))
    order = {s: f"{i}" for i, s in enumerate(sorted(blocks, key=lambda s: (s is None, str(s))))}
    plain = simulated({order[s]: n for s, n in blocks.items()}, {order[s]: w for s, w in weights.items()})
    assert {(r.slot, order[r.source], r.block) for r in got} == {(i, s, j) for i, (s, j) in enumerate(plain)}


def test_suffix_tree(odd):
    rows = suffix_tree.score_texts(odd, held(1, 5)).collect()
    assert len(rows) == len(ROWS) and all(r.score <= 0 and r.n_known <= r.n_tokens for r in rows)


class PlainTree:
    """The same model in dictionaries."""

    def __init__(self, texts, depth=suffix_tree.DEPTH, least=suffix_tree.LEAST, discount=suffix_tree.DISCOUNT):
        runs = [Counter(tuple(t[i - d : i]) for t in texts for i in range(d, len(t) + 1)) for d in range(depth + 2)]
        self.words, self.total = runs[1], sum(runs[1].values())
        self.scale = self.total + 0.5 * (len(self.words) + 1)
        self.states, self.after = {}, {}
        for d in range(1, depth + 1):
            follow = {}
            for g, n in runs[d + 1].items():
                if n >= least:
                    follow.setdefault(g[:-1], {})[g[-1]] = n
            fresh = {}
            for c, ws in follow.items():
                uses, seen = runs[d][c], sum(ws.values())
                below = {w: self.p(c[1:], w) for w in ws}
                divergence = sum(n * np.log(n / uses / below[w]) for w, n in ws.items())
                if uses > seen:
                    divergence += (uses - seen) * np.log((uses - seen) / uses / (1 - sum(below.values())))
                if divergence > 0.5 * (len(ws) + 1) * np.log(self.total):
                    rest = (uses - seen + discount * len(ws)) / uses
                    fresh[c] = (rest, {w: (n - discount) / uses for w, n in ws.items()})
            self.states |= fresh

    def p(self, context, word):
        while context and context not in self.states:
            context = context[1:]
        if not context:
            return (self.words[(word,)] + 0.5) / self.scale
        rest, own = self.states[context]
        return own.get(word, 0) + rest * self.p(context[1:], word)

    def score(self, text, depth=suffix_tree.DEPTH):
        return sum(np.log10(self.p(tuple(text[max(0, i - depth) : i]), w)) for i, w in enumerate(text))


def test_suffix_tree_against_brute_force(spark):
    rng, texts = np.random.default_rng(4), []
    for _ in range(400):
        t = ["a", "b"]
        for _ in range(int(rng.integers(0, 40))):
            old = int(t[-1], 36) * 5 + int(t[-2], 36) * 3
            t.append(np.base_repr((old + int(rng.integers(3))) % 30, 36).lower() if rng.random() < 0.8 else np.base_repr(int(rng.integers(36)), 36).lower())
        texts.append(t[: int(rng.integers(0, 43))])
    docs = spark.createDataFrame([(i, " ".join(t).upper()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    sizes = []
    got = {r.doc_id: r for r in suffix_tree.score_texts(docs, F.col("doc_id") % 5 == 1, sizes=sizes).collect()}
    ended = [[*t, "\n"] for t in texts]
    plain = PlainTree([t for i, t in enumerate(ended) if i % 5 != 1])
    assert {len(c) for c in plain.states} == {1, 2, 3}
    assert sum(x[3] for x in sizes) == len(plain.states)
    assert len(got) == len(texts)
    for i, t in enumerate(ended):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 5 == 1, len(t), sum(plain.words[(w,)] > 0 for w in t), plain.total)
        assert np.isclose(r.base_score, sum(np.log10(plain.p((), w)) for w in t)) and np.isclose(r.score, plain.score(t), rtol=1e-5)
    for c in list(plain.states)[:40]:  # every state's distribution adds up to one, with a word outside the corpus
        assert np.isclose(sum(plain.p(c, w) for (w,) in plain.words) + plain.p(c, "none"), 1)


def test_suffix_tree_learns_from_few_uses_in_a_large_corpus(spark):
    rows = [(0, "zig zag"), *[(i, "zig zag") for i in (1, 2, 3)], *[(i, "a " * 1_000_000) for i in range(4, 8)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_tree.score_texts(docs, F.col("doc_id") == 0).where("held_out").first()
    assert got.score > got.base_score + 3


def test_neighbours_recall(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [None] * 16), (None, [1.0] * 16)]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    d = x.astype(float)
    hit = 0
    for q in range(0, 1500, 20):
        s = d @ d[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & {r.vec_id for r in found if r.query_id == q})
    assert hit / (75 * 20) >= 0.9
    assert {r.query_id for r in found} == set(range(0, 1500, 20))
    assert all(np.isclose(r.score, d[r.query_id] @ d[r.vec_id]) for r in found[:200])


def test_sequences_of_the_pipeline_follow_the_mix(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(packing, "STRETCH_DOCS", 30, raising=False)
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 999, int(rng.integers(5, 200)))), "a" if i < 200 else "bc"[i % 2]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    stages = dict(corpus_pipeline.STAGES)
    packed = stages["packing"](spark, stages["mixing"](spark, docs, ""), "").orderBy("sequence_id", "offset").collect()
    source, seen = {r[0]: r[2] for r in rows}, list(dict.fromkeys(r.doc_id for r in packed))
    assert sorted(seen) == list(range(300))
    weights, first = mixing.target_weights(Counter(source.values())), Counter(source[x] for x in seen[:60])
    assert weights == {"a": 16, "b": 8, "c": 8} and all(abs(first[s] - 60 * w / 32) < mixing.BLOCK_DOCS for s, w in weights.items())  # 30, 15, 15
    ids = sorted({r.sequence_id for r in packed})
    assert ids == list(range(len(ids)))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 1024


def test_stages_with_clashing_columns(spark, odd, empty):
    """Columns named like those that operators add or use pass through; empty tables give empty tables."""
    import corpus_pipeline

    clash = odd.select("*", *(F.lit(7).alias(c) for c in ("runs", "lang_pred", "n_lines", "n_deleted", "_crc", "_rank", "_id", "_lang", "_score", "component_id", "node")))
    for docs in (clash, clash.limit(0)):
        kept = docs
        for name, stage in corpus_pipeline.STAGES[:3]:
            kept = corpus_pipeline.materialize(stage(spark, kept, ""), name)
            assert kept.columns == docs.columns
            assert {tuple(r)[-11:] for r in kept.collect()} <= {(7,) * 11} and (kept.count() > 0) == (docs.count() > 0)
        mixed = corpus_pipeline.STAGES[3][1](spark, kept.drop("slot", "block"), "")
        assert sorted(r.position for r in mixed.collect()) == list(range(kept.count()))
        assert corpus_pipeline.STAGES[4][1](spark, mixed, "").count() >= kept.count()
