"""Classes of near copies against brute-force Jaccard similarity of five-word shingles."""

import numpy as np

from kindred.llm import near_copies


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sets_hold_each_shingle_once():
    found = [x or "" for x in made()]
    h, off = near_copies.shingle_sets(near_copies.pa.array(found))
    assert np.diff(off).tolist() == [len(shingles(x)) for x in found]
    for x, a, b in zip(found, off[:-1], off[1:]):
        assert (h[a:b] == near_copies.shingle_set(x.encode())).all()


def made(seed=3):
    """Texts with copies at every similarity from about 0.5 to 1."""
    rng, out = np.random.default_rng(seed), []
    for n in (40, 120, 400, 1500):
        for _ in range(6):
            base = [f"w{x}" for x in rng.integers(0, 5000, n)]
            out.append(base)
            for share in (0.002, 0.01, 0.02, 0.05):
                copy = list(base)
                for i in rng.choice(n, max(1, int(share * n)), replace=False):
                    copy[i] = f"new{rng.integers(10**9)}"
                out.append(copy)
            out.append([x.upper() for x in base])
    return [" ".join(x) for x in out] + [f"spam common words here every time number {i % 3}" for i in range(12)] + [None, "", "one"]


def test_classes_against_jaccard(spark):
    texts = made()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.similar(docs).collect()}
    assert len(got) == len(texts)
    own, missed, links = [shingles(t) for t in texts], 0, 0
    for i in range(len(texts)):
        for j in range(i):
            union = len(own[i] | own[j])
            sim = len(own[i] & own[j]) / union if union else 1.0
            if sim >= 0.85:
                links += 1
                missed += got[i] != got[j]
            if sim == 1:
                assert got[i] == got[j]
    assert links > 50 and missed <= 0.02 * links
    for i, c in got.items():  # nothing unlike joins: every class member has a partner of 0.7 or more
        if c != i:
            assert any(got[j] == c and j != i and len(own[i] & own[j]) >= 0.7 * len(own[i] | own[j]) for j in range(len(texts)))


def test_full_block_of_near_copies(spark):
    """Hundreds of different near copies and outsiders come to one class and classes of their own."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    copies = []
    for k in range(300):
        copy = list(base)
        copy[int(rng.integers(300))] = f"new{k}"
        copies.append(" ".join(copy))
    others = [" ".join(f"o{x}" for x in rng.integers(0, 5000, 300)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(copies + others)), "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == [0, *range(300, 400)]


def test_odd_rows(spark):
    rows = [(1, "a b", "x", 1, 2), (1, "a b", "x", 1, 2), (None, "c d e f g h", None, None, None), (2, None, None, 0, 0), (3, "", "y", 0, 0), (4, "A  b\n", "z", 3, 3), (5, "long " * 70000, "z", 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, node int, w long")
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5]
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def pairs_at(similarity, n, tag, size=300):
    """n pairs of texts, alone with each other, whose sets of shingles have about that similarity (the exact one comes with each)."""
    rng, out = np.random.default_rng(9), []
    while len(out) < n:
        base = [f"{tag}{x}" for x in rng.integers(0, 10**9, size)]
        other = list(base)
        while True:
            a, b = shingles(" ".join(base)), shingles(" ".join(other))
            exact = len(a & b) / len(a | b)
            if exact <= similarity + 0.012:
                break
            other[int(rng.integers(5, size - 5))] = f"n{rng.integers(10**12)}"
        out.append((" ".join(base), " ".join(other), exact))
    return out


def linked(spark, pairs):
    docs = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.similar(docs).collect()}
    return [got[2 * i + 1] == got[2 * i] for i in range(len(pairs))]


def test_single_pairs_from_the_threshold_on(spark):
    """Pairs without any helping chain are all found, from 0.80 to 0.85."""
    pairs = [p for s in (0.8, 0.82, 0.85) for p in pairs_at(s, 60, f"s{int(100 * s)}x")]
    above = [p for p in pairs if p[2] >= 0.8]
    assert len(above) > 100 and all(linked(spark, above))


def test_pairs_under_the_threshold_stay_apart(spark):
    pairs = [p for s in (0.7, 0.74, 0.76, 0.78) for p in pairs_at(s, 40, f"s{int(100 * s)}x")]
    assert all(0.65 < p[2] < 0.8 for p in pairs) and not any(linked(spark, pairs))


def test_stage_links_by_simhash_and_by_similarity(spark):
    """The pipeline's stage joins what op5 links, though sets are unlike, and pairs at 0.8 that op5 leaves apart."""
    import corpus_pipeline
    from kindred.llm import simhash

    rng, often = np.random.default_rng(11), "one two three four five six seven eight nine " * 200
    tails = [" ".join(f"t{x}" for x in rng.integers(0, 10**9, 40)) for _ in range(2)]
    repeated = [often + t for t in tails]  # the same shingles nearly always, but few of the different ones
    assert len(shingles(repeated[0]) & shingles(repeated[1])) < 0.3 * len(shingles(repeated[0]) | shingles(repeated[1]))
    assert bin(simhash.fingerprint(repeated[0].encode()) ^ simhash.fingerprint(repeated[1].encode())).count("1") <= 2
    pairs = [p for p in pairs_at(0.8, 20, "b") if p[2] >= 0.8]
    texts = repeated + [x for p in pairs for x in p[:2]] + tails[:1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    by_op5 = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert by_op5[1] == 0 and sum(by_op5[i] != i for i in range(2, len(texts))) < len(pairs)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()}
    assert kept == {0, *range(2, len(texts), 2)}


def test_stages_hand_little_to_a_worker_at_once(spark):
    """After any stage has begun, about 1 MB of rows goes to a Python worker at once; a longer row ends its batch, a smaller setting stays."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    def sizes(batches):
        for b in batches:
            yield near_copies.pa.RecordBatch.from_arrays([near_copies.pa.array([b.num_rows]), near_copies.pa.array([b.nbytes])], ["rows", "size"])

    key, rows = "spark.sql.execution.arrow.maxBytesPerBatch", [(i, f"word{i} two three four five six", "s", "en", i) for i in range(4)]
    for name, stage in corpus_pipeline.STAGES:
        own = spark.newSession()
        stage(own, own.createDataFrame(rows, "doc_id long, text string, source string, lang string, position long"), "")
        wide = own.range(0, 3000, 1, 1).select(F.repeat(F.lit("text "), F.when(F.col("id") == 9, 600_000).otherwise(400)).alias("text"))
        got = wide.mapInArrow(sizes, "rows long, size long").collect()
        assert sum(r.rows for r in got) == 3000 and max(r["size"] for r in got if r.rows > 1 and r["size"] < 3_000_000) < 1_200_000, name
        assert all(r["size"] < 4_200_000 for r in got), name
        own.conf.set(key, "5000")
        stage(own, own.createDataFrame(rows, "doc_id long, text string, source string, lang string, position long"), "")
        assert own.conf.get(key) == "5000"


def test_batches_do_not_change_what_stays(spark):
    small = spark.newSession()
    small.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4000)
    small.conf.set("spark.sql.parquet.columnarReaderBatchSize", 3)
    kept = [sorted(r.doc_id for r in near_copies.keep_one(s.createDataFrame(list(enumerate(made())), "doc_id long, text string").repartition(2)).collect()) for s in (spark, small)]
    assert kept[0] == kept[1]


def test_sketches_differ_in_no_more_bits_than_sets():
    found = [x or "" for x in made()]
    h, off = near_copies.shingle_sets(near_copies.pa.array(found))
    bits = np.unpackbits(near_copies.sketches(h, off).view(np.uint8), axis=1).astype(int)
    sets = [set(h[a:b].tolist()) for a, b in zip(off[:-1], off[1:])]
    assert all((bits[i] != bits[j]).sum() <= len(sets[i] ^ sets[j]) for i in range(0, len(sets), 3) for j in range(i))


def test_block_of_members_not_alike_forms_few_pairs(spark, monkeypatch):
    """Copies of one text, each unlike all others, share rare shingles; their pairs are not formed, and all stay."""
    rng, formed = np.random.default_rng(21), []
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    texts = []
    for k in range(200):
        copy = list(base)
        for i in rng.choice(300, 6, replace=False):
            copy[i] = f"new{k}x{i}"
        texts.append(" ".join(copy))
    own = [shingles(t) for t in texts]
    apart = [i for i in range(200) if all(len(own[i] & own[j]) < 0.8 * len(own[i] | own[j]) for j in range(200) if j != i)]
    assert len(apart) > 190
    verified = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, fps: (formed.append(pairs.count()), verified(pairs, fps))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.similar(docs).collect()}
    assert len(got) == 200 and all(sum(c == got[i] for c in got.values()) == 1 for i in apart)
    assert formed[-1] < 2000, formed
