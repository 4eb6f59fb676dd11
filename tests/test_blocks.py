import numpy as np
import pytest

from kindred.operators import blocks, compare, crops, descriptors, mih, neighbours


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def moved(df):
    """What the plan shuffles or joins."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in ("Exchange", "Join", "Cartesian") if x in plan]


def small_files(monkeypatch, rows=9):
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    monkeypatch.setattr(blocks, "STRIP", 4)
    monkeypatch.setattr(blocks, "ROWS", rows)


def test_vectors_meet_without_a_shuffle(spark, monkeypatch):
    small_files(monkeypatch)
    x = np.random.default_rng(1).normal(size=(60, 8))
    x[20:26], x[31] = x[3], 0  # ties over several files
    df = frame(spark, x)
    u = neighbours.unit(x.astype(np.float32).astype(float))
    s = np.round(u @ u.T, 9)
    got = neighbours.nearest(df, 12)
    assert moved(got) == []
    rows = {(r.a, r["rank"]): r.b for r in got.collect()}
    assert rows == {(a, k + 1): b for a in range(60) for k, b in enumerate(sorted((j for j in range(60) if j != a), key=lambda j: (-s[a, j], j))[:12])}
    assert len(neighbours.nearest(df.limit(5), 12).collect()) == 20


@pytest.mark.parametrize("measure", [neighbours.cosine, neighbours.centred_cosine, neighbours.correlation, neighbours.exp_distance])
def test_pairs_without_a_shuffle(spark, monkeypatch, measure):
    small_files(monkeypatch)
    x = np.round(np.random.default_rng(2).normal(size=(60, 8)), 1).astype(np.float32)
    x[20:26], x[31] = x[3], 0
    for least in (0.0, 0.3, 1.0):
        got = neighbours.pairs(frame(spark, x), measure, least)
        assert moved(got) == []
        want = np.round(measure(x.astype(float), x.astype(float)), 6)
        assert sorted((r.a, r.b, r.score) for r in got.collect()) == [(i, j, pytest.approx(want[i, j], abs=1.1e-6)) for i in range(60) for j in range(i + 1, 60) if want[i, j] >= least]


def test_descriptors_meet_without_their_pairs(spark, monkeypatch):
    small_files(monkeypatch)
    rng = np.random.default_rng(3)
    keys = [int(k) for k in rng.integers(-(2**63), 2**63, 50)]
    keys += [k ^ (1 << int(rng.integers(0, 63))) for k in keys[:20]] + keys[:5]
    sets = [int(s) for s in rng.integers(0, 4, len(keys))] + [9]
    keys.append(keys[0])  # a set of one: no second
    rows = list(zip(sets, range(len(keys)), keys))
    df = spark.createDataFrame([*rows, (1, 99, None)], "set_id int, idx long, key long")
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    near = {}  # (set, other): of each index, distance and index of the others by nearness
    for s, i, k in rows:
        for o in {*sets} - {s}:
            near[s, o, i] = sorted((far(k, q), j) for t, j, q in rows if t == o)
    got = {tuple(r) for r in descriptors.cross_check(df).collect()}
    assert got == {(s, o, i, n[0][1], n[0][0]) for (s, o, i), n in near.items() if s < o and near[o, s, n[0][1]][0][1] == i}
    plan = descriptors.ratio_matches(df, 0.9)
    assert moved(plan) == []
    assert {tuple(r) for r in plan.collect()} == {(s, o, i, n[0][1], n[0][0], n[1][0]) for (s, o, i), n in near.items() if s < o and len(n) > 1 and n[0][0] < 0.9 * n[1][0]}


def test_keys_meet_without_their_pairs(spark, monkeypatch):
    small_files(monkeypatch)
    rng = np.random.default_rng(4)
    keys = [int(k) for k in rng.integers(-(2**63), 2**63, 40)]
    keys += [keys[0]] * 12 + [k ^ 5 for k in keys[:8]]
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    df = spark.createDataFrame([*enumerate(keys), (99, None)], "vec_id long, key long")
    for threshold in (0.0, 0.55, 1.0):
        got = mih.similar(df, threshold)
        assert moved(got) == []
        assert sorted(tuple(r) for r in got.collect()) == [(i, j, d, 1 - d / 64) for i in range(60) for j in range(i + 1, 60) if 1 - (d := far(keys[i], keys[j])) / 64 >= threshold]
    held = df.selectExpr("vec_id as image_id", "key", "string(vec_id % 50) as file_hash")
    got = compare.similar_to(held, held.where("image_id % 3 = 0"), 7, 0.5)
    assert moved(got) == []
    want = {i: sorted((far(keys[i], keys[j]), j) for j in range(60) if i % 50 != j % 50 and far(keys[i], keys[j]) <= 32)[:7] for i in range(0, 60, 3)}
    assert sorted(tuple(r) for r in got.collect()) == [(i, j, 1 - d / 64, k + 1) for i, j, d, k in sorted((i, j, d, k) for i, x in want.items() for k, (d, j) in enumerate(x))]


@pytest.mark.parametrize("few", [0, 1024])
def test_crops_meet_without_a_shuffle_of_hits(spark, monkeypatch, few):
    small_files(monkeypatch)
    monkeypatch.setattr(crops, "FEW", few)
    rng = np.random.default_rng(5)
    pool = [int(k) for k in rng.integers(-(2**63), 2**63, 12)]
    rows = {(i, pool[int(rng.integers(0, 12))] ^ int(1 << int(rng.integers(0, 8)) if rng.random() < 0.5 else 0)) for i in range(40) for _ in range(4)} | {(i, 7) for i in range(30)}
    df = spark.createDataFrame(sorted(rows), "image_id long, key long")
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    keys = {i: {k for o, k in rows if o == i} for i in range(40)}
    want = {(i, j): n for i in keys for j in keys if i != j and (n := sum(any(near(a, b) for b in keys[j]) for a in keys[i]))}
    got, found = crops.hit_counts(df), crops.candidates(df)
    assert moved(got) == moved(found) == []
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, j, n) for (i, j), n in want.items())
    assert sorted(tuple(r) for r in found.collect()) == sorted({(min(p), max(p)) for p, n in want.items() if n >= 2})
