import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import vec
from kindred.operators import compare, crops, neighbours, ownership
from kindred.operators.mih import near_keys


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(40, 6)), 2).astype(np.float32)
    x[7], x[9], x[11] = x[3], x[3], 0  # ties, repeated rows, zero
    df = frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None)])
    u = neighbours.unit(x.astype(float))
    score = np.round(u @ u.T, 6)
    got = {(r.a, r.b): r.score for r in neighbours.pairs(df, neighbours.cosine, 0.3).collect()}
    assert got == {(i, j): pytest.approx(min(1, score[i, j])) for i in range(40) for j in range(i + 1, 40) if score[i, j] >= 0.3}
    near = {(r.a, r["rank"]): r.b for r in neighbours.nearest(df, 3).collect()}
    s = np.round(u @ u.T, 9)
    for a in range(40):
        want = sorted((j for j in range(40) if j != a), key=lambda j: (-s[a, j], j))[:3]
        assert [near[a, k] for k in (1, 2, 3)] == want


def test_empty_and_single(spark):
    for rows in ([], [(1, [1.0, 2.0])]):
        df = frame(spark, rows)
        assert neighbours.pairs(df, neighbours.cosine, 0.0).count() == neighbours.nearest(df, 5).count() == 0


def test_column_kernels(spark):
    a, b = np.array([1.0, 2.0, -1.0]), np.array([0.5, 1.0, 3.0])
    row = spark.range(1).select(*[F.array(*map(F.lit, map(float, v))).alias(n) for n, v in (("a", a), ("b", b))]).select(vec.cosine(F.col("a"), F.col("b")), vec.exp_distance(F.col("a"), F.col("b"))).first()
    assert row[0] == pytest.approx(max(0, a @ b / np.linalg.norm(a) / np.linalg.norm(b))) and row[1] == pytest.approx(np.exp(-np.linalg.norm(a - b)))


def test_complete_near_keys(spark):
    rng = np.random.default_rng(8)
    base = [int(v) for v in rng.integers(-(2**62), 2**62, 25)]
    keys = base + [k ^ int(sum(1 << int(b) for b in rng.choice(62, 9, replace=False))) for k in base]
    df = spark.createDataFrame([("x", k) for k in keys], "algo string, key long")
    mask = 2**64 - 1
    for radius in (3, 9, 10):
        got = {(r.a, r.b) for r in near_keys(df, radius, complete=True).collect()}
        assert got == {(a, b) for a in keys for b in keys if ((a ^ b) & mask).bit_count() <= radius}


def test_group_average_without_pairs(spark):
    keys = [5, 7, 6, -1, 0]
    k = spark.createDataFrame(list(enumerate(keys)), "image_id long, key long")
    got = compare.group_averages(k, spark.createDataFrame([(i, 0) for i in range(5)], "image_id long, group_id long")).first()
    pairs = [1 - ((a ^ b) & (2**64 - 1)).bit_count() / 64 for n, a in enumerate(keys) for b in keys[:n]]
    assert got.n_images == 5 and got.avg_similarity == pytest.approx(sum(pairs) / len(pairs), abs=6e-5)
    with pytest.raises(ValueError):
        compare.radius_of(1.5)


def test_crop_hits_are_directional(spark):
    far = 0x0F0F0F0F0F0F0F0F
    keys = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, far)], "image_id long, key long")
    hits = {(r.i, r.j): r.hits for r in crops.hit_counts(keys).collect()}
    assert hits == {(1, 2): 2, (2, 1): 1}
    assert [tuple(r) for r in crops.candidates(keys).collect()] == [(1, 2)]


def test_ranges():
    assert ownership.even_ranges(10, 3) == [(0, 4), (4, 7), (7, 10)]
    with pytest.raises(ValueError):
        ownership.validate([(0, 4), (5, 256)])
