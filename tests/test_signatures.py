import numpy as np
from pyspark.sql import functions as F

from kindred.functions import kernels, raster
from kindred.operators import grouping


def test_signatures_of_odd_rasters(spark):
    """Signatures in numpy are those of the column expressions, with nulls, short, long and flat rasters too."""
    rng = np.random.default_rng(6)
    rows = [(i, [int(v) for v in rng.integers(-900, 900, 64)]) for i in range(40)]
    rows += [(50, None), (51, []), (52, [5] * 64), (53, rows[0][1][:40]), (54, rows[1][1] + [7, 8]), (55, [None, *rows[2][1][1:]]), (56, [None] * 32 + rows[3][1][32:]), (57, rows[4][1][:32] + [-1] + [None] * 31), (58, [-1] * 63 + [-2])]
    images = spark.createDataFrame(rows, "image_id long, q array<int>").repartition(3)
    each = raster.variants(images)
    want = {(r.image_id, a, r.variant_idx, r[a]) for r in each.select("image_id", "variant_idx", *[h("q").alias(a) for a, h in raster.GATE.items()]).collect() for a in raster.GATE}
    got = raster.signatures(images)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(rows) * 24
    assert "transform" not in got._jdf.queryExecution().executedPlan().toString()  # no raster is turned a pixel at a time
    assert got.select(F.count("key")).first()[0] == len(rows) * 24


def test_a_scene_is_transformed_once(monkeypatch):
    """16 parts and one scene: 17 transforms, not 32; and weights of a size are worked out once."""
    made, real = [], np.fft.rfft2
    monkeypatch.setattr(np.fft, "rfft2", lambda *a: made.append(1) or real(*a))
    x = np.random.default_rng(7).integers(0, 256, (8, 8)).astype(np.uint8)
    assert kernels.slice_match(x, x)["coverage"] == 1.0 and len(made) == 17
    kernels.resize(x, 32, 32)
    before = kernels._weights.cache_info().misses
    kernels.resize(x, 32, 32)
    assert kernels._weights.cache_info().misses == before


def test_groups_read_their_pairs_once(spark, monkeypatch):
    """The work that makes the pairs is done once: groups() stands on a written table."""
    n = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            n.add(batch.num_rows)
            yield batch

    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.95), (7, 8, 0.86)], "i long, j long, score double").mapInArrow(count, "i long, j long, score double")
    assert sorted(tuple(r) for r in grouping.groups(pairs).collect()) == [(1, 3, "1,2,3", 0.95), (7, 2, "7,8", 0.86)]
    assert n.value == 3
