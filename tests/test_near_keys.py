import numpy as np
import pytest

from kindred.operators import mih


@pytest.mark.parametrize("few", [0, 40, 1 << 16])
def test_near_keys_by_groups_of_any_size(spark, monkeypatch, few):
    """Several algorithms, hot blocks, groups over several batches, every radius: all pairs, each once, from the workers without a join."""
    monkeypatch.setattr(mih, "FEW", few)
    monkeypatch.setattr(mih, "AT_ONCE", 50)
    monkeypatch.setattr(mih.meet, "STRIP", 3)
    monkeypatch.setattr(mih.meet, "ROWS", 5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    rng = np.random.default_rng(9)
    base = [int(k) for k in rng.integers(-(2**63), 2**63, 12)]
    flip = lambda k, n: int(np.int64(k) ^ np.bitwise_or.reduce(np.int64(1) << rng.choice(63, n, replace=False)))
    rows = {(a, k) for a in "xy" for k in base} | {("x", flip(k, int(n))) for k in base for n in rng.integers(1, 12, 3)} | {("y", i) for i in range(20)}
    share = lambda off: any((off >> 8 * i) & 255 == 0 for i in range(8))
    try:
        for radius, complete in ((0, False), (3, False), (5, True), (9, True), (10, True), (10, False)):
            got = mih.near_keys(spark.createDataFrame([*rows, ("x", None)], "algo string, key long"), radius, complete)
            assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
            want = [(a, x, y) for a, x in rows for b, y in rows if a == b and (off := (x ^ y) & (2**64 - 1)).bit_count() <= radius and (complete or radius < 8 or share(off))]
            assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
