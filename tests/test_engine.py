import glob
import os
import random

import duckdb
import pytest

from kindred.functions import raster
from kindred.operators.components import connected_components
from kindred.operators.mih import near_keys
from kindred.plans import analysis  # noqa: F401  (adds its queries)
from kindred.plans.catalogue import ORACLE_SQL, QUERIES
from kindred.sources import ingest, store
from kindred.streaming.increment import run_increments

QUICK = ["raster_quantize", "orientation_variants", "ahash_bits", "mhash_bits", "canonical_rot64", "exact_duplicates", "project_image_counts", "images_page", "features_ready", "feature_upsert", "cascade_delete", "latest_run", "unique_key_suffix", "extract_links", "owner_plan", "stub_embed", "full_gate", "backfill_due", "pair_cache_lookup", "pair_cache_prune", "run_summary_json", "extension_filter", "format_sniff", "match_score", "cross_check_matches", "ratio_matches", "similar_images", "crop_candidates", "compare_groups", "same_orientation_pairs", "smart_groups_confirmed"]


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [sorted(map(tuple, x[cols].astype(str).values.tolist())) for x in (got, want)]
    assert rows[0] == rows[1]


def test_components_against_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(0, i) for i in range(400, 460)] + [(i, i + 1) for i in range(500, 540)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + [(7, None)], "u long, v long")).collect()}
    assert got == {x: find(x) for u, v in edges if u != v for x in (u, v)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_keys_against_brute_force(spark):
    rnd = random.Random(2)
    keys = [rnd.getrandbits(64) - 2**63 for _ in range(40)]
    keys += [k ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) for k in keys]
    got = {(r.a, r.b) for r in near_keys(spark.createDataFrame([("x", k) for k in keys], "algo string, key long"), 7).collect()}
    mask = 2**64 - 1
    share = lambda a, b: any((a >> 8 * i) & 255 == (b >> 8 * i) & 255 for i in range(8))
    assert got == {(a, b) for a in keys for b in keys if ((a ^ b) & mask).bit_count() <= 7 and share(a & mask, b & mask)}


def test_orientations_are_a_group():
    turned = [tuple(p) for p in raster.ORIENTATIONS]
    assert len(set(turned)) == 8
    assert all(tuple(a[i] for i in b) in turned for a in turned for b in turned)


def test_dedup_recovers_families(spark, sf_dir):
    found = QUERIES["dedup_groups"](spark, sf_dir).collect()
    assert len(found) == 500
    assert all(len({int(m) // 10 for m in r.members.split(",")}) == 1 and r.n_images == 5 for r in found)


def test_increments_equal_one_batch(spark, tmp_path):
    keys = [(i, "x", k) for i, k in enumerate([1, 3, 7, 1 << 40, (1 << 40) + 1, 1])]
    for n, part in enumerate((keys[:3], keys[3:])):
        spark.createDataFrame(part, "image_id long, algo string, key long").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema("image_id long, algo string, key long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run_increments(stream, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp"), 2).awaitTermination(120)
    got = {(r.image_id, r.prior_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(max(p), min(p)) for p in got} == {(a, b) for a, _, x in keys for b, _, y in keys if b < a and (x ^ y).bit_count() <= 2}


def test_names_formats_and_upserts_of_odd_rows(spark):
    names = ["a", "a", "a_1", "a", None, None, "p.x.jpg", "p.x.jpg", "p.x_1.jpg", "p.x.jpg", ".rc", ".rc", "", "", "_1", "a_1", "a_01", "_1.jpg", ".jpg", ".jpg"]
    rows = spark.createDataFrame(list(enumerate(names)), "_at long, name string")
    got = [r.unique_name for r in store.unique_names(rows, "name", "_at").orderBy("_at").collect()]
    assert got == ["a", "a_2", "a_1", "a_3", None, None, "p.x.jpg", "p.x_2.jpg", "p.x_1.jpg", "p.x_3.jpg", ".rc", ".rc_1", "", "_2", "_1", "a_1_1", "a_01", "_1.jpg", ".jpg", ".jpg_1"]
    assert store.unique_names(rows.limit(0), "name", "_at").count() == 0
    heads = [bytes.fromhex(x) for x, _ in analysis._HEADS]
    assert [ingest.sniff(x) for x in heads] == [x for _, x in analysis._HEADS]
    old = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    new = spark.createDataFrame([("b", 1), ("c", 1), (None, 3)], "v string, k int")
    assert sorted(store.upsert(old, new, ["k"]).collect(), key=str) == sorted([(1, "c"), (2, "y"), (3, None), (None, "z")], key=str)
    files = spark.createDataFrame([("a.JPG",), (".png",), ("d/.png",), ("d.x/f",), ("f.tar.gz",), (None,)], "n string")
    assert [r.e for r in files.select(store.extension(files.n).alias("e")).collect()] == ["jpg", "", "", "", "gz", None]
