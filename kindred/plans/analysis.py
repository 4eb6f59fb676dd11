"""Queries of compare, smart compare, crops, descriptors, ownership and the store's records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kindred.functions import bits, kernels, raster
from kindred.functions import crops as crop_functions
from kindred.operators import compare, crops, descriptors, grouping, mih, neighbours, ownership
from kindred.plans.catalogue import _BASE, _HASHES, _KNN, _NEAR, _RASTERS, _VOTES, _ALL, _FAMILY, _oriented, _turn, family_keys, gate_confirmed, query, rasters, table
from kindred.sources import ingest, store
from kindred.sources.scratch import materialize

GATE = ["dhash"]
_BITS = "bit_count(xor(a.key, b.key))"


def plain_keys(spark, sf_dir):
    """Average hashes of the family as it is, without turning."""
    return materialize(raster.family(rasters(spark, sf_dir)).select("image_id", F.lit("ahash").alias("algo"), raster.average_hash("q").alias("key")), "keys")


_PLAIN = f"{_RASTERS}, {_FAMILY}, k AS (SELECT image_id, {_HASHES['ahash']} AS key FROM family)"
_COMPARED = f"p AS (SELECT a.image_id AS i, b.image_id AS j, 1 - {_BITS} / 64.0 AS score FROM k a JOIN k b ON a.image_id < b.image_id AND {_BITS} <= {compare.radius_of(compare.THRESHOLD)}), e AS (SELECT i AS u, j AS v FROM p UNION SELECT j, i FROM p), r(u, v) AS (SELECT u, u FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u), m AS (SELECT u AS image_id, min(v) AS group_id FROM r GROUP BY u)"


@query(f"WITH {_RASTERS}, k AS (SELECT vec_id, {_HASHES['ahash']} AS key FROM rasters) SELECT a.vec_id AS i, b.vec_id AS j, round(1 - {_BITS} / 64.0, 4)::DOUBLE AS score FROM k a JOIN k b ON a.vec_id < b.vec_id")
def pair_matrix(spark, sf_dir):
    """The upper triangle of the score matrix, as it is asked for in whole."""
    scores = F.array(*[F.round(F.lit(1 - d / 64), 4) for d in range(65)])  # rounded once, not once a pair
    return mih.similar(rasters(spark, sf_dir).select("vec_id", raster.average_hash("q").alias("key")), 0.0).select(F.col("a").alias("i"), F.col("b").alias("j"), F.get(scores, "hamming").alias("score"))


@query(f"WITH {_BASE}, own AS (SELECT DISTINCT image_id, algo, key FROM keys WHERE algo = 'dhash') SELECT a.image_id AS i, b.image_id AS j, a.algo, (1 - min({_BITS}) / 64.0)::DOUBLE AS score FROM own a JOIN own b ON a.image_id < b.image_id AND {_BITS} <= {compare.radius_of(compare.THRESHOLD)} GROUP BY 1, 2, 3")
def variant_max_pairs(spark, sf_dir):
    return compare.algorithm_pairs(family_keys(spark, sf_dir).where("algo = 'dhash'"), compare.THRESHOLD)


@query(f"WITH {_BASE}, own AS (SELECT image_id, algo, variant_idx, key FROM keys WHERE algo = 'dhash') SELECT a.image_id AS i, b.image_id AS j, a.algo, (1 - min({_BITS}) / 64.0)::DOUBLE AS score FROM own a JOIN own b ON a.variant_idx = b.variant_idx AND a.image_id < b.image_id AND {_BITS} <= {compare.radius_of(compare.THRESHOLD)} GROUP BY 1, 2, 3")
def same_orientation_pairs(spark, sf_dir):
    """The older mode of variant_max_pairs."""
    return compare.same_orientation_pairs(family_keys(spark, sf_dir).where("algo = 'dhash'"), compare.THRESHOLD)


def _compared(spark, sf_dir):
    keys = plain_keys(spark, sf_dir)
    return keys, materialize(grouping.members(compare.algorithm_pairs(keys, compare.THRESHOLD)), "members")


@query(f"WITH RECURSIVE {_PLAIN}, {_COMPARED}, s AS (SELECT x.group_id, round(avg(1 - {_BITS} / 64.0), 4) AS avg_similarity FROM m x JOIN m y ON x.group_id = y.group_id AND x.image_id < y.image_id JOIN k a ON a.image_id = x.image_id JOIN k b ON b.image_id = y.image_id GROUP BY 1) SELECT group_id, count(*) AS n_images, any_value(avg_similarity)::DOUBLE AS avg_similarity FROM m JOIN s USING (group_id) GROUP BY group_id")
def compare_groups(spark, sf_dir):
    return compare.group_averages(*_compared(spark, sf_dir))


@query(f"WITH RECURSIVE {_PLAIN}, {_COMPARED} SELECT image_id FROM k WHERE image_id NOT IN (SELECT image_id FROM m)")
def compare_unique(spark, sf_dir):
    keys, placed = _compared(spark, sf_dir)
    return keys.select("image_id").join(placed, "image_id", "left_anti")


@query(f"WITH RECURSIVE {_PLAIN}, {_COMPARED} SELECT (SELECT count(*) FROM k) AS total_images, (SELECT count(DISTINCT group_id) FROM m) AS groups_count, (SELECT count(*) FROM m) AS duplicates, (SELECT count(*) FROM k) - (SELECT count(*) FROM m) AS unique_count, round(100.0 * (SELECT count(*) FROM m) / (SELECT count(*) FROM k), 1)::DOUBLE AS duplicate_rate")
def report_summary(spark, sf_dir):
    return compare.report(*_compared(spark, sf_dir))


_SMART_HITS = f"own AS (SELECT DISTINCT image_id, algo, key FROM keys), hits AS (SELECT a.image_id AS i, b.image_id AS j, a.algo, 1 - min({_BITS}) / 64.0 AS score FROM own a JOIN own b ON a.algo = b.algo AND a.image_id < b.image_id AND {_BITS} <= {compare.radius_of(compare.SMART_THRESHOLD)} GROUP BY 1, 2, 3), said AS (SELECT i, j, count(*) AS n_agree, string_agg(algo, ',' ORDER BY algo) AS algorithms, bool_or(algo IN ('dhash')) AS gated, max(score)::DOUBLE AS score FROM hits GROUP BY 1, 2)"


@query(f"WITH {_BASE}, {_SMART_HITS} SELECT * FROM said")
def smart_votes(spark, sf_dir):
    return compare.smart_votes(family_keys(spark, sf_dir), GATE)


@query(f"WITH {_BASE}, {_SMART_HITS} SELECT * FROM said WHERE n_agree >= {compare.MIN_AGREE} AND gated")
def smart_confirmed(spark, sf_dir):
    return compare.smart_confirmed(smart_votes(spark, sf_dir))


@query(f"WITH RECURSIVE {_BASE}, {_SMART_HITS}, c AS (SELECT * FROM said WHERE n_agree >= {compare.MIN_AGREE} AND gated), e AS (SELECT i AS u, j AS v FROM c UNION SELECT j, i FROM c), r(u, v) AS (SELECT u, u FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u), m AS (SELECT u AS image_id, min(v) AS group_id FROM r GROUP BY u), w AS (SELECT x.group_id, max(h.score)::DOUBLE AS confidence, string_agg(DISTINCT h.algo, ',' ORDER BY h.algo) AS algorithms FROM hits h JOIN m x ON x.image_id = h.i JOIN m y ON y.image_id = h.j AND x.group_id = y.group_id GROUP BY 1) SELECT group_id, count(*) AS n_images, string_agg(image_id::VARCHAR, ',' ORDER BY image_id) AS members, any_value(confidence) AS confidence, any_value(algorithms) AS algorithms FROM m JOIN w USING (group_id) GROUP BY group_id")
def smart_groups(spark, sf_dir):
    return compare.smart_groups(materialize(smart_votes(spark, sf_dir), "votes"))


@query(f"WITH RECURSIVE {_BASE}, {_SMART_HITS}, c AS (SELECT * FROM said WHERE n_agree >= {compare.MIN_AGREE} AND gated), e AS (SELECT i AS u, j AS v FROM c UNION SELECT j, i FROM c), r(u, v) AS (SELECT u, u FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u), m AS (SELECT u AS image_id, min(v) AS group_id FROM r GROUP BY u), w AS (SELECT x.group_id, max(h.score)::DOUBLE AS confidence, string_agg(DISTINCT h.algo, ',' ORDER BY h.algo) AS algorithms FROM hits h JOIN c USING (i, j) JOIN m x ON x.image_id = h.i GROUP BY 1) SELECT group_id, count(*) AS n_images, string_agg(image_id::VARCHAR, ',' ORDER BY image_id) AS members, any_value(confidence) AS confidence, any_value(algorithms) AS algorithms FROM m JOIN w USING (group_id) GROUP BY group_id")
def smart_groups_confirmed(spark, sf_dir):
    """The older mode of smart_groups: only confirmed pairs count for the confidence and the algorithms."""
    return compare.smart_groups(materialize(compare.smart_confirmed(smart_votes(spark, sf_dir)), "votes"))


@query(_ALL + "SELECT image_id % 10 AS member, count(*) AS n_grouped, sum(CASE WHEN group_id = image_id - image_id % 10 THEN 1 ELSE 0 END)::BIGINT AS with_original FROM members GROUP BY 1")
def group_recovery_by_family(spark, sf_dir):
    placed = grouping.members(gate_confirmed(spark, sf_dir))
    member = F.col("image_id") % 10
    return placed.groupBy(member.alias("member")).agg(F.count("*").alias("n_grouped"), F.count_if(F.col("group_id") == F.col("image_id") - member).alias("with_original"))


_CROPS = f"drawn AS ({' UNION ALL '.join(f'SELECT image_id, {_turn('q', p)} AS q FROM family' for p in crop_functions.PLACES)}), crop AS (SELECT DISTINCT image_id, {_HASHES['ahash']} AS key FROM drawn)"
_CROP_SAME = "(" + " OR ".join(f"((a.key >> {8 * i}) & 255) = ((b.key >> {8 * i}) & 255)" for i in range(8)) + ")"
_CROP_HITS = f"own AS (SELECT DISTINCT key FROM crop), near AS (SELECT a.key AS x, b.key AS y FROM own a JOIN own b ON {_BITS} <= {crops.CROP_RADIUS} AND {_CROP_SAME}), hits AS (SELECT a.image_id AS i, b.image_id AS j, count(DISTINCT a.key) AS hits FROM crop a JOIN near n ON a.key = n.x JOIN crop b ON b.key = n.y WHERE a.image_id <> b.image_id GROUP BY 1, 2)"


def _crop_keys(spark, sf_dir):
    return materialize(crop_functions.crop_keys(raster.family(rasters(spark, sf_dir))), "crop_keys")


@query(f"WITH {_RASTERS}, {_FAMILY}, {_CROPS} SELECT * FROM crop")
def crop_keys(spark, sf_dir):
    return _crop_keys(spark, sf_dir)


@query(f"WITH {_RASTERS}, {_FAMILY}, {_CROPS}, {_CROP_HITS} SELECT * FROM hits")
def crop_hit_counts(spark, sf_dir):
    return crops.hit_counts(_crop_keys(spark, sf_dir))


@query(f"WITH {_RASTERS}, {_FAMILY}, {_CROPS}, {_CROP_HITS} SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM hits WHERE hits >= {crops.MIN_HITS}")
def crop_candidates(spark, sf_dir):
    return crops.candidates(_crop_keys(spark, sf_dir))


@query(_KNN.replace("WITH e", f"WITH {_BASE}, {_NEAR}, {_VOTES}, e") + f"SELECT i, j FROM votes WHERE votes >= {mih.MIN_VOTES} UNION SELECT least(a, b) * 10, greatest(a, b) * 10 FROM r WHERE rank <= 32 AND score >= 0.3")
def candidate_union(spark, sf_dir):
    near = neighbours.candidate_pairs(table(spark, sf_dir, "embeddings"), 32, 0.3)
    return crops.union_pairs(mih.candidates(family_keys(spark, sf_dir)), near.select((F.col("i") * 10).alias("i"), (F.col("j") * 10).alias("j")))


_SETS = f"{_RASTERS}, d AS (SELECT e.label AS set_id, e.vec_id AS idx, {_HASHES['ahash']} AS key FROM embeddings e JOIN rasters USING (vec_id)), dist AS (SELECT a.set_id AS a_set, b.set_id AS b_set, a.idx AS a, b.idx AS b, {_BITS}::INT AS distance FROM d a JOIN d b ON a.set_id < b.set_id), ra AS (SELECT *, row_number() OVER (PARTITION BY a_set, b_set, a ORDER BY distance, b) AS x, row_number() OVER (PARTITION BY a_set, b_set, b ORDER BY distance, a) AS y FROM dist), mutual AS (SELECT a_set, b_set, a, b, distance FROM ra WHERE x = 1 AND y = 1)"


def _sets(spark, sf_dir):
    """Rasters with the same label as one image's set of descriptors."""
    rows = table(spark, sf_dir, "embeddings").repartition(spark.sparkContext.defaultParallelism, "vec_id").select("vec_id", "label", raster.quantize(F.col("embedding")).alias("q"))
    return materialize(rows.select(F.col("label").alias("set_id"), F.col("vec_id").alias("idx"), raster.average_hash("q").alias("key")), "descriptors")


@query(f"WITH {_SETS} SELECT * FROM mutual")
def cross_check_matches(spark, sf_dir):
    return descriptors.cross_check(_sets(spark, sf_dir))


@query(f"WITH {_SETS} SELECT x.a_set, x.b_set, x.a, x.b, x.distance AS best, y.distance AS second FROM ra x JOIN ra y ON x.a_set = y.a_set AND x.b_set = y.b_set AND x.a = y.a WHERE x.x = 1 AND y.x = 2 AND x.distance < 0.9 * y.distance")
def ratio_matches(spark, sf_dir):
    return descriptors.ratio_matches(_sets(spark, sf_dir), 0.9)


@query(f"WITH {_SETS}, t AS (SELECT *, row_number() OVER (PARTITION BY a_set, b_set ORDER BY distance, a) AS r FROM mutual) SELECT a_set, b_set, count(*) AS matches, round((1 - avg(distance) / 64) * least(count(*) / 64.0, 1.0), 6)::DOUBLE AS score FROM t WHERE r <= 64 GROUP BY 1, 2")
def match_score(spark, sf_dir):
    return descriptors.match_score(_sets(spark, sf_dir))


_SHARDS = f"WITH {_BASE}, s AS (SELECT algo, ((key >> 56) & 255)::INT AS shard, image_id, variant_idx, key FROM keys)"


def _shards(spark, sf_dir):
    return family_keys(spark, sf_dir).withColumn("shard", bits.shard_id(F.col("key")).cast("int"))


@query(_SHARDS + ", d AS (SELECT DISTINCT algo, shard FROM s) SELECT a.algo, a.shard, count(*) AS n_probed FROM d a JOIN d b ON a.algo = b.algo AND bit_count(xor(a.shard, b.shard)) <= 2 GROUP BY 1, 2")
def shard_probe_fanout(spark, sf_dir):
    return ownership.probe_fanout(_shards(spark, sf_dir).select("algo", "shard").distinct(), 2)


@query(_SHARDS + f" SELECT algo, CASE {' '.join(f'WHEN shard < {b} THEN {i}' for i, (_, b) in enumerate(ownership.even_ranges(256, 3)))} END AS node, count(*) AS n_keys FROM s GROUP BY 1, 2")
def node_ownership(spark, sf_dir):
    node = ownership.owner_of(F.col("shard"), ownership.even_ranges(ownership.SHARDS, 3))
    return _shards(spark, sf_dir).groupBy("algo", node.alias("node")).agg(F.count("*").alias("n_keys"))


@query(_SHARDS + " SELECT algo, count(*) AS n_rows, sum(('0x' || substr(md5(image_id || ':' || variant_idx || ':' || key), 1, 8))::BIGINT)::BIGINT AS fingerprint FROM s GROUP BY 1")
def gate_fingerprint(spark, sf_dir):
    return ownership.fingerprint(family_keys(spark, sf_dir), F.concat_ws(":", "image_id", "variant_idx", "key"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS slot FROM orders")
def owner_plan(spark, sf_dir):
    return ownership.dense_slots(table(spark, sf_dir, "orders"), "o_orderkey")


_EMBED = "list_transform(range(16), lambda c: (" + " + ".join(f"q[16 * (c // 4) + 2 * (c % 4) + {k}]" for k in (1, 2, 9, 10)) + ") / 4.0::DOUBLE)"


@query(f"WITH {_RASTERS}, b AS (SELECT vec_id, {_EMBED} AS m FROM rasters) SELECT vec_id, array_to_string(list_transform(m, lambda v: floor((v - list_sum(m) / 16) * 64)::BIGINT), ',') AS vector FROM b")
def stub_embed(spark, sf_dir):
    return rasters(spark, sf_dir).select("vec_id", F.array_join(F.transform(raster.block_means("q"), lambda v: F.floor(v * 64)).cast("array<string>"), ",").alias("vector"))


@query(f"WITH {_RASTERS}, t AS ({_oriented('rasters', 'vec_id')}), k AS (SELECT vec_id, variant_idx, {_HASHES['dhash']} AS key FROM t) SELECT vec_id, count(*) AS n_variants, count(DISTINCT key) AS n_keys FROM k GROUP BY 1 HAVING count(*) = 8")
def full_gate(spark, sf_dir):
    turned = raster.variants(rasters(spark, sf_dir)).select("vec_id", raster.difference_hash("q").alias("key"))
    return turned.groupBy("vec_id").agg(F.count("*").alias("n_variants"), F.count_distinct("key").alias("n_keys")).where("n_variants = 8")


@query("SELECT doc_id, lang, source, n_chars, sha256(text) AS file_hash FROM documents WHERE n_chars IS NOT NULL")
def image_meta(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("n_chars is not null").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("file_hash"))


@query("SELECT o_orderkey, count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_suppkey END) AS n_algorithms FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus HAVING o_orderstatus <> 'F' OR count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_suppkey END) < 3")
def backfill_due(spark, sf_dir):
    return store.backfill_due(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("pending").alias("feature_status")), table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("image_id"), F.col("l_suppkey").alias("algorithm")), 3).select(F.col("image_id").alias("o_orderkey"), "n_algorithms")


_CACHE = "cache AS (SELECT least(l_partkey, l_suppkey) AS hash_a, greatest(l_partkey, l_suppkey) AS hash_b, l_shipmode_ AS algorithm, max(l_quantity) AS score FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem) GROUP BY 1, 2, 3)"


def _cache(spark, sf_dir):
    a, b = store.ordered_pair(F.col("l_partkey"), F.col("l_suppkey"))
    return table(spark, sf_dir, "lineitem").groupBy(a, b, F.col("l_returnflag").alias("algorithm")).agg(F.max("l_quantity").alias("score"))


@query(f"WITH {_CACHE} SELECT s_suppkey, algorithm, count(*) AS n_pairs, max(score) AS best FROM supplier JOIN cache ON s_suppkey = hash_a GROUP BY 1, 2")
def pair_cache_lookup(spark, sf_dir):
    held = _cache(spark, sf_dir).join(table(spark, sf_dir, "supplier").select("s_suppkey"), F.expr("s_suppkey = hash_a"))
    return held.groupBy("s_suppkey", "algorithm").agg(F.count("*").alias("n_pairs"), F.max("score").alias("best"))


@query(f"WITH {_CACHE}, gone AS (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) SELECT * FROM cache WHERE hash_a NOT IN (SELECT * FROM gone) AND hash_b NOT IN (SELECT * FROM gone)")
def pair_cache_prune(spark, sf_dir):
    return store.prune_pairs(_cache(spark, sf_dir), table(spark, sf_dir, "supplier").where("s_nationkey < 5").select("s_suppkey"))


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id = 7 ORDER BY event_id DESC")
def runs_descending(spark, sf_dir):
    return table(spark, sf_dir, "events").where("user_id = 7").select("event_id", "user_id", "event_type").orderBy(F.desc("event_id"))


@query("SELECT event_type, '{\"total\":' || count(*) || ',\"first\":' || min(event_id) || ',\"users\":' || count(DISTINCT user_id) || '}' AS summary FROM events GROUP BY 1")
def run_summary_json(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("total"), F.min("event_id").alias("first"), F.count_distinct("user_id").alias("users"))
    return runs.select("event_type", F.to_json(F.struct("total", "first", "users")).alias("summary"))


@query("SELECT user_id, count(*) AS n_events, string_agg(event_type, '>' ORDER BY event_id) AS transitions FROM events GROUP BY 1")
def status_transitions(spark, sf_dir):
    steps = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("s"))
    return steps.select("user_id", F.size("s").cast("long").alias("n_events"), F.array_join(F.col("s.event_type"), ">").alias("transitions"))


# Endings of the files listed, as they come in turn: of images, of documents, others.
_ENDS = [f".{x}" for x in (*store.IMAGE_EXTENSIONS, *store.DOCUMENT_EXTENSIONS)] + [".JPG", ".Png", ".PDF", ".txt", ".svg", ".tar.gz", ".", ""]
_IN_TURN = f"[{', '.join(repr(x) for x in _ENDS)}][page_id % {len(_ENDS)} + 1]"


@query(f"WITH f AS (SELECT page_id, lower(regexp_extract('page' || page_id || {_IN_TURN}, '\\.([^.]+)$', 1)) AS extension FROM pages) SELECT page_id, extension, extension IN {store.IMAGE_EXTENSIONS} AS is_image, extension IN {store.DOCUMENT_EXTENSIONS} AS is_document FROM f")
def extension_filter(spark, sf_dir):
    ends = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("page_id") % len(_ENDS) + 1).cast("int"))
    named = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page"), F.col("page_id").cast("string"), ends).alias("filename"))
    kind = store.extension(F.col("filename"))
    return named.select("page_id", kind.alias("extension"), kind.isin(*store.IMAGE_EXTENSIONS).alias("is_image"), kind.isin(*store.DOCUMENT_EXTENSIONS).alias("is_document"))


# First bytes of files, as they come in turn, and what they are.
_HEADS = [
    ("FFD8FFE000", "jpg"), ("89504E470D0A1A0A00", "png"), ("474946383761", "gif"), ("474946383961", "gif"), ("474946383861", "jpg"),
    ("424D00", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("52494646000000005745425000", "webp"), ("524946460000000057454250", "jpg"),
    ("52494646000000005741564500", "jpg"), ("716F696600", "qoi"), ("0001020304", "jpg"), ("", "jpg"),
]


@query(f"SELECT page_id, [{', '.join(repr(x) for _, x in _HEADS)}][page_id % {len(_HEADS)} + 1] AS extension FROM pages")
def format_sniff(spark, sf_dir):
    heads = F.element_at(F.array(*(F.lit(x) for x, _ in _HEADS)), (F.col("page_id") % len(_HEADS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", store.sniffed(F.unhex(heads)).alias("extension"))


@query(f"WITH {_RASTERS}, k AS (SELECT vec_id, {_HASHES['ahash']} AS key FROM rasters), p AS (SELECT a.vec_id AS probe_id, b.vec_id AS image_id, (1 - {_BITS} / 64.0)::DOUBLE AS score FROM k a JOIN k b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, image_id)::INT AS rank FROM p WHERE score >= 0.5) SELECT probe_id, image_id, score, rank FROM r WHERE rank <= 10")
def similar_images(spark, sf_dir):
    """The ten most like each probe (ids divisible by 50), among all."""
    keys = rasters(spark, sf_dir).select(F.col("vec_id").alias("image_id"), raster.average_hash("q").alias("key"), F.col("vec_id").cast("string").alias("file_hash"))
    return compare.similar_to(keys, keys.where("image_id % 50 = 0"), 10, 0.5)


def _pictures(spark, sf_dir):
    """Rasters as 8-bit gray pictures: 128 and a 16th of the quantised value, within 0 to 255."""
    level = F.transform("q", lambda v: F.least(F.greatest(F.floor(v / 16) + 128, F.lit(0)), F.lit(255)))
    hexed = F.array_join(F.transform(level, lambda v: F.lpad(F.hex(v), 2, "0")), "")
    return rasters(spark, sf_dir).select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.unhex(hexed).alias("data"))


@query()
def raster_features(spark, sf_dir):
    """All signatures of all rasters in numpy; floats decide bits, so there is no SQL for it."""
    return ingest.features(_pictures(spark, sf_dir))


@query()
def slice_coverage(spark, sf_dir):
    """How the quarters of each raster are found in its neighbour by id, and in itself turned."""
    rows = _pictures(spark, sf_dir).select("image_id", "data")
    other = rows.select((F.col("image_id") - 1).alias("image_id"), F.col("data").alias("other"))

    def step(batches):
        for batch in batches:
            out = []
            for i, a, b in zip(batch["image_id"], batch["data"], batch["other"]):
                x = np.frombuffer(bytes(a), np.uint8).reshape(8, 8)
                y = np.rot90(x) if b is None else np.frombuffer(bytes(b), np.uint8).reshape(8, 8)
                for name, z in (("neighbour", y), ("turned", np.rot90(x))):
                    found = kernels.slice_match(x, z)
                    out.append((i, name, found["coverage"], found["mean_score"], found["is_slice_of_a"]))
            yield pd.DataFrame(out, columns=["image_id", "against", "coverage", "mean_score", "is_slice"])

    return rows.join(other, "image_id", "left").mapInPandas(step, "image_id long, against string, coverage double, mean_score double, is_slice boolean")
