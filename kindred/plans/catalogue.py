"""All queries of the engine by name, and the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import bits, raster
from kindred.operators import grouping, mih, neighbours
from kindred.sources import store
from kindred.sources.scratch import materialize

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(spark.sparkContext.defaultParallelism, "vec_id")  # few rows in a file, much work a row
    return rows.select("vec_id", raster.quantize(F.col("embedding")).alias("q"))


def family_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate signatures of the family; written once, as the joins read them several times."""
    return materialize(raster.signatures(raster.family(rasters(spark, sf_dir))), "keys")


def joined(column: str) -> F.Column:
    return F.array_join(F.col(column).cast("array<string>"), ",")


def _turn(source: str, places: list[int]) -> str:
    return f"list_transform([{', '.join(str(p + 1) for p in places)}], lambda p: {source}[p])"


def _pack(flag: str) -> str:
    total = f"list_sum(list_transform(range(64), lambda i: CASE WHEN {flag} THEN pow(2, i)::HUGEINT ELSE 0::HUGEINT END))"
    return f"(CASE WHEN {total} >= 9223372036854775808 THEN {total} - 18446744073709551616 ELSE {total} END)::BIGINT"


_HASHES = {
    "ahash": _pack("q[i + 1] > floor(list_sum(q) / 64.0)"),
    "dhash": _pack("q[i + 1] > q[8 * (i // 8) + (i + 1) % 8 + 1]"),
    "mhash": _pack("2 * q[i + 1] > list_sort(q)[32] + list_sort(q)[33]"),
}
_RASTERS = "rasters AS (SELECT vec_id, list_transform(embedding, lambda v: floor(v::DOUBLE * 1000)::INT) AS q FROM embeddings)"
_VARIANTS = "SELECT {cols}, {v} AS variant_idx, {turn} AS q FROM {source}"


def _oriented(source: str, cols: str) -> str:
    return " UNION ALL ".join(_VARIANTS.format(cols=cols, v=v, turn=_turn("q", p), source=source) for v, p in enumerate(raster.ORIENTATIONS))


_MEMBERS = ["q", _turn("q", raster.ORIENTATIONS[1]), _turn("q", raster.ORIENTATIONS[4]), "list_transform(q, lambda v: v + 40)", "list_transform(range(64), lambda i: q[i + 1] + CASE WHEN i % 17 = 0 THEN 3 ELSE 0 END)"]
_FAMILY = "family AS (" + " UNION ALL ".join(f"SELECT vec_id * 10 + {m} AS image_id, vec_id AS family, {m} AS member, {x} AS q FROM rasters" for m, x in enumerate(_MEMBERS)) + ")"
_KEYS = f"turned AS ({_oriented('family', 'image_id')}), keys AS (" + " UNION ALL ".join(f"SELECT image_id, '{a}' AS algo, variant_idx, {h} AS key FROM turned" for a, h in _HASHES.items()) + ")"
_BASE = f"{_RASTERS}, {_FAMILY}, {_KEYS}"
_SAME_BYTE = "(" + " OR ".join(f"((a.key >> {8 * i}) & 255) = ((b.key >> {8 * i}) & 255)" for i in range(8)) + ")"
_NEAR = f"own AS (SELECT DISTINCT algo, key FROM keys), near AS (SELECT a.algo, a.key AS x, b.key AS y FROM own a JOIN own b ON a.algo = b.algo AND bit_count(xor(a.key, b.key)) <= {mih.RADIUS} AND {_SAME_BYTE})"
_VOTES = "owners AS (SELECT DISTINCT image_id, algo, key FROM keys), votes AS (SELECT a.image_id AS i, b.image_id AS j, count(DISTINCT a.algo) AS votes FROM owners a JOIN near n ON a.algo = n.algo AND a.key = n.x JOIN owners b ON b.algo = n.algo AND b.key = n.y WHERE a.image_id < b.image_id GROUP BY 1, 2)"
_CONFIRMED = f"confirmed AS (SELECT v.i, v.j, max(1 - bit_count(xor(a.key, b.key)) / 64.0) AS score FROM votes v JOIN keys a ON a.image_id = v.i JOIN keys b ON b.image_id = v.j AND a.algo = b.algo WHERE v.votes >= {mih.MIN_VOTES} GROUP BY 1, 2 HAVING max(1 - bit_count(xor(a.key, b.key)) / 64.0) >= {mih.THRESHOLD})"
_REACH = "edges AS (SELECT i AS u, j AS v FROM confirmed UNION SELECT j, i FROM confirmed), reach(u, v) AS (SELECT u, u FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u), members AS (SELECT u AS image_id, min(v) AS group_id FROM reach GROUP BY u)"
_ALL = f"WITH RECURSIVE {_BASE}, {_NEAR}, {_VOTES}, {_CONFIRMED}, {_REACH} "


@query(f"WITH {_RASTERS} SELECT vec_id, array_to_string(q, ',') AS pixels FROM rasters")
def raster_quantize(spark, sf_dir):
    return rasters(spark, sf_dir).select("vec_id", joined("q").alias("pixels"))


@query(f"WITH {_RASTERS} SELECT vec_id, variant_idx, array_to_string(q, ',') AS pixels FROM ({_oriented('rasters', 'vec_id')})")
def orientation_variants(spark, sf_dir):
    return raster.variants(rasters(spark, sf_dir)).select("vec_id", "variant_idx", joined("q").alias("pixels"))


@query(f"WITH {_RASTERS}, {_FAMILY} SELECT image_id, family, member, array_to_string(q, ',') AS pixels FROM family")
def family_expand(spark, sf_dir):
    return raster.family(rasters(spark, sf_dir)).select("image_id", "family", "member", joined("q").alias("pixels"))


def _signature(algo: str):
    def run(spark, sf_dir):
        return rasters(spark, sf_dir).select("vec_id", raster.GATE[algo]("q").alias("key"), bits.to_hex(raster.GATE[algo]("q")).alias("key_hex"))

    run.__name__ = f"{algo}_bits"
    return query(f"WITH {_RASTERS}, k AS (SELECT vec_id, {_HASHES[algo]} AS key FROM rasters) SELECT vec_id, key, lpad(lower(to_hex(key)), 16, '0') AS key_hex FROM k")(run)


for _algo in raster.GATE:
    _signature(_algo)


@query(f"WITH {_RASTERS}, t AS ({_oriented('rasters', 'vec_id')}), k AS (SELECT vec_id, {_HASHES['ahash']} AS key FROM t) SELECT vec_id, arg_min(key, CASE WHEN key < 0 THEN key::HUGEINT + 18446744073709551616 ELSE key::HUGEINT END) AS canonical FROM k GROUP BY vec_id")
def canonical_rot64(spark, sf_dir):
    turned = raster.variants(rasters(spark, sf_dir)).select("vec_id", raster.average_hash("q").alias("key"))
    return turned.groupBy("vec_id").agg(bits.unsigned_least(F.collect_list("key")).alias("canonical"))


@query(f"WITH {_RASTERS}, k AS (SELECT vec_id, {_HASHES['ahash']} AS key FROM rasters) SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.key, b.key))::INT AS hamming, 1 - bit_count(xor(a.key, b.key)) / 64.0::DOUBLE AS similarity FROM k a JOIN k b ON a.vec_id < b.vec_id WHERE 1 - bit_count(xor(a.key, b.key)) / 64.0 >= 0.7")
def pairs_above_threshold(spark, sf_dir):
    return mih.similar(rasters(spark, sf_dir).select("vec_id", raster.average_hash("q").alias("key")), 0.7)


_PAIRS = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings){more} SELECT a.vec_id AS a, b.vec_id AS b, round({score}, 6) AS score FROM {source} a JOIN {source} b ON a.vec_id < b.vec_id WHERE round({score}, 6) >= {least}"
_CENTRED = ", c AS (SELECT vec_id, list_transform(x, lambda v: v - list_sum(x) / len(x)) AS x FROM e)"
_COS = "list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x)))"


@query(_PAIRS.format(more="", source="e", score=f"greatest(0.0, least(1.0, {_COS}))", least=0.25))
def cosine_pairs(spark, sf_dir):
    return neighbours.pairs(table(spark, sf_dir, "embeddings"), neighbours.cosine, 0.25)


@query(_PAIRS.format(more=_CENTRED, source="c", score=f"greatest(0.0, least(1.0, {_COS}))", least=0.25))
def centred_cosine_pairs(spark, sf_dir):
    return neighbours.pairs(table(spark, sf_dir, "embeddings"), neighbours.centred_cosine, 0.25)


@query(_PAIRS.format(more=_CENTRED, source="c", score=f"({_COS} + 1) / 2", least=0.6))
def correlation_pairs(spark, sf_dir):
    return neighbours.pairs(table(spark, sf_dir, "embeddings"), neighbours.correlation, 0.6)


@query(_PAIRS.format(more="", source="e", score="exp(-list_distance(a.x, b.x))", least=0.28))
def exp_distance_pairs(spark, sf_dir):
    return neighbours.pairs(table(spark, sf_dir, "embeddings"), neighbours.exp_distance, 0.28)


_KNN = f"WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 9) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM p) "


@query(_KNN + "SELECT a, b, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 8")
def knn_topk(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), 8).withColumn("score", F.round("score", 6))


@query(_KNN + "SELECT DISTINCT least(a, b) AS i, greatest(a, b) AS j FROM r WHERE rank <= 32 AND score >= 0.3")
def knn_candidates(spark, sf_dir):
    return neighbours.candidate_pairs(table(spark, sf_dir, "embeddings"), 32, 0.3)


@query(_KNN + "SELECT x.a, x.b, round(x.score, 6) AS score FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.rank = 1 AND y.rank = 1 AND x.a < x.b")
def mutual_nearest(spark, sf_dir):
    return neighbours.mutual(table(spark, sf_dir, "embeddings")).withColumn("score", F.round("score", 6))


@query(_KNN + "SELECT x.a, x.b, round(1 - x.score, 6) AS best, round(1 - y.score, 6) AS second FROM r x JOIN r y ON x.a = y.a WHERE x.rank = 1 AND y.rank = 2 AND 1 - x.score < 0.95 * (1 - y.score)")
def ratio_test(spark, sf_dir):
    return neighbours.ratio_test(table(spark, sf_dir, "embeddings"), 0.95)


@query(f"WITH {_BASE} SELECT algo, band, byte::INT AS byte, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT algo, {i} AS band, (key >> {8 * i}) & 255 AS byte FROM keys" for i in range(8)) + ") GROUP BY 1, 2, 3")
def mih_bands(spark, sf_dir):
    return mih.bands(family_keys(spark, sf_dir)).groupBy("algo", "band", F.col("byte").cast("int").alias("byte")).agg(F.count("*").alias("n"))


@query(f"WITH {_BASE}, {_NEAR}, {_VOTES} SELECT * FROM votes")
def gate_votes(spark, sf_dir):
    return mih.votes(family_keys(spark, sf_dir))


@query(f"WITH {_BASE}, {_NEAR}, {_VOTES}, {_CONFIRMED} SELECT i, j, score::DOUBLE AS score FROM confirmed")
def gate_confirmed(spark, sf_dir):
    keys = family_keys(spark, sf_dir)
    return mih.confirmed(keys, mih.candidates(keys).select("i", "j"))


@query(_ALL + "SELECT group_id, count(*) AS n_images, string_agg(image_id::VARCHAR, ',' ORDER BY image_id) AS members, (SELECT max(score) FROM confirmed c JOIN members m ON c.i = m.image_id WHERE m.group_id = g.group_id)::DOUBLE AS confidence FROM members g GROUP BY group_id")
def dedup_groups(spark, sf_dir):
    return grouping.groups(gate_confirmed(spark, sf_dir))


@query(f"WITH {_BASE} SELECT algo, (((key >> 56) & 255))::INT AS shard, count(*) AS n FROM keys GROUP BY 1, 2")
def shard_ids(spark, sf_dir):
    return family_keys(spark, sf_dir).groupBy("algo", bits.shard_id(F.col("key")).cast("int").alias("shard")).agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS file_hash, count(*) AS n, min(doc_id) AS original FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("original")).where("n > 1")


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n_children FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def project_image_counts(spark, sf_dir):
    return store.children_count(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
def images_page(spark, sf_dir):
    return store.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 200, 100)


@query("SELECT o_custkey, count(*) AS total, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS ready, bool_and(o_orderstatus = 'F') AS all_ready FROM orders GROUP BY 1")
def features_ready(spark, sf_dir):
    ready = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(ready).alias("ready"), F.bool_and(ready).alias("all_ready"))


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_algorithms FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def feature_algorithm_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n_algorithms"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber IN (1, 2) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def feature_map_scan(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == "R") & F.col("l_linenumber").isin(1, 2))
    return rows.join(ids, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("WITH new AS (SELECT l_orderkey, l_linenumber, max(l_quantity) + CASE WHEN l_linenumber = 1 THEN 2 ELSE 1 END AS l_quantity FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.l_orderkey = o.l_orderkey AND n.l_linenumber = o.l_linenumber) UNION ALL SELECT * FROM new")
def feature_upsert(spark, sf_dir):
    """Lines come anew with one more, first lines then once again with two more: the greater of them stays."""
    old = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    more = F.explode(F.when(F.col("l_linenumber") == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    new = old.where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "l_quantity", more.alias("more")).withColumn("l_quantity", F.col("l_quantity") + F.col("more")).drop("more")
    return store.upsert(old.drop("l_returnflag"), new, ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.without(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def latest_run(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return store.latest(runs, ["user_id", "event_type"], [F.desc("event_id")])


@query("WITH s AS (SELECT s_suppkey, 'n' || s_nationkey || CASE WHEN s_suppkey % 7 = 0 THEN '_' || (s_suppkey % 3 + 1) ELSE '' END AS stem FROM supplier), c AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY s_suppkey) - 1 AS k FROM s), i AS (SELECT stem, unnest(range(1, count(*) + 4)) AS number FROM s GROUP BY 1), free AS (SELECT stem, number, row_number() OVER (PARTITION BY stem ORDER BY number) AS k FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.stem = i.stem || '_' || i.number)) SELECT s_suppkey, stem || coalesce('_' || number, '') || '.png' AS unique_name FROM c LEFT JOIN free USING (stem, k)")
def unique_key_suffix(spark, sf_dir):
    """Names of which some look like those made for copies."""
    like = F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("_"), (F.col("s_suppkey") % 3 + 1).cast("string"))).otherwise("")
    named = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), like, F.lit(".png")).alias("name"))
    return store.unique_names(named, "name", "s_suppkey").select("s_suppkey", "unique_name")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def feature_status_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS link FROM pages")
def extract_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.expr("regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)"))).alias("link"))
