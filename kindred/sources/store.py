"""The metadata store's reads and writes over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Extensions of files that are taken as images and as documents.
IMAGE_EXTENSIONS = (
    "jpg", "jpeg", "jfif", "jpe", "png", "apng", "gif", "bmp", "dib", "tif", "tiff", "webp", "ico",
    "cur", "tga", "qoi", "pbm", "pgm", "ppm", "pnm", "ff", "farbfeld", "exr", "hdr",
)
DOCUMENT_EXTENSIONS = ("pdf", "docx", "pptx")


def page(df: DataFrame, key: str, skip: int = 0, limit: int = 100) -> DataFrame:
    """Rows by key, `limit` (500 at most) after the first `skip`."""
    return df.orderBy(key).offset(max(0, skip)).limit(max(0, min(500, limit)))


def children_count(parents: DataFrame, children: DataFrame, key: str, foreign: str, child: str) -> DataFrame:
    """Each parent with the number of its children, 0 if none. Children are counted before the join."""
    n = children.groupBy(F.col(foreign).alias(key)).agg(F.count(child).alias("n_children"))
    return parents.join(n, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put in: a row of new replaces that of its key.

    Of rows of new that repeat a key the greatest stays, by the other columns in their order.
    """
    others = [c for c in old.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_row")).select(*keys, "_row.*") if others else new.select(*keys).distinct()
    return old.join(new, keys, "left_anti").select(*old.columns).union(one.select(*old.columns))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def without(df: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    return df.join(gone, on, "left_anti")


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Each name once, in unique_name: stem.ext, then stem_1.ext, stem_2.ext, ... by `order` among equal names.

    A name that the column holds is never made for another row, whatever their order: its number is passed over (up to
    nine digits). Null names stay null. One window over each name's rows and the numbers taken from it.
    """
    p = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in df.columns))
    split = r"(?s)^(.+?)(\.[^.]*)?\z"
    stem, ext = F.regexp_extract(name, split, 1), F.regexp_extract(name, split, 2)
    parts = df.select(name).where(F.col(name).isNotNull()).distinct().select(stem.alias("stem"), ext.alias("ext"))
    parts = parts.select(F.regexp_extract("stem", r"(?s)^(.*)_([1-9][0-9]{0,8})\z", 1).alias("of"), F.regexp_extract("stem", r"_([1-9][0-9]{0,8})\z", 1).alias("number"), "ext")
    made = parts.where("number <> '' and (of <> '' or ext = '')").select(F.concat("of", "ext").alias(name), F.col("number").cast("long").alias("number"))
    before = F.row_number().over(Window.partitionBy(name).orderBy("number")) - 1  # numbers under it that are taken too
    taken = made.select(name, (F.col("number") - before).alias(f"{p}at"), F.lit(1).alias(f"{p}taken"))
    copy = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    rows = df.withColumn(f"{p}at", copy.cast("long")).withColumn(f"{p}taken", F.lit(0)).unionByName(taken, allowMissingColumns=True)
    passed = F.sum(f"{p}taken").over(Window.partitionBy(name).orderBy(f"{p}at", F.desc(f"{p}taken")))
    numbered = rows.withColumn(f"{p}number", F.col(f"{p}at") + passed).where(F.col(f"{p}taken") == 0)
    unique = F.when(F.col(f"{p}at") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col(f"{p}number").cast("string"), ext))
    return numbered.withColumn("unique_name", unique).select(*[c for c in df.columns if c != "unique_name"], "unique_name")


def extension(name: Column) -> Column:
    """Lower-case, without the dot; empty if there is none or nothing before it."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 1))


def sniffed(content: Column) -> Column:
    """jpg, png, gif, bmp, tiff, webp or qoi by the first bytes; jpg if none fits."""
    head = F.hex(F.substring(content, 1, 12))
    # First bytes of formats.
    kind = F.when(head.startswith("FFD8FF"), "jpg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
    kind = kind.when(head.startswith("424D"), "bmp").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
    kind = kind.when(head.startswith("52494646") & head.endswith("57454250") & (F.length(content) > 12), "webp").when(head.startswith("716F6966"), "qoi")
    return kind.otherwise("jpg")


def ordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("hash_a"), F.greatest(a, b).alias("hash_b")


def prune_pairs(cache: DataFrame, gone: DataFrame) -> DataFrame:
    """The pair cache (hash_a, hash_b, ...) without pairs that hold a hash of gone (one column, nulls ignored)."""
    own = gone.toDF("_h").where("_h is not null").distinct()
    for side in ("hash_a", "hash_b"):
        cache = cache.join(own, F.col(side) == F.col("_h"), "left_anti")
    return cache


def backfill_due(images: DataFrame, features: DataFrame, extractors: int) -> DataFrame:
    """(image_id, n_algorithms) of images that are not ready or have fewer distinct algorithms than there are extractors."""
    have = features.groupBy("image_id").agg(F.count_distinct("algorithm").alias("n_algorithms"))
    all_of = images.join(have, "image_id", "left").withColumn("n_algorithms", F.coalesce("n_algorithms", F.lit(0)))
    return all_of.where((F.col("feature_status") != "ready") | (F.col("n_algorithms") < extractors)).select("image_id", "n_algorithms")


def next_ids(df: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """df with new integer ids above the largest of existing, by `order`."""
    from kindred.operators.ownership import dense_slots

    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    return df.join(dense_slots(df, order), order).crossJoin(F.broadcast(top)).withColumn(key, F.col("_top") + F.col("slot") + 1).drop("_top", "slot")  # one row


def delete_image(images: DataFrame, features: DataFrame, cache: DataFrame, image_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without an image, its features and the cached pairs of its hash."""
    gone = images.where(F.col("image_id") == image_id)
    return images.where(F.col("image_id") != image_id), features.where(F.col("image_id") != image_id), prune_pairs(cache, gone.select("file_hash"))


def delete_project(images: DataFrame, features: DataFrame, project_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images and features that stay, and the images that went."""
    gone = images.where(F.col("project_id") == project_id)
    return images.where(F.col("project_id") != project_id), without(features, gone.select("image_id"), ["image_id"]), gone


def set_status(images: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """feature_status of the images in ids (image_id)."""
    if status not in ("pending", "computing", "ready"):
        raise ValueError(f"no such status: {status}")
    marked = ids.select("image_id").distinct().withColumn("_m", F.lit(True))
    return images.join(marked, "image_id", "left").withColumn("feature_status", F.when(F.col("_m"), status).otherwise(F.col("feature_status"))).drop("_m")
