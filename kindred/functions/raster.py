"""8 x 8 gray rasters as arrays of 64 integers in row-major order: orientations and signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.bits import pack

SIDE = 8
#: Rasters whose signatures are taken at once.
DRAWN = 1024


def orientations(side: int = SIDE) -> list[list[int]]:
    """Source places of 8 orientations: identity, quarter turns clockwise (1 to 3), mirror, mirror and turn, upside down, transpose."""
    at = np.arange(side * side).reshape(side, side)
    turned = [np.rot90(at, -k) for k in range(4)]
    mirrored = np.fliplr(at)
    return [[int(i) for i in x.ravel()] for x in (*turned, mirrored, np.rot90(mirrored, -1), np.flipud(at), at.T)]


ORIENTATIONS = orientations()


def quantize(x: Column, steps: int = 1000) -> Column:
    return F.transform(x, lambda v: F.floor(v.cast("double") * steps).cast("int"))


def permuted(pixels: str, places: list[int]) -> str:
    return f"transform(array({', '.join(map(str, places))}), p -> get({pixels}, p))"


def variants(df: DataFrame, pixels: str = "q") -> DataFrame:
    """Eight rows of each: variant_idx and the turned pixels."""
    turned = F.expr("array(" + ", ".join(permuted(pixels, p) for p in ORIENTATIONS) + ")")
    return df.select(*[c for c in df.columns if c != pixels], F.posexplode(turned).alias("variant_idx", pixels))


def bound(value: str, body: str) -> str:
    """SQL of body with `m` for the value, which is worked out once a row and not once an element."""
    return f"get(transform(array({value}), m -> {body}), 0)"


def average_hash(pixels: str = "q") -> Column:
    """Bit: pixel above the mean, rounded down."""
    return pack(bound(f"floor(aggregate({pixels}, 0L, (a, x) -> a + x) / 64.0)", f"transform({pixels}, v -> v > m)"))


def difference_hash(pixels: str = "q") -> Column:
    """Bit: pixel above its right neighbour, the last of a row against the first."""
    return pack(f"transform({pixels}, (v, i) -> v > get({pixels}, int(8 * floor(i / 8) + (i + 1) % 8)))")


def median_hash(pixels: str = "q") -> Column:
    """Bit: twice the pixel above the sum of the two middle ones."""
    return pack(bound(f"array_sort({pixels})", bound("get(m, 31) + get(m, 32)", f"transform({pixels}, v -> 2 * v > m)")))


def block_means(pixels: str = "q") -> Column:
    """16 means of 2 x 2 pixels, less their own mean: the embedding of a raster where no model is given."""
    corner = "16 * (c div 4) + 2 * (c % 4)"
    means = "transform(sequence(0, 15), c -> (" + " + ".join(f"get({pixels}, int({corner} + {k}))" for k in (0, 1, 8, 9)) + ") / 4.0D)"
    return F.expr(f"get(transform(array({means}), b -> transform(b, v -> v - aggregate(b, 0.0D, (a, x) -> a + x) / 16)), 0)")


GATE = {"ahash": average_hash, "dhash": difference_hash, "mhash": median_hash}


def family(rasters: DataFrame) -> DataFrame:
    """Five known near copies of each raster: as it is, turned, mirrored, brighter, four pixels nudged."""
    nudged = "transform(q, (v, i) -> v + if(i % 17 = 0, 3, 0))"
    members = F.expr(f"array(q, {permuted('q', ORIENTATIONS[1])}, {permuted('q', ORIENTATIONS[4])}, transform(q, v -> v + 40), {nudged})")
    return rasters.select(F.col("vec_id").alias("family"), F.posexplode(members).alias("member", "q")).select((F.col("family") * 10 + F.col("member")).alias("image_id"), "family", "member", "q")


def packed_rows(flags: np.ndarray) -> np.ndarray:
    """Keys of rows of 64 flags, the first the lowest bit."""
    return np.packbits(flags, axis=-1, bitorder="little").reshape(*flags.shape[:-1], 8).view("<i8")[..., 0]


def hash_rows(algo: str, q: np.ndarray, known: np.ndarray) -> np.ndarray:
    """What GATE[algo] gives, for rows of 64 whole numbers; `known` is false where the pixel is null."""
    if algo == "ahash":
        return packed_rows((q > (q.sum(-1) // 64)[..., None]) & known.all(-1)[..., None])
    if algo == "dhash":
        right = [8 * (i // 8) + (i + 1) % 8 for i in range(64)]
        return packed_rows((q > q[..., right]) & known & known[..., right])
    middle = np.sort(np.where(known, q, np.iinfo(np.int64).max // 4), -1)[..., 31:33].sum(-1)  # nulls come last
    return packed_rows((2 * q > middle[..., None]) & known & (known.sum(-1) > 32)[..., None])


def drawn_keys(images: DataFrame, draws: list[list[int]], algos: list[str]) -> DataFrame:
    """(image_id, algo, variant_idx, key): signatures of the rasters q (whole numbers), drawn from the source places that each of `draws` lists.

    Whole batches at once in numpy; the signatures are sums and comparisons of whole numbers, so they are the columns' of GATE.
    """
    places = np.array(draws)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, DRAWN) for k in range(0, whole.num_rows, DRAWN)):
                col, n = batch.column("q"), batch.num_rows
                size = np.minimum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 64)
                first = col.offsets.to_numpy()[:-1]
                at = first[:, None] + np.arange(64)
                known = np.arange(64) < size[:, None]
                flat = col.values
                values, valid = flat.fill_null(0).to_numpy(), flat.is_valid().to_numpy(zero_copy_only=False)
                at = np.where(known, at, 0)
                known &= valid[at] if len(valid) else False
                q = np.where(known, values[at].astype(np.int64) if len(values) else 0, 0)
                q, known = q[:, places], known[:, places]
                for algo in algos:
                    key = hash_rows(algo, q, known)
                    ids = np.repeat(batch.column("image_id").to_numpy(zero_copy_only=False), len(places))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([algo]).take(pa.array(np.zeros(key.size, int))), pa.array(np.tile(np.arange(len(places), dtype=np.int32), n)), pa.array(key.ravel())], ["image_id", "algo", "variant_idx", "key"])

    return images.select(F.col("image_id").cast("long").alias("image_id"), "q").mapInArrow(step, "image_id long, algo string, variant_idx int, key long")


def signatures(images: DataFrame) -> DataFrame:
    """(image_id, algo, variant_idx, key): all gate signatures of all orientations."""
    return drawn_keys(images, ORIENTATIONS, list(GATE))
