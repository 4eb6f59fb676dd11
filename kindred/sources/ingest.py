"""Files in, features out: rasters and documents by Spark's binaryFile source."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import kernels
from kindred.sources.store import DOCUMENT_EXTENSIONS, IMAGE_EXTENSIONS, extension

MOST_BYTES = 512 << 20
FEATURES = "image_id long, algo string, variant_idx int, key long"


def sniff(data: bytes) -> str:
    # First bytes of formats.
    heads = [
        (b"\xff\xd8\xff", "jpg"), (b"\x89PNG\r\n\x1a\n", "png"), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"BM", "bmp"),
        (b"II*\x00", "tiff"), (b"MM\x00*", "tiff"), (b"qoif", "qoi"),
    ]
    if data.startswith(b"RIFF") and data[8:12] == b"WEBP" and len(data) > 12:
        return "webp"
    return next((ext for head, ext in heads if data.startswith(head)), "jpg")


def inflate(data: bytes, most: int = MOST_BYTES) -> bytes | None:
    """zlib data, or None if damaged or larger than `most`."""
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, most + 1)
    except zlib.error:
        return None
    return out if len(out) <= most else None


def encode_png(img: np.ndarray) -> bytes:
    """A gray or RGB raster as PNG."""
    h, w = img.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), img.reshape(h, -1)], 1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if img.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def office_media(stem: str, data: bytes) -> list[tuple[str, bytes]]:
    """Pictures inside a docx or pptx: {stem}_media{n}.{ext} from 1; a file that is no archive has none."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return []
    out = []
    for item in z.infolist():
        if item.is_dir() or not item.filename.startswith(("word/media/", "ppt/media/")) or item.file_size > MOST_BYTES:
            continue
        body, ext = z.read(item), item.filename.rpartition(".")[2].lower() if "." in item.filename.rpartition("/")[2] else ""
        out.append((f"{stem}_media{len(out) + 1}.{sniff(body) if ext in ('', 'emf', 'wmf') else ext}", body))
    return out


def pdf_images(stem: str, data: bytes) -> list[tuple[str, bytes]]:
    """Pictures of a PDF by page: JPEG streams as they are, deflated 8-bit RGB, gray or CMYK as PNG; others are left out. Pages are taken in file order."""
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+) 0 obj\b(.*?)endobj", data, re.S)}
    pages = [b for b in objects.values() if re.search(rb"/Type\s*/Page\b", b)]
    out = []
    for p, page in enumerate(pages, 1):
        n = 0
        named = re.search(rb"/XObject\s*(?:<<(.*?)>>|(\d+) 0 R)", page, re.S)
        inside = (named[1] or objects.get(int(named[2] or 0), b"")) if named else b""
        for ref in re.findall(rb"(\d+) 0 R", inside):
            body = objects.get(int(ref), b"")
            head, _, rest = body.partition(b"stream")
            if not re.search(rb"/Subtype\s*/Image", head):
                continue
            length = re.search(rb"/Length\s+(\d+)(?!\s+0 R)", head)
            raw = rest.lstrip(b"\r").removeprefix(b"\n")
            raw = raw[: int(length[1])] if length else raw.rpartition(b"endstream")[0].rstrip(b"\r\n")
            found = _pdf_raster(head, raw)
            if found:
                n += 1
                out.append((f"{stem}_page{p}_img{n}.{found[0]}", found[1]))
    return out


def _pdf_raster(head: bytes, raw: bytes) -> tuple[str, bytes] | None:
    if b"/DCTDecode" in head:
        return "jpg", raw
    number = lambda key: int((re.search(rb"/" + key + rb"\s+(\d+)", head) or (0, 0))[1])
    w, h, flat = number(b"Width"), number(b"Height"), inflate(raw) if b"/FlateDecode" in head else None
    if flat is None or number(b"BitsPerComponent") != 8 or not w * h:
        return None
    depth = 3 if b"/DeviceRGB" in head else 1 if b"/DeviceGray" in head else 4 if b"/DeviceCMYK" in head else 0
    if not depth or len(flat) < w * h * depth:
        return None
    img = np.frombuffer(flat[: w * h * depth], np.uint8).reshape(h, w, depth)
    if depth == 4:
        img = ((255 - img[..., :3].astype(int)) * (255 - img[..., 3:].astype(int)) // 255).astype(np.uint8)
    return "png", encode_png(img[..., 0] if depth == 1 else img)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, extension, length, file_hash, content) of images and documents under a path; other files are left out before they are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = extension(F.col("path"))
    return rows.where(kind.isin(*IMAGE_EXTENSIONS, *DOCUMENT_EXTENSIONS)).select("path", kind.alias("extension"), "length", F.sha2("content", 256).alias("file_hash"), "content")


def media(found: DataFrame) -> DataFrame:
    """(path, name, content) of the pictures inside documents; a damaged one has none."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, content in zip(batch["path"], batch["extension"], batch["content"]):
                stem = path.rpartition("/")[2].rpartition(".")[0]
                inside = (pdf_images if kind == "pdf" else office_media)(stem, bytes(content))
                if inside:
                    yield pd.DataFrame([(path, name, body) for name, body in inside], columns=["path", "name", "content"])

    return found.where(F.col("extension").isin(*DOCUMENT_EXTENSIONS)).select("path", "extension", "content").mapInPandas(step, "path string, name string, content binary")


def features(rasters: DataFrame) -> DataFrame:
    """(image_id, algo, variant_idx, key) of rasters (image_id, height, width, channels, data): every signature in 8 orientations, the invariant ones in one. Null or wrong-sized data have no rows."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, h, w, c, data in zip(*(batch[k] for k in ("image_id", "height", "width", "channels", "data"))):
                if data is None or not h or not w or len(data) != h * w * c:
                    continue
                img = np.frombuffer(bytes(data), np.uint8).reshape((h, w, c) if c > 1 else (h, w))
                for v, o in enumerate(kernels.turned(kernels.resize_max_side(img, 512))):
                    out += [(i, a, v, f(o)) for a, f in kernels.HASHES.items() if v == 0 or a not in kernels.INVARIANT]
            yield pd.DataFrame(out, columns=["image_id", "algo", "variant_idx", "key"])

    return rasters.select("image_id", "height", "width", "channels", "data").mapInPandas(step, FEATURES)
