import io
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import kernels as k
from kindred.functions.crops import WINDOWS
from kindred.sources import bundle, ingest, store


@pytest.fixture(scope="module")
def photo():
    y, x = np.mgrid[0:96, 0:128]
    rng = np.random.default_rng(3)
    img = np.stack([255 * x // 128, 255 * y // 96, (x ^ y) & 255], -1)
    for _ in range(25):
        cy, cx, r = rng.integers(0, 96), rng.integers(0, 128), rng.integers(3, 14)
        img[(y - cy) ** 2 + (x - cx) ** 2 < r * r] = rng.integers(0, 255, 3)
    return img.astype(np.uint8)


def bits(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def test_near_copies_stay_near(photo):
    half, bright = k.resize(photo, 64, 48), np.clip(photo.astype(int) + 20, 0, 255).astype(np.uint8)
    other = np.random.default_rng(1).integers(0, 255, photo.shape).astype(np.uint8)
    for name, f in k.HASHES.items():
        assert f(photo) == f(photo.copy())
        assert bits(f(photo), f(half)) <= (20 if name == "edgehash" else 10), name
    assert bits(k.phash(photo), k.phash(bright)) <= 10
    assert bits(k.phash(photo), k.phash(other)) > 16


def test_orientations(photo):
    square = photo[:96, :96]
    assert sorted(k.phash(o) for o in k.turned(square)) == sorted(k.phash(o) for o in k.turned(np.rot90(square)))
    assert np.allclose(k.hu_moments(square), k.hu_moments(np.rot90(square)), atol=1e-6)
    assert k.colorhash(square) == k.colorhash(np.rot90(square))


def test_transforms():
    assert np.allclose(k.DCT32 @ k.DCT32.T, np.eye(32))
    flat = np.full((32, 32), 7)
    assert k.haar(flat)[0, 0] == 7 and np.count_nonzero(k.haar(flat)) == 1
    assert k.zigzag()[:6] == [0, 1, 8, 16, 9, 2]
    assert sorted(k.zigzag()) == list(range(64))
    assert len(k.colorlayout(np.zeros((9, 9, 3), np.uint8))) == 24


def test_measures(photo):
    g = k.gray(photo)
    assert k.ssim(g, g) == pytest.approx(1) and k.ncc(g, g) == pytest.approx(1)
    assert k.ssim(g[:7, :7], g) == 0 and k.ncc(np.zeros((4, 4)), g[:4, :4]) == 0
    assert k.histogram_correlation(np.arange(5), np.arange(5)) == pytest.approx(1) and k.histogram_correlation(np.arange(5), np.arange(4)) == 0
    b = k.blockhash(photo)
    assert k.block_similarity(b, np.rot90(b)) == 1


def test_template_against_brute_force(photo):
    g = k.gray(photo)[:30, :40]
    part = g[11:19, 23:33]
    score, x, y = k.template_match(g, part)
    best = max((np.corrcoef(g[r : r + 8, c : c + 10].ravel(), part.ravel())[0, 1], -r, -c) for r in range(23) for c in range(31) if np.ptp(g[r : r + 8, c : c + 10]))
    assert (x, y) == (23, 11) == (-best[2], -best[1]) and score == pytest.approx(1)
    assert k.template_match(g, np.full((3, 3), 9)) == (0.0, 0, 0)


def test_slices_and_containment(photo):
    g = k.gray(photo)
    whole = k.slice_match(np.rot90(g), g)
    assert whole["is_slice_of_a"] and whole["coverage"] == 1 and len(whole["cells"]) == 4
    assert k.contains(g, g[20:70, 30:100])[0] and k.contains(np.rot90(g[20:70, 30:100]), g)[0]
    assert not k.contains(g, np.random.default_rng(2).integers(0, 255, (50, 60)).astype(np.uint8))[0]


def test_crop_keys_meet(photo):
    whole, cut = k.crophash(photo, WINDOWS), k.crophash(photo[10:86, 13:115], WINDOWS)
    assert len(whole) == 15 and any(bits(a, b) <= 10 for a in whole for b in cut)


def test_documents():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/media/a.PNG", b"\x89PNG\r\n\x1a\nx")
        z.writestr("word/document.xml", b"<x/>")
        z.writestr("word/media/b.emf", b"GIF89a")
    assert [n for n, _ in ingest.office_media("d", buf.getvalue())] == ["d_media1.png", "d_media2.gif"]
    assert ingest.office_media("d", b"no archive") == []
    raw = zlib.compress(bytes(range(12)))
    pdf = b"%PDF-1.4\n1 0 obj<</Type /Page /Resources <</XObject <</I1 2 0 R /I2 3 0 R>> >> >>endobj\n"
    pdf += b"2 0 obj<</Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Filter /FlateDecode /Length %d>>stream\n" % len(raw) + raw + b"\nendstream endobj\n"
    pdf += b"3 0 obj<</Subtype /Image /Filter /DCTDecode /Length 4>>stream\n\xff\xd8\xff\xe0\nendstream endobj\n"
    found = ingest.pdf_images("p", pdf)
    assert [n for n, _ in found] == ["p_page1_img1.png", "p_page1_img2.jpg"] and found[1][1] == b"\xff\xd8\xff\xe0"
    assert ingest.inflate(zlib.compress(b"a" * 100), 10) is None and ingest.inflate(b"junk") is None


def test_files_and_features(spark, tmp_path, photo):
    (tmp_path / "a.png").write_bytes(ingest.encode_png(photo))
    (tmp_path / "note.txt").write_text("x")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/media/i.png", ingest.encode_png(k.gray(photo)))
    found = ingest.files(spark, str(tmp_path))
    assert {r.extension for r in found.collect()} == {"png", "docx"}
    assert [r.name for r in ingest.media(found).collect()] == ["d_media1.png"]
    image = spark.read.format("image").load(str(tmp_path / "a.png")).selectExpr("image.height", "image.width").first()
    assert tuple(image) == photo.shape[:2]
    rows = spark.createDataFrame([(1, 96, 128, 3, photo.tobytes()), (2, 9, 9, 1, None), (3, 9, 9, 1, b"short")], "image_id long, height int, width int, channels int, data binary")
    got = ingest.features(rows).collect()
    assert len(got) == 8 * (len(k.HASHES) - 1) + 1 and {r.image_id for r in got} == {1}
    assert next(r.key for r in got if r.algo == "phash" and r.variant_idx == 0) == k.phash(photo)


def test_bundles(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1), ("x", 2)], "algo string, key long")
    line, made = F.col("key").cast("string"), []
    build = lambda df: made.append(1) or df
    for source, loaded in ((rows, False), (rows, True), (rows.where("key = 1"), False)):
        got, was = bundle.load_or_build(spark, str(tmp_path / "b"), source, line, build)
        assert was == loaded and got.count() == source.count()
    assert not bundle.load_or_build(spark, str(tmp_path / "b"), rows, line, build, "other")[1] and len(made) == 3


def test_store_changes(spark):
    images = spark.createDataFrame([(1, 1, "a", "pending"), (2, 1, "b", "ready"), (3, 2, "c", "ready")], "image_id long, project_id long, file_hash string, feature_status string")
    feats = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "image_id long, algorithm string")
    cache = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.5)], "hash_a string, hash_b string, score double")
    left, f, c = store.delete_image(images, feats, cache, 1)
    assert (left.count(), f.count(), c.count()) == (2, 2, 1)
    left, f, gone = store.delete_project(images, feats, 1)
    assert (left.count(), f.count(), gone.count()) == (1, 1, 2)
    assert {r.image_id: r.feature_status for r in store.set_status(images, feats.where("image_id = 1"), "computing").collect()}[1] == "computing"
    with pytest.raises(ValueError):
        store.set_status(images, feats, "gone")
    assert [r.image_id for r in store.next_ids(spark.createDataFrame([(5,), (9,)], "n long"), images, "image_id", "n").orderBy("n").collect()] == [4, 5]
