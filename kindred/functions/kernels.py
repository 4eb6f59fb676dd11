"""Signatures and measures of real rasters (uint8 arrays, gray h x w or RGB h x w x 3), in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=64)
def _weights(n: int, m: int) -> np.ndarray:
    """Of n pixels for each of m; not to be changed, as it is kept."""
    scale = n / m
    reach = max(scale, 1.0)
    centre = (np.arange(m) + 0.5) * scale
    at = np.maximum(0, 1 - np.abs((np.arange(n) + 0.5)[None, :] - centre[:, None]) / reach)
    return at / at.sum(axis=1, keepdims=True)


def resize(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Triangle filter to w x h; the filter widens when shrinking. A raster of that size comes back as it is."""
    if img.shape[:2] == (h, w):
        return img
    out = np.tensordot(_weights(img.shape[0], h), img.astype(np.float64), (1, 0))
    out = np.moveaxis(np.tensordot(_weights(img.shape[1], w), out, (1, 1)), 0, 1)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def resize_max_side(img: np.ndarray, side: int) -> np.ndarray:
    h, w = img.shape[:2]
    if max(h, w) <= side:
        return img
    return resize(img, max(1, round(w * side / max(h, w))), max(1, round(h * side / max(h, w))))


def gray(img: np.ndarray) -> np.ndarray:
    """BT.709 luma of an RGB raster; a gray one comes back as it is."""
    if img.ndim == 2:
        return img
    return (img.astype(np.int64) @ np.array([2126, 7152, 722]) // 10000).astype(np.uint8)


def turned(img: np.ndarray) -> list[np.ndarray]:
    """Eight orientations in the order of raster.ORIENTATIONS."""
    m = img[:, ::-1]
    return [img, np.rot90(img, -1), np.rot90(img, 2), np.rot90(img, 1), m, np.rot90(m, -1), img[::-1], np.swapaxes(img, 0, 1)]


def packed(flags: np.ndarray) -> int:
    """Bits, the first the lowest, as a signed 64-bit integer."""
    return int(np.packbits(np.asarray(flags, bool).ravel(), bitorder="little").view("<i8")[0])


def _above_median(values: np.ndarray) -> np.ndarray:
    return values.ravel() > np.median(values)


def _dct_matrix(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * (x + 0.5) * k / n) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


DCT32, DCT8 = _dct_matrix(32), _dct_matrix(8)


def ahash(img: np.ndarray) -> int:
    small = resize(gray(img), 8, 8).astype(int)
    return packed(small > small.sum() // 64)


def dhash(img: np.ndarray) -> int:
    small = resize(gray(img), 9, 8)
    return packed(small[:, :-1] > small[:, 1:])


def phash(img: np.ndarray) -> int:
    """The 8 x 8 lowest frequencies of a 32 x 32 cosine transform, the constant included, against their median."""
    return packed(_above_median((DCT32 @ resize(gray(img), 32, 32).astype(float) @ DCT32.T)[:8, :8]))


def haar(x: np.ndarray) -> np.ndarray:
    """Full two-dimensional Haar transform by averages and half differences."""
    x, n = x.astype(float).copy(), len(x)
    while n > 1:
        for axis in (1, 0):
            part = np.moveaxis(x[:n, :n], axis, 0)
            a, b = part[0::2].copy(), part[1::2].copy()
            part[: n // 2], part[n // 2 : n] = (a + b) / 2, (a - b) / 2
        n //= 2
    return x


def whash(img: np.ndarray) -> int:
    low = haar(resize(gray(img), 32, 32))[:8, :8].copy()
    low[0, 0] = 0
    return packed(_above_median(low))


def hsv(img: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in degrees, saturation and value in 0 to 1."""
    rgb = (np.repeat(img[..., None], 3, -1) if img.ndim == 2 else img).astype(float) / 255
    top, low = rgb.max(-1), rgb.min(-1)
    d = np.where(top > low, top - low, 1)
    r, g, b = np.moveaxis(rgb, -1, 0)
    hue = np.select([top == low, top == r, top == g], [0.0, (60 * (g - b) / d) % 360, 60 * (b - r) / d + 120], 60 * (r - g) / d + 240)
    return hue, np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0), top


def colorhash(img: np.ndarray) -> int:
    """4 steps of saturation by 16 of hue, weighted by saturation times value, against the median; no colour gives 0."""
    h, s, v = hsv(img)
    cell = np.minimum((s * 4).astype(int), 3) * 16 + np.minimum((h / 360 * 16).astype(int), 15)
    bins = np.bincount(cell.ravel(), (s * v).ravel(), 64)
    return packed(_above_median(bins / bins.sum())) if bins.sum() > 0 else 0


def hsv_histogram(img: np.ndarray) -> np.ndarray:
    """50 x 60 counts of hue and saturation at length 1."""
    h, s, _ = hsv(img)
    cell = np.minimum((h / 360 * 50).astype(int), 49) * 60 + np.minimum((s * 60).astype(int), 59)
    bins = np.bincount(cell.ravel(), minlength=3000).astype(float)
    return bins / np.linalg.norm(bins) if bins.any() else bins


def edgehash(img: np.ndarray) -> int:
    """Directions of edges in 4 x 4 fields: four soft bins of undirected angle each, as shares, against the median."""
    x = resize(gray(img), 128, 128).astype(float)
    smooth = lambda a, axis: np.take(a, range(0, 126), axis) + 2 * np.take(a, range(1, 127), axis) + np.take(a, range(2, 128), axis)
    gx = smooth(x, 0)[:, 2:] - smooth(x, 0)[:, :-2]
    gy = smooth(x, 1)[2:] - smooth(x, 1)[:-2]
    size = np.hypot(gx, gy)
    strong = size >= 16
    at, size = np.mod(np.arctan2(gy[strong], gx[strong]), np.pi) / (np.pi / 4), size[strong]
    low, share = np.floor(at).astype(int) % 4, at - np.floor(at)
    rows = np.arange(1, 127) // 32
    field = ((rows[:, None] * 4 + rows[None, :]) * 4)[strong]
    v = np.bincount(field + low, (1 - share) * size, 64) + np.bincount(field + (low + 1) % 4, share * size, 64)
    v = v.reshape(16, 4)
    total = v.sum(1, keepdims=True)
    return packed(_above_median(np.where(total > 0, v / np.where(total > 0, total, 1), 0)))


def blockhash(img: np.ndarray) -> np.ndarray:
    """32 x 32 booleans: means of 4 x 4 pixels above their median."""
    tiles = resize(gray(img), 128, 128).reshape(32, 4, 32, 4).mean((1, 3))
    return tiles > np.median(tiles)


def block_similarity(a: np.ndarray, b: np.ndarray, reach: int = 8, least: int = 256) -> float:
    """The largest share of equal tiles over 8 orientations and shifts to `reach` tiles whose overlap has `least` tiles."""
    best, n = 0.0, len(a)
    for o in turned(b):
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                x = a[max(0, dy) : n + min(0, dy), max(0, dx) : n + min(0, dx)]
                y = o[max(0, -dy) : n + min(0, -dy), max(0, -dx) : n + min(0, -dx)]
                if x.size >= least:
                    best = max(best, float((x == y).mean()))
    return best


def zigzag(n: int = 8) -> list[int]:
    return [r * n + c for r, c in sorted(((r, c) for r in range(n) for c in range(n)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0]))]


def colorlayout(img: np.ndarray) -> np.ndarray:
    """Cosine transform of an 8 x 8 mean picture in luma and chroma: 12, 6 and 6 lowest frequencies, absolute but for the constant."""
    rgb = np.repeat(img[..., None], 3, -1) if img.ndim == 2 else img
    small = resize(rgb, 8, 8).astype(float)
    y = small @ (0.299, 0.587, 0.114)
    planes = (y, 128 + small @ (-0.168736, -0.331264, 0.5), 128 + small @ (0.5, -0.418688, -0.081312))
    out, order = [], zigzag()
    for plane, keep, zero in zip(planes, (12, 6, 6), (0, 128, 128)):
        f = (DCT8 @ plane @ DCT8.T).ravel()[order[:keep]]
        out += [f[0] / 8 - zero, *np.abs(f[1:])]
    return np.array(out)


def crophash(img: np.ndarray, windows: list) -> list[int]:
    """phash of each fractional window."""
    g = gray(img)
    h, w = g.shape
    cut = lambda a, n, size: slice(min(int(a * n), n - 1), max(min(int(a * n), n - 1) + 1, min(n, round((a + size) * n))))
    return [phash(g[cut(y, h, wh), cut(x, w, ww)]) for x, y, ww, wh in windows]


def hu_moments(img: np.ndarray) -> np.ndarray:
    """Logarithms of the seven moment invariants of the smaller side of an Otsu threshold (the bright one if equal)."""
    g = resize_max_side(gray(img), 128)
    counts = np.bincount(g.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(below * above * (mass / below - (mass[-1] - mass) / above) ** 2)
    ink = g > int(between.argmax())
    ink = ink if ink.sum() * 2 <= ink.size else ~ink
    ys, xs = np.nonzero(ink)
    if not len(xs):
        return np.zeros(7)
    x, y, n = xs - xs.mean(), ys - ys.mean(), float(len(xs))
    e = lambda p, q: float((x**p * y**q).sum()) / n ** (1 + (p + q) / 2)
    n20, n02, n11, n30, n03, n21, n12 = e(2, 0), e(0, 2), e(1, 1), e(3, 0), e(0, 3), e(2, 1), e(1, 2)
    a, b, c, d = n30 + n12, n21 + n03, n30 - 3 * n12, 3 * n21 - n03
    h = [n20 + n02, (n20 - n02) ** 2 + 4 * n11**2, c**2 + d**2, a**2 + b**2]
    h.append(c * a * (a**2 - 3 * b**2) + d * b * (3 * a**2 - b**2))
    h.append((n20 - n02) * (a**2 - b**2) + 4 * n11 * a * b)
    h.append(abs(d * a * (a**2 - 3 * b**2) - c * b * (3 * a**2 - b**2)))
    return np.array([-np.sign(v) * np.log10(abs(v)) if abs(v) > 1e-30 else 0.0 for v in h])


def _sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sums of all n x n (or n = (rows, columns)) windows by a summed-area table."""
    r, c = (n, n) if isinstance(n, int) else n
    s = np.pad(x.astype(float), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return s[r:, c:] - s[:-r, c:] - s[r:, :-c] + s[:-r, :-c]


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Mean structural similarity over uniform 7 x 7 windows, 0 to 1; under 8 pixels a side gives 0. Sizes are cut to the smaller ones by resizing."""
    h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    if min(h, w) < 8:
        return 0.0
    a, b = resize(gray(a), w, h).astype(float), resize(gray(b), w, h).astype(float)
    ma, mb = _sums(a, 7) / 49, _sums(b, 7) / 49
    va, vb, cov = _sums(a * a, 7) / 49 - ma**2, _sums(b * b, 7) / 49 - mb**2, _sums(a * b, 7) / 49 - ma * mb
    c1, c2 = 2.55**2, 7.65**2
    return float(np.clip(((2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean(), 0, 1))


def ncc(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised cross-correlation of equal sizes, 0 to 1; no variance gives 0."""
    x, y = a.astype(float).ravel() - a.mean(), b.astype(float).ravel() - b.mean()
    n = np.sqrt((x * x).sum() * (y * y).sum())
    return float(np.clip((x * y).sum() / n, 0, 1)) if n > 0 else 0.0


def _scene(scene: np.ndarray, h: int, w: int) -> tuple[tuple[int, int], np.ndarray, np.ndarray]:
    """What all h x w parts need of a scene: the transform's shape, the transform, the spread at each place."""
    s, shape = scene.astype(float) - scene.mean(), (scene.shape[0] + h - 1, scene.shape[1] + w - 1)
    return shape, np.fft.rfft2(s, shape), np.maximum(_sums(s * s, (h, w)) - _sums(s, (h, w)) ** 2 / (h * w), 0)


def template_match(scene: np.ndarray, part: np.ndarray, ready: dict | None = None) -> tuple[float, int, int]:
    """(score, x, y) of the place in the scene that correlates best with the part, the first in reading order; nothing that varies gives zeros.

    The products are by a fast Fourier transform, so every place is tried. `ready` keeps what parts of one size need of this scene.
    """
    h, w = part.shape
    if h > scene.shape[0] or w > scene.shape[1]:
        return 0.0, 0, 0
    ready = {} if ready is None else ready
    if (h, w) not in ready:
        ready[h, w] = _scene(scene, h, w)
    shape, transform, spread = ready[h, w]
    p = part.astype(float) - part.mean()
    norm = np.sqrt(spread * (p * p).sum())
    if not (norm > 1e-6).any():
        return 0.0, 0, 0
    cross = np.fft.irfft2(transform * np.fft.rfft2(p[::-1, ::-1], shape), shape)[h - 1 : scene.shape[0], w - 1 : scene.shape[1]]
    score = np.round(np.where(norm > 1e-6, cross / np.where(norm > 1e-6, norm, 1), 0), 9)
    y, x = np.unravel_index(int(score.argmax()), score.shape)
    return float(np.clip(score[y, x], 0, 1)), int(x), int(y)


def grid_cells(img: np.ndarray, rows: int, cols: int) -> list[tuple[int, int, np.ndarray]]:
    """rows x cols parts (1 to 8 each) by whole-number cuts."""
    rows, cols = min(8, max(1, rows)), min(8, max(1, cols))
    h, w = img.shape[:2]
    return [(r, c, img[r * h // rows : (r + 1) * h // rows, c * w // cols : (c + 1) * w // cols]) for r in range(rows) for c in range(cols)]


def slice_match(a: np.ndarray, b: np.ndarray, rows: int = 2, cols: int = 2, threshold: float = 0.7) -> dict:
    """Where each cell of a lies in b, in four turns; coverage is the share of cells that reach the threshold, a slice has 0.75."""
    cells, scene, ready = [], gray(b), {}
    for r, c, cell in grid_cells(gray(a), rows, cols):
        found = [(*template_match(scene, np.rot90(cell, -k), ready), k) for k in range(4)]
        score, x, y, k = max(found, key=lambda f: (f[0], -f[3]))
        cells.append({"row": r, "col": c, "score": score, "best_x": x, "best_y": y, "rotation": 90 * k})
    good = sum(c["score"] >= threshold for c in cells) / len(cells)
    return {"rows": rows, "cols": cols, "cells": cells, "coverage": good, "mean_score": sum(c["score"] for c in cells) / len(cells), "is_slice_of_a": good >= 0.75}


def contains(a: np.ndarray, b: np.ndarray, least: float = 0.8, side: int = 384) -> tuple[bool, float]:
    """Whether b lies in a at a shared scale, or else a in b; four turns."""
    a, b = gray(a), gray(b)
    scale = min(1.0, side / max(*a.shape, *b.shape))
    a, b = (resize(x, max(1, round(x.shape[1] * scale)), max(1, round(x.shape[0] * scale))) for x in (a, b))
    best = 0.0
    for x, y in ((a, b), (b, a)):
        best = max(best, *(template_match(x, np.rot90(y, -k))[0] for k in range(4)))
        if best >= least:
            return True, best
    return False, best


def histogram_correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson's r mapped to (r + 1) / 2; other lengths, nothing, no variance: 0."""
    if len(a) != len(b) or not len(a) or not np.ptp(a) or not np.ptp(b):
        return 0.0
    return float((np.corrcoef(a, b)[0, 1] + 1) / 2)


def hybrid(a: np.ndarray, b: np.ndarray, descriptor_score: float | None = None) -> float:
    """0.3 phash, 0.3 ssim, 0.4 descriptors; without descriptors the others weigh in for them."""
    parts = [(0.3, 1 - ((phash(a) ^ phash(b)) & (2**64 - 1)).bit_count() / 64), (0.3, ssim(a, b))]
    parts += [(0.4, descriptor_score)] if descriptor_score is not None else []
    return sum(w * s for w, s in parts) / sum(w for w, _ in parts)


def rotated_score(score, a: np.ndarray, b: np.ndarray, enough: float = 0.95) -> float:
    """The best of score(a, turned b); the first that is enough ends the search, in the order of orientations."""
    best = 0.0
    for o in turned(b):
        best = max(best, score(a, o))
        if best >= enough:
            break
    return best


#: 64-bit signatures by algorithm; those of INVARIANT are taken of one orientation only.
HASHES = {"phash": phash, "dhash": dhash, "ahash": ahash, "whash": whash, "edgehash": edgehash, "colorhash": colorhash}
INVARIANT = {"colorhash"}
