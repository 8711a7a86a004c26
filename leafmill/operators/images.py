"""Pixel operators on pictures as Spark's image source gives them: (height, width, nChannels, data), channels in the order B, G, R, A.

Decoding is Spark's; the arithmetic is numpy within an Arrow UDF, a picture at a time. Pictures larger than LARGEST on a side are measured
on the means of squares of pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.slicing import TALL, parameters

LARGEST, LARGEST_FOR_REGIONS = 1000, 500
LOW_CONTRAST, HIGH_NOISE, LONG = 0.5, 0.4, 3.0

MEASURES = "contrast double, noise double, edge_sharpness double, content_type string, has_code_blocks boolean, multiple_regions boolean"


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """(h, w) for one channel, else (h, w, c) in the order R, G, B, A."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return a[:, :, 0] if channels == 1 else a[:, :, [2, 1, 0, *range(3, channels)]]


def gray(a: np.ndarray) -> np.ndarray:
    """Luma of 299 : 587 : 114, rounded, as is usual."""
    if a.ndim == 2:
        return a
    r, g, b = (a[:, :, i].astype(np.uint32) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def shrink(a: np.ndarray, most: int) -> np.ndarray:
    """Means of squares of pixels, all of them, so that no side is longer than `most`; squares at the far edges may be smaller."""
    k = -(-max(a.shape[:2]) // most)
    if k == 1:
        return a
    y, x = np.arange(0, a.shape[0], k), np.arange(0, a.shape[1], k)
    sums = np.add.reduceat(np.add.reduceat(a.astype(np.uint32), y, axis=0), x, axis=1)
    size = np.diff(np.append(y, a.shape[0]))[:, None] * np.diff(np.append(x, a.shape[1]))[None, :]
    return np.rint(sums / size.reshape(*size.shape, *(1,) * (a.ndim - 2))).astype(np.uint8)


def contrast(g: np.ndarray) -> float:
    return min(float(g.astype(np.float32).std()) / 80.0, 1.0)


def _around(g: np.ndarray) -> Callable[[int, int], np.ndarray]:
    p = np.pad(g.astype(np.float32), 1, mode="edge")
    h, w = g.shape
    return lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]


def noise(g: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian, scaled."""
    at = _around(g)
    return min(float((at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1) - 4 * at(0, 0)).var()) / 800.0, 1.0)


def sharpness(g: np.ndarray) -> float:
    """Spread of the Sobel gradient's length, scaled."""
    at = _around(g)
    right = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    down = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    return min(float(np.hypot(right, down).std()) / 40.0, 1.0)


def longest_run(flags: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def has_grid(g: np.ndarray) -> bool:
    """Three or more starts of runs of rows of low variance, one of the runs two rows long."""
    v = g.astype(np.float32).var(axis=1)
    low = v < np.percentile(v, 10)
    return bool((np.diff(low.astype(int)) == 1).sum() >= 3 and longest_run(low) >= 2)


def has_code(g: np.ndarray) -> bool:
    """A dark band of more than a twentieth of the height."""
    dark = g.mean(axis=1) < 60
    return longest_run(dark) > len(dark) * 0.05


def content_type(a: np.ndarray) -> str:
    """table, mixed (with dark parts) or document. Means are over all channels, alpha included."""
    if has_grid(gray(a)):
        return "table"
    return "mixed" if float(((a.mean(axis=2) if a.ndim == 3 else a) < 50).mean()) > 0.15 else "document"


def distinct_colors(colors: np.ndarray, apart: float = 40.0) -> int:
    """Leaders: a colour counts if it is that far from all that counted before."""
    leaders: list[np.ndarray] = []
    for c in colors:
        if all(np.sqrt(((c - x) ** 2).sum()) >= apart for x in leaders):
            leaders.append(c)
    return len(leaders)


def many_regions(a: np.ndarray) -> bool:
    """Whether the mean colours of 4 x 4 cells differ: much and two of them apart, or three of them apart."""
    if a.ndim != 3:
        return False
    h, w = a.shape[0] // 4, a.shape[1] // 4
    if h < 10 or w < 10:
        return False
    cells = a[: 4 * h, : 4 * w].reshape(4, h, 4, w, -1).mean(axis=(1, 3)).reshape(16, -1)
    n = distinct_colors(cells)
    return n >= 3 or (n >= 2 and float(cells.std(axis=0).mean()) > 25)


def find_boxes(a: np.ndarray, cell: int = 8, apart: float = 30.0, reach: int = 2) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) in pixels around what stands out from the colour of the picture's border.

    Means of cells that differ from the border's median by more than `apart` count; cells up to `reach` apart are one region.
    """
    h, w = a.shape[0] // cell, a.shape[1] // cell
    if not h or not w:
        return []
    means = a[: h * cell, : w * cell].reshape(h, cell, w, cell, -1).mean(axis=(1, 3))
    edge = np.concatenate([means[0], means[-1], means[:, 0], means[:, -1]])
    mask = np.abs(means - np.median(edge, axis=0)).max(axis=2) > apart
    label = np.full((h, w), -1)
    boxes = []
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x] >= 0:
            continue
        label[y, x] = len(boxes)
        todo, (top, left, low, right) = [(y, x)], (y, x, y, x)
        while todo:
            i, j = todo.pop()
            top, left, low, right = min(top, i), min(left, j), max(low, i), max(right, j)
            i0, j0 = max(0, i - reach), max(0, j - reach)
            near = np.argwhere(mask[i0 : i + reach + 1, j0 : j + reach + 1] & (label[i0 : i + reach + 1, j0 : j + reach + 1] < 0)) + (i0, j0)
            label[near[:, 0], near[:, 1]] = len(boxes)
            todo += [tuple(p) for p in near]
        boxes.append((int(left) * cell, int(top) * cell, int(right - left + 1) * cell, int(low - top + 1) * cell))
    return boxes


def resize(a: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, pixel centres on pixel centres."""
    h, w = max(1, round(a.shape[0] * scale)), max(1, round(a.shape[1] * scale))
    at = lambda n, m: np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
    y, x = at(h, a.shape[0]), at(w, a.shape[1])
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    more = (1,) * (a.ndim - 2)
    fy, fx = (y - y0).reshape(-1, 1, *more), (x - x0).reshape(1, -1, *more)
    f = a.astype(np.float64)
    top, low = f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx, f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def blur3(a: np.ndarray) -> np.ndarray:
    """The mean of 3 x 3 pixels, edges repeated."""
    p = np.pad(a.astype(np.float64), ((1, 1), (1, 1)) + ((0, 0),) * (a.ndim - 2), mode="edge")
    return sum(p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)) / 9


def sharpen(a: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Unsharp mask: the difference to the 3 x 3 mean, added again."""
    return np.clip(np.rint(a + strength * (a - blur3(a))), 0, 255).astype(np.uint8)


def raise_contrast(a: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Away from the mean by half the strength."""
    return np.clip(np.rint((a.astype(np.float64) - a.mean()) * (1 + strength / 2) + a.mean()), 0, 255).astype(np.uint8)


def local_contrast(g: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Histogram equalisation by tiles, limited and blended between tile centres; of a colour picture each channel.

    Counts above `clip` times the mean are spread over all grays, so that flat parts don't turn to noise.
    """
    if g.ndim == 3:
        return np.stack([local_contrast(g[:, :, i], tiles, clip) for i in range(g.shape[2])], axis=2)
    h, w = g.shape
    ty, tx = min(tiles, h), min(tiles, w)
    ys, xs = np.linspace(0, h, ty + 1).astype(int), np.linspace(0, w, tx + 1).astype(int)
    maps = np.empty((ty, tx, 256))
    for i in range(ty):
        for j in range(tx):
            n = np.bincount(g[ys[i] : ys[i + 1], xs[j] : xs[j + 1]].ravel(), minlength=256).astype(float)
            limit = clip * n.sum() / 256
            n = np.minimum(n, limit) + np.maximum(n - limit, 0).sum() / 256
            maps[i, j] = np.cumsum(n) * 255 / n.sum()

    def blend(n: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        centers = (edges[1:] + edges[:-1] - 1) / 2
        hi = np.clip(np.searchsorted(centers, np.arange(n)), 0, len(centers) - 1)
        lo = np.maximum(hi - 1, 0)
        gap = np.where(hi > lo, centers[hi] - centers[lo], 1.0)
        return lo, hi, np.clip((np.arange(n) - centers[lo]) / gap, 0, 1)

    y0, y1, fy = (v[:, None] for v in blend(h, ys))
    x0, x1, fx = (v[None, :] for v in blend(w, xs))
    top, low = maps[y0, x0, g] * (1 - fx) + maps[y0, x1, g] * fx, maps[y1, x0, g] * (1 - fx) + maps[y1, x1, g] * fx
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def vivid(a: np.ndarray, color: float = 1.5, strength: float = 1.3) -> np.ndarray:
    """Colours away from their gray, then everything away from the mean gray; coloured print stands out."""
    g, f = gray(a).astype(np.float64), a.astype(np.float64)
    if a.ndim == 3:
        f = g[:, :, None] + color * (f[:, :, :3] - g[:, :, None])
    out = np.clip(np.rint((f - g.mean()) * strength + g.mean()), 0, 255).astype(np.uint8)
    return np.concatenate([out, a[:, :, 3:]], axis=2) if a.ndim == 3 else out


def outline(a: np.ndarray, boxes: list[tuple[int, int, int, int]], color: tuple[int, ...] = (255, 0, 0), width: int = 1) -> np.ndarray:
    """A copy with the frames of boxes (x1, y1, x2, y2) drawn in; what lies outside the picture is left out."""
    out = np.repeat(a[:, :, None], 3, axis=2) if a.ndim == 2 else a.copy()
    h, w = out.shape[:2]
    for x1, y1, x2, y2 in boxes:
        x1, x2, y1, y2 = max(0, x1), min(w, x2 + 1), max(0, y1), min(h, y2 + 1)
        if x1 >= x2 or y1 >= y2:
            continue
        for part in (np.s_[y1 : min(y2, y1 + width), x1:x2], np.s_[max(y1, y2 - width) : y2, x1:x2], np.s_[y1:y2, x1 : min(x2, x1 + width)], np.s_[y1:y2, max(x1, x2 - width) : x2]):
            out[part][..., :3] = color
    return out


def annotate(pictures: DataFrame, boxes: DataFrame, color: tuple[int, int, int] = (255, 0, 0), width: int = 1, key: str = "doc_id") -> DataFrame:
    """Pictures (key, height, width, nChannels, data) with the frames of their boxes (key, x, y, w, h; relative, origin at the bottom) drawn in. Boxes without a place aren't drawn."""
    at = F.struct(*[F.col(c).cast("double").alias(c) for c in "xywh"])
    listed = boxes.filter("x is not null and y is not null and w is not null and h is not null").groupBy(key).agg(F.collect_list(at).alias("__b"))
    joined = pictures.join(listed, key, "left").withColumn("__b", F.coalesce("__b", F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, channels = [], []
            for h, w, c, d, found in zip(*[batch.column(i).to_pylist() for i in range(1, 6)]):
                corners = [tuple(int(v) for v in (b["x"] * w, (1 - b["y"] - b["h"]) * h, (b["x"] + b["w"]) * w, (1 - b["y"]) * h)) for b in found]
                a = outline(pixels(h, w, c, d), corners, color, width)
                channels.append(a.shape[2])
                data.append(np.ascontiguousarray(a[:, :, [2, 1, 0, *range(3, a.shape[2])]]).tobytes())
            if data:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(channels, pa.int32()), pa.array(data, pa.binary())], names=[*batch.schema.names[:5]])

    narrow = joined.select(key, "height", "width", "nChannels", "data", "__b")
    return narrow.mapInArrow(run, f"`{key}` {dict(pictures.dtypes)[key]}, height int, width int, nChannels int, data binary")


def rotate(a: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """Counter-clockwise about the middle, nearest pixel, the size kept."""
    t = np.deg2rad(degrees)
    cy, cx = (a.shape[0] - 1) / 2, (a.shape[1] - 1) / 2
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    sx = np.rint(np.cos(t) * (x - cx) - np.sin(t) * (y - cy) + cx).astype(int)
    sy = np.rint(np.sin(t) * (x - cx) + np.cos(t) * (y - cy) + cy).astype(int)
    inside = (sx >= 0) & (sx < a.shape[1]) & (sy >= 0) & (sy < a.shape[0])
    out = np.full_like(a, fill)
    out[inside] = a[sy[inside], sx[inside]]
    return out


def skew(g: np.ndarray, most: float = 5.0, step: float = 0.5) -> float:
    """The rotation within +/- most degrees after which dark pixels are most concentrated in rows; 0 of equals first."""
    dark = 255 - g.astype(np.float64)
    angles = sorted(np.arange(-most, most + step / 2, step), key=abs)
    return float(max(angles, key=lambda d: (round(float(rotate(dark, d, 0).sum(axis=1).var()), 6), -abs(d))))


def prepare(a: np.ndarray, scale: float, steps: list[str]) -> np.ndarray:
    """A picture after the steps of its preprocessing_plan."""
    if scale > 1:
        a = resize(a, scale)
    for s in steps:
        name, _, strength = s.partition("_")
        a = PLAN_STEPS[name](a, float(strength or 1))
    return a


def camera_mark(data: bytes) -> bool:
    """Whether a JPEG's EXIF block names a camera's make or model."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            block = data[at + 10 : at + 2 + size]
            order = {b"II": "little", b"MM": "big"}.get(block[:2])
            if order is None:
                return False
            start = int.from_bytes(block[4:8], order)
            n = int.from_bytes(block[start : start + 2], order)
            return any(int.from_bytes(block[start + 2 + 12 * i :][:2], order) in (0x010F, 0x0110) for i in range(n))
        at += 2 + size
    return False


def measure(a: np.ndarray) -> tuple:
    s = shrink(a, LARGEST)
    g = gray(s)
    return contrast(g), noise(g), sharpness(g), content_type(s), has_code(g), a.ndim == 3 and many_regions(shrink(a, LARGEST_FOR_REGIONS))


def _each(pictures: DataFrame, schema: str, work: Callable[[np.ndarray], tuple], keys: list[str]) -> DataFrame:
    """A row of keys and work(pixels) for each picture (keys, height, width, nChannels, data)."""
    names = [p.split()[0] for p in schema.split(", ")]
    out = pictures.select(*keys).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", " + schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(keys)
            cols = [batch.column(k + i).to_pylist() for i in range(4)]
            rows = list(zip(*[work(pixels(*p)) for p in zip(*cols)]))
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], *[pa.array(r) for r in rows]], names=[*keys, *names])

    return pictures.select(*keys, "height", "width", "nChannels", "data").mapInArrow(run, ddl)


def profiles(pictures: DataFrame, key: str = "doc_id", exif: str | None = None) -> DataFrame:
    """A row of 15 fields a picture: measures, and what they recommend. exif names a column that is true for pictures with a camera's mark."""
    pictures = pictures.withColumn("__exif", F.col(exif) if exif else F.lit(False))
    got = _each(pictures, MEASURES, measure, [key, "width", "height", "__exif"])
    return recommend(got, F.col("__exif")).drop("__exif")


def recommend(measured: DataFrame, camera: Column | None = None) -> DataFrame:
    """Source, slices, preprocessing and regions from the measures: plain column logic.

    A long picture (height over three times the width) is cut, never searched for regions.
    """
    long = F.col("height") / F.col("width") > LONG
    source = F.when(F.col("edge_sharpness") > 0.7, "digital").when(F.col("edge_sharpness") < 0.4, "photo").otherwise("unknown")
    source = F.when(camera, "photo").otherwise(source) if camera is not None else source
    out = measured.withColumn("source", source).withColumn("is_long_screenshot", long)
    out = out.withColumn("has_multiple_regions", ~F.col("is_long_screenshot") & F.col("multiple_regions"))
    size = parameters(F.col("height"), F.col("content_type"), F.col("has_code_blocks"))
    return out.withColumns({
        "needs_slicing": F.col("height") > TALL,
        "needs_preprocessing": (F.col("contrast") < LOW_CONTRAST) | (F.col("noise") > HIGH_NOISE) | (F.col("source") == "photo"),
        "recommended_region_detection": F.col("has_multiple_regions"),
        "slice_height": size["slice_height"], "overlap": size["overlap"],
    }).drop("multiple_regions")


def preprocessing_plan(profile: DataFrame, color: bool = True, binarize: bool = False, min_width: int = 1500) -> DataFrame:
    """With `scale` and `steps`, the operations in order, that a picture of that profile gets."""
    c, n = F.col("contrast"), F.col("noise")
    step = lambda name, when=None: F.when(when, F.lit(name)) if when is not None else F.lit(name)
    photo = F.array(step("gamma"), step("color", (c < 0.6) & F.lit(color)), step("contrast", c < 0.7), step("denoise", n > 0.3), step("sharpen"), step("binarize", F.lit(binarize)))
    digital = F.when(c < 0.5, F.array(step("color", F.lit(color)), step("contrast_0.8"), step("sharpen_0.3"))).when(c < 0.7, F.array(F.lit("contrast_0.5"))).otherwise(F.array().cast("array<string>"))
    scale = F.when(F.col("width") < min_width, F.least(F.lit(min_width) / F.col("width"), F.lit(2.0))).otherwise(F.lit(1.0))
    return profile.withColumn("scale", scale).withColumn("steps", F.filter(F.when(F.col("source") == "photo", photo).otherwise(digital), lambda s: s.isNotNull()))


# single operations on pixel arrays


def gamma(a: np.ndarray, compat: bool = False) -> np.ndarray:
    """Brighten dark pictures and darken bright ones by a power of 0.7 or 1.3; alpha stays.

    compat takes the inverse powers, on all channels.
    """
    mean = float((a.mean(axis=2) if a.ndim == 3 else a).mean()) / 255.0
    if 0.3 <= mean <= 0.7:
        return a
    power = 0.7 if mean < 0.3 else 1.3
    table = ((np.arange(256) / 255.0) ** (1 / power if compat else power) * 255).astype(np.uint8)
    out = table[a]
    if a.ndim == 3 and a.shape[2] == 4 and not compat:
        out[:, :, 3] = a[:, :, 3]
    return out


def stretch(channel: np.ndarray) -> np.ndarray:
    """The 2nd to the 98th percentile over the whole range, unless they are closer than 10."""
    lo, hi = np.percentile(channel, [2, 98])
    return channel if hi - lo < 10 else np.clip((channel.astype(float) - lo) / (hi - lo) * 255, 0, 255).astype(np.uint8)


def binarize(g: np.ndarray, threshold: int = 128) -> np.ndarray:
    return np.where(g > threshold, 255, 0).astype(np.uint8)


def otsu(g: np.ndarray) -> int:
    """The first threshold of the largest variance between both sides, from integer sums."""
    n = np.bincount(g.ravel(), minlength=256).astype(np.int64)
    n0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    below, total, whole = n0.astype(float), float(n0[-1]), float(s0[-1])
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.where((n0 > 0) & (n0 < n0[-1]), (whole * below - s0 * total) ** 2 / (below * (total - below)), 0.0)
    return int(v.argmax())


def block_binarize(g: np.ndarray, block: int = 50, k: float = 0.5, r: float = 128.0) -> np.ndarray:
    """Each block against mean * (1 + k (sd / r - 1)) of its own pixels."""
    out = np.empty_like(g)
    for y in range(0, g.shape[0], block):
        for x in range(0, g.shape[1], block):
            b = g[y : y + block, x : x + block].astype(np.float32)
            out[y : y + block, x : x + block] = np.where(b > b.mean() * (1 + k * (b.std() / r - 1)), 255, 0)
    return out


def median3(a: np.ndarray) -> np.ndarray:
    """The median of 3 x 3 pixels, edges repeated."""
    if a.ndim == 3:
        return np.stack([median3(a[:, :, i]) for i in range(a.shape[2])], axis=2)
    p = np.pad(a, 1, mode="edge")
    return np.median([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)], axis=0).astype(np.uint8)


def whiten_background(a: np.ndarray, threshold: int = 200) -> np.ndarray:
    out = a.copy()
    out[(a[:, :, :3].mean(axis=2) if a.ndim == 3 else a) > threshold] = 255
    return out


def red_to_dark(a: np.ndarray) -> np.ndarray:
    """Gray, the darker the redder, with contrast raised by half about the middle; a gray picture as it is."""
    if a.ndim == 2:
        return a
    r, g, b = (a[:, :, i].astype(float) for i in range(3))
    return np.clip((255 - np.clip(r - np.maximum(g, b), 0, 255) - 128) * 1.5 + 128, 0, 255).astype(np.uint8)


#: Steps of preprocessing plans, each with its strength.
PLAN_STEPS: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {
    "gamma": lambda a, _: gamma(a), "color": lambda a, _: OPERATIONS["stretch"](a), "contrast": raise_contrast, "denoise": lambda a, _: median3(a), "sharpen": sharpen, "binarize": lambda a, _: OPERATIONS["otsu"](a),
}

OPERATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "gray": gray, "gamma": gamma, "stretch": lambda a: np.stack([stretch(a[:, :, i]) for i in range(a.shape[2])], axis=2) if a.ndim == 3 else stretch(a),
    "binarize": lambda a: binarize(gray(a)), "otsu": lambda a: binarize(gray(a), otsu(gray(a))), "block_binarize": lambda a: block_binarize(gray(a)),
    "median3": median3, "sharpen": sharpen, "contrast": raise_contrast, "local_contrast": local_contrast, "vivid": vivid, "deskew": lambda a: rotate(a, skew(gray(a))), "whiten_background": whiten_background, "red_to_dark": red_to_dark,
}


def apply(pictures: DataFrame, operations: list[str], key: str = "doc_id") -> DataFrame:
    """Pictures (key, height, width, nChannels, data) after the operations, one after the other."""
    chosen = [OPERATIONS[o] for o in operations]

    def work(a: np.ndarray) -> tuple:
        for o in chosen:
            a = o(a)
        h, w = a.shape[:2]
        c = 1 if a.ndim == 2 else a.shape[2]
        back = a if a.ndim == 2 else a[:, :, [2, 1, 0, *range(3, c)]]
        return h, w, c, np.ascontiguousarray(back).tobytes()

    got = _each(pictures, "h long, w long, c long, d binary", work, [key])
    return got.select(key, F.col("h").cast("int").alias("height"), F.col("w").cast("int").alias("width"), F.col("c").cast("int").alias("nChannels"), F.col("d").alias("data"))


def code_region(pictures: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, is_code_block): more than 0.4 of the pixels darker than 60."""
    return _each(pictures, "is_code_block boolean", lambda a: (bool((gray(a) < 60).mean() > 0.4),), [key])


def otsu_of_counts(counts: DataFrame, key: str = "key", value: str = "value", n: str = "n") -> DataFrame:
    """(key, threshold) from histograms (key, value, n), without pixels: running sums over at most 256 rows a key."""
    up = Window.partitionBy(key).orderBy(value)
    every = Window.partitionBy(key)
    s = F.col(value) * F.col(n)
    got = counts.select(key, value, F.sum(n).over(up).alias("n0"), F.sum(s).over(up).alias("s0"), F.sum(n).over(every).alias("nn"), F.sum(s).over(every).alias("ss"))
    d = lambda c: F.col(c).cast("double")
    top = d("ss") * d("n0") - d("s0") * d("nn")
    between = F.when(F.col("n0") < F.col("nn"), top * top / (d("n0") * (d("nn") - d("n0")))).otherwise(F.lit(0.0))
    return got.groupBy(key).agg(F.max_by(value, F.struct(between, -F.col(value))).alias("threshold"))


def block_statistics(pixel_rows: DataFrame, block: int = 50, key: str = "key") -> DataFrame:
    """(key, by, bx, mean, sd, threshold) of blocks of pixels given as rows (key, y, x, v)."""
    by, bx = F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx")
    got = pixel_rows.groupBy(key, by, bx).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return got.withColumn("threshold", F.col("mean") * (1 + 0.5 * (F.col("sd") / 128 - 1)))
