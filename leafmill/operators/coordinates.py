"""From boxes of overlapping slices to one page: mapping, removal of double readings, reading order, lines of text.

Boxes without a place (null x, y, w or h) are copies of none, come last in reading order and are on no line (null line_no and
seg_no); their text is left out of lines of text. Boxes with a null key make one page. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.geometry import box, from_slice
from leafmill.operators.folds import fold
from leafmill.operators.layout import joined

#: Slice tables of up to this many rows are broadcast; beyond it the join is by key.
MAX_BROADCAST_SLICES = 100_000


def map_slices(boxes: DataFrame, slices: DataFrame, key: str = "doc_id") -> DataFrame:
    """boxes (key, slice_index, ..., relative to the slice, origin at the bottom) on the whole page, origin at the top.

    slices: (key, slice_index, y_start, y_end, page_height). The boxes' own place is kept as `orig`; a null
    confidence counts as 1. Boxes of slices that aren't listed are left out.
    """
    side = slices.select(key, "slice_index", *[F.col(c).alias(f"__{c}") for c in ("y_start", "y_end", "page_height")])
    if side.limit(MAX_BROADCAST_SLICES + 1).count() <= MAX_BROADCAST_SLICES:
        side = F.broadcast(side)
    at = boxes.join(side, [key, "slice_index"])
    x, y, w, h = from_slice(box(), F.col("__y_start"), F.col("__y_end"), F.col("__page_height"))
    return at.withColumns({
        "orig": F.struct("x", "y", "w", "h"), "x": x, "y": y, "w": w, "h": h, "confidence": F.coalesce("confidence", F.lit(1.0)),
    }).drop("__y_start", "__y_end", "__page_height")


def _similar(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    s, t = a.strip(), b.strip()
    if s == t:
        return 1.0
    if s in t or t in s:
        return 0.9
    x, y = set(s), set(t)
    return len(x & y) / len(x | y)


def _kept(g: dict[str, list], overlap: float, similarity: float, reach: float) -> list[int]:
    x, y, w, h, text, conf = (g[c] for c in ("x", "y", "w", "h", "text", "confidence"))
    n = len(x)
    placed = [None not in b for b in zip(x, y, w, h)]
    gone = [False] * n
    for i in range(n):
        if gone[i] or not placed[i]:
            continue
        right, low, area = x[i] + w[i], y[i] + h[i], w[i] * h[i]
        for j in range(i + 1, n):
            if not placed[j]:
                continue
            if y[j] - low > reach:
                break
            if gone[j]:
                continue
            wide, tall = min(right, x[j] + w[j]) - max(x[i], x[j]), min(low, y[j] + h[j]) - max(y[i], y[j])
            least = min(area, w[j] * h[j])
            if wide <= 0 or tall <= 0 or least <= 0 or wide * tall / least <= overlap or _similar(text[i], text[j]) <= similarity:
                continue
            if (conf[j] or 0) > (conf[i] or 0):
                gone[i] = True
                break
            gone[j] = True
    return [i for i in range(n) if not gone[i]]


def deduplicate(boxes: DataFrame, overlap: float = 0.5, similarity: float = 0.8, reach: float = 0.02, key: str = "doc_id", tie: tuple[str, ...] = ("slice_index", "box_no"), placed: bool = False) -> DataFrame:
    """boxes without second readings of the same text in the same place; with `placed` also their `place` in reading order, from 0.

    Downwards (y, x, then the tie columns) each box that is left is held against the later ones that begin within
    `reach` of its lower edge. Of two that overlap by more than `overlap` of the smaller and read alike
    the more confident one stays, the earlier on a tie; a box that is dropped drops no other after that. A null text is like none.
    """
    names = boxes.columns

    def step(g: dict[str, list]) -> dict[str, list]:
        kept = _kept(g, overlap, similarity, reach)
        out = {c: [g[c][i] for i in kept] for c in names}
        if placed:
            last = (True, 0)
            key_of = lambda i: (None in (g["x"][i], g["y"][i], g["w"][i], g["h"][i]), *(last if g[c][i] is None else (False, g[c][i]) for c in ("y", "x", "box_no")))
            out["place"] = [0] * len(kept)
            for p, at in enumerate(sorted(range(len(kept)), key=lambda k: key_of(kept[k]))):
                out["place"][at] = p
        return out

    order = [F.col(c).asc_nulls_last() for c in ("y", "x", *[t for t in tie if t in names])]
    return fold(boxes, [key], order, step, _ddl(boxes) + (", place int" if placed else ""))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def reading_order(boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """boxes with `place`, from 0: downwards, then to the right."""
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(unplaced(boxes), *[F.col(c).asc_nulls_last() for c in ("y", "x", "box_no")])) - 1)


def unplaced(boxes: DataFrame) -> Column:
    """Whether a box lacks any part of its place."""
    return F.greatest(F.lit(False), *[F.col(c).isNull() for c in "xywh" if c in boxes.columns])


def merge_results(boxes: DataFrame, slices: DataFrame, overlap: float = 0.5, similarity: float = 0.8, reach: float = 0.02, key: str = "doc_id") -> DataFrame:
    """The boxes of all slices of a page, each text once, with `place` in reading order. One exchange, by key: boxes are numbered where double readings go."""
    return deduplicate(map_slices(boxes, slices, key=key), overlap, similarity, reach, key, placed=True)


def _line_of(y: list, h: list, tolerance: float) -> list[int | None]:
    line, out, ay, ah = -1, [], 0.0, 0.0
    for a, b in zip(y, h):
        if a is None or b is None:
            out.append(None)
            continue
        if line < 0 or abs((a + b / 2) - (ay + ah / 2)) > min(tolerance, (b + ah) / 2 * 0.5):
            line, ay, ah = line + 1, a, b
        out.append(line)
    return out


def _segment_of(g: dict[str, list], tolerance: float, gap: float) -> tuple[list[int | None], list[int | None], list[int]]:
    """Line and segment of each box, and the order of those that have one: by line, then to the right."""
    line = _line_of(g["y"], g["h"], tolerance)
    line = [None if None in (x, w) else n for n, x, w in zip(line, g["x"], g["w"])]
    order = sorted((i for i, n in enumerate(line) if n is not None), key=lambda i: (line[i], g["x"][i], g["box_no"][i]))
    seg: list[int | None] = [None] * len(line)
    for before, i in zip([None, *order], order):
        if before is None or line[before] != line[i]:
            seg[i] = 0
        else:
            seg[i] = seg[before] + (g["x"][i] - (g["x"][before] + g["w"][before]) > gap)
    return line, seg, order


def line_numbers(boxes: DataFrame, tolerance: float = 0.01, key: str = "doc_id") -> DataFrame:
    """boxes with line_no, from 0: a box is on the line of the line's *first* box if their centres differ by no
    more than the tolerance, or half their mean height if that is less. The anchor moves with each line, which no window can say."""
    step = lambda g: g | {"line_no": _line_of(g["y"], g["h"], tolerance)}
    return fold(boxes, [key], [F.col("y").asc_nulls_last(), "box_no"], step, _ddl(boxes) + ", line_no int")


def segments(boxes: DataFrame, tolerance: float = 0.01, gap: float = 0.15, key: str = "doc_id") -> DataFrame:
    """boxes with line_no and seg_no within the line, from 0: a gap wider than `gap` to the box on the left starts a new one. One fold for both."""

    def step(g: dict[str, list]) -> dict[str, list]:
        line, seg, _ = _segment_of(g, tolerance, gap)
        return g | {"line_no": line, "seg_no": seg}

    return fold(boxes, [key], [F.col("y").asc_nulls_last(), "box_no"], step, _ddl(boxes) + ", line_no int, seg_no int")


def merge_to_text(boxes: DataFrame, keep_lines: bool = True, tolerance: float = 0.01, gap: float = 0.05, key: str = "doc_id") -> DataFrame:
    """(key, text): lines joined by line ends, boxes of a segment by spaces; without keep_lines all in box order by spaces. Null texts are left out."""
    if not keep_lines:
        return boxes.groupBy(key).agg(joined(F.collect_list(F.struct("box_no", "text")), " ").alias("text"))

    def step(g: dict[str, list]) -> dict[str, list]:
        line, seg, order = _segment_of(g, tolerance, gap)
        parts: dict[tuple, list[str]] = {}
        for i in order:
            if g["text"][i] is not None:
                parts.setdefault((line[i], seg[i]), []).append(g["text"][i])
        return {key: g[key][:1], "text": ["\n".join(" ".join(p) for p in parts.values())]}

    narrow = boxes.select(key, "box_no", "text", "x", "y", "w", "h")
    return fold(narrow, [key], [F.col("y").asc_nulls_last(), "box_no"], step, f"`{key}` {dict(boxes.dtypes)[key]}, text string")
