"""Regions of a picture: plausibility, suppression of overlapping ones, reading order.

A region without a place (null x, y, w or h) is implausible, neither suppresses nor is suppressed, and comes last in reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.geometry import box, plausible_region
from leafmill.operators.coordinates import _ddl, unplaced
from leafmill.operators.folds import fold


def plausible(regions: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    return regions.filter(plausible_region(box(), F.col(width), F.col(height)))


def survivors(x: list, y: list, w: list, h: list, iou: float = 0.5, contained: float | None = 0.8) -> list[int]:
    """Of boxes from the largest down those that stay, then those without a place."""
    kept: list[int] = []
    loose: list[int] = []
    for j in range(len(x)):
        if None in (x[j], y[j], w[j], h[j]):
            loose.append(j)
            continue
        area = w[j] * h[j]
        for i in kept:
            wide, tall = min(x[i] + w[i], x[j] + w[j]) - max(x[i], x[j]), min(y[i] + h[i], y[j] + h[j]) - max(y[i], y[j])
            both = wide * tall if wide > 0 and tall > 0 else 0
            if area > 0 and contained is not None and both / area >= contained:
                break
            union = area + w[i] * h[i] - both
            if union > 0 and both / union > iou:
                break
        else:
            kept.append(j)
    return kept + loose


def arranged(boxes: list[tuple[int, int, int, int]], width: int, height: int, least: float = 0.02, most: float = 0.95, slimmest: float = 0.1, widest: float = 10.0) -> list[tuple[int, int, int, int]]:
    """What plausible(), suppress(), reading_order() and with_fallback() make of one picture's boxes (x, y, w, h), within Python."""
    good = [b for b in boxes if b[3] > 0 and least <= b[2] * b[3] / (width * height) <= most and slimmest <= b[2] / b[3] <= widest and b[0] >= 0 and b[1] >= 0 and b[0] + b[2] <= width and b[1] + b[3] <= height]
    good = sorted(good, key=lambda b: -b[2] * b[3])
    good = [good[i] for i in survivors(*map(list, zip(*good)))] if good else []
    rows: list[list[tuple[int, int, int, int]]] = []
    for b in sorted(good, key=lambda b: b[1] + b[3] / 2):
        last = rows[-1][-1] if rows else None
        if last and abs((b[1] + b[3] / 2) - (last[1] + last[3] / 2)) < last[3] * 0.5:
            rows[-1].append(b)
        else:
            rows.append([b])
    return [b for r in rows for b in sorted(r, key=lambda b: b[0])] or [(0, 0, width, height)]


def suppress(regions: DataFrame, iou: float = 0.5, contained: float | None = 0.8, key: str = "doc_id", tie: str = "region_index") -> DataFrame:
    """regions without those that a larger one has in it (at least that share, None: no such test) or overlaps by more than that intersection over union.

    From the largest down (ties in the order of `tie`); what is dropped drops nothing.
    """

    def step(g: dict[str, list]) -> dict[str, list]:
        kept = survivors(g["x"], g["y"], g["w"], g["h"], iou, contained)
        return {k: [v[i] for i in kept] for k, v in g.items()}

    order: list[Column | str] = [(F.col("w") * F.col("h")).desc_nulls_last(), tie]
    return fold(regions, [key], order, step, _ddl(regions))


def reading_order(regions: DataFrame, key: str = "doc_id", tie: str = "region_index") -> DataFrame:
    """With row_no and place, from 0: a region is in the row of the one before (by centre) if their centres differ by less than half that one's height."""
    down = Window.partitionBy(key).orderBy(unplaced(regions), F.col("__c").asc_nulls_last(), tie)
    new = F.abs(F.col("__c") - F.lag("__c").over(down)) >= F.lag("h").over(down) * 0.5
    out = regions.withColumn("__c", F.col("y") + F.col("h") / 2).withColumn("__new", F.coalesce(new.cast("int"), F.lit(0)))
    out = out.withColumn("row_no", F.sum("__new").over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(unplaced(regions), "row_no", F.col("x").asc_nulls_last(), "__c", tie)) - 1
    return out.withColumn("place", place).drop("__c", "__new")


def combine(*found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Regions of several detectors together, overlapping ones suppressed; numbered anew in the order given."""
    every = None
    for i, f in enumerate(found):
        f = f.withColumn("__d", F.lit(i))
        every = f if every is None else every.unionByName(f)
    again = F.row_number().over(Window.partitionBy(key).orderBy("__d", "region_index")) - 1
    return suppress(every.withColumn("region_index", again.cast("int")).drop("__d"), key=key)


def whole_picture(profiles: DataFrame, key: str = "doc_id") -> DataFrame:
    """The one region that stands for a picture in which no detector found any."""
    zero = F.lit(0)
    return profiles.select(key, zero.alias("region_index"), zero.alias("x"), zero.alias("y"), F.col("width").alias("w"), F.col("height").alias("h"), F.lit(1.0).alias("confidence"), F.lit("whole").alias("region_type"))


def with_fallback(regions: DataFrame, profiles: DataFrame, key: str = "doc_id") -> DataFrame:
    missing = profiles.join(regions.select(key).distinct(), key, "left_anti")
    return regions.unionByName(whole_picture(missing, key), allowMissingColumns=True)
