"""How tall pictures are cut into overlapping slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.folds import fold

TALL = 4000
MAX_HEIGHT, OVERLAP = 5000, 400
CODE_HEIGHT, TABLE_OVERLAP = 4000, 600
#: The plain command's slicer: taller slices, a page each, double readings kept.
PAGE_HEIGHT, PAGE_OVERLAP = 10_000, 500


def parameters(height: Column, content_type: Column, has_code: Column) -> Column:
    """struct(slice_height, overlap): the whole picture up to TALL; lower slices with code, more overlap with tables."""
    return F.struct(
        F.when(height <= TALL, height).when(has_code, CODE_HEIGHT).otherwise(MAX_HEIGHT).cast("int").alias("slice_height"),
        F.when(height <= TALL, 0).when(content_type == "table", TABLE_OVERLAP).otherwise(OVERLAP).cast("int").alias("overlap"),
    )


def _size(pictures: DataFrame, max_height: int, overlap: int) -> tuple[Column, Column]:
    """A picture's own slice_height and overlap, if it has such columns and they aren't 0."""
    own = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(d)) if c in pictures.columns else F.lit(d)
    return own("slice_height", max_height), own("overlap", overlap)


def plan(pictures: DataFrame, max_height: int = MAX_HEIGHT, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """(key, slice_index, y_start, y_end): slices of max_height that share `overlap` rows; the last ends at the bottom.

    Slices are generated within the picture's row. Overlaps that leave no way forward are an error.
    """
    if overlap >= max_height:
        raise ValueError("the overlap must be less than the height of a slice")
    tall, over = _size(pictures, max_height, overlap)
    step = tall - over
    safe = F.when((step > 0) | (F.col("height") <= tall), step).otherwise(F.raise_error(F.lit("the overlap must be less than the height of a slice")).cast("int"))
    n = count(F.col("height"), tall, over)
    out = pictures.select(key, "height", tall.alias("__tall"), safe.alias("__step"), F.explode(F.sequence(F.lit(0), n - 1)).alias("slice_index"))
    start = F.col("slice_index") * F.col("__step")
    return out.select(key, "slice_index", start.alias("y_start"), F.least(start + F.col("__tall"), F.col("height")).alias("y_end"))


def count(height: Column, max_height: Column | int = MAX_HEIGHT, overlap: Column | int = OVERLAP) -> Column:
    tall, over = (x if isinstance(x, Column) else F.lit(x) for x in (max_height, overlap))
    return F.when(height <= tall, 1).otherwise(F.greatest(F.lit(1), F.ceil((height - over) / (tall - over)))).cast("int")


def fixed_cuts(pictures: DataFrame, max_height: int = MAX_HEIGHT, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """(key, cut): multiples of the stride below the bottom, and the bottom."""
    step = max_height - overlap
    if step <= 0:
        raise ValueError("the overlap must be less than the height of a slice")
    inner = F.filter(F.sequence(F.lit(max_height), F.greatest(F.col("height"), F.lit(max_height)), F.lit(step)), lambda c: c < F.col("height"))
    return pictures.select(key, F.explode(F.concat(inner, F.array(F.col("height")))).alias("cut"))


def blank_runs(pixel_rows: DataFrame, least: int = 5, key: str = "doc_id") -> DataFrame:
    """(key, start, stop): runs of at least `least` blank pixel rows (key, y, blank); y runs on without gaps."""
    from pyspark.sql import Window

    # blank rows of one run have the same difference between place and rank
    rank = F.row_number().over(Window.partitionBy(key).orderBy("y"))
    runs = pixel_rows.filter("blank").withColumn("__run", F.col("y") - rank).groupBy(key, "__run").agg(F.min("y").alias("start"), (F.max("y") + 1).alias("stop"))
    return runs.filter(F.col("stop") - F.col("start") >= least).select(key, "start", "stop")


def safe_cuts(runs: DataFrame, pictures: DataFrame, max_height: int = MAX_HEIGHT, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """(key, cut): towards each target the centre of the nearest blank run within 30 % of a slice's height, else the target itself.

    Each target depends on the cut before: a fold over a picture's runs.
    """
    if overlap >= max_height:
        raise ValueError("the overlap must be less than the height of a slice")

    def step(g: dict[str, list]) -> dict[str, list]:
        height, centers = g["height"][0], [(a + b) // 2 for a, b in zip(g["start"], g["stop"]) if a is not None]
        cuts, target = [], max_height
        while target < height:
            near = [c for c in centers if abs(c - target) <= max_height * 0.3]
            cut = min(near, key=lambda c: abs(c - target)) if near else target
            if cut + max_height - overlap <= target:
                cut = target  # a cut so early would never get past this target
            cuts.append(cut)
            target = cut + max_height - overlap
        found = sorted({*cuts, height})
        return {key: [g[key][0]] * len(found), "cut": found}

    both = pictures.select(key, "height").join(runs, key, "left")
    kind = dict(pictures.dtypes)[key]
    return fold(both, [key], ["start"], step, f"`{key}` {kind}, cut int")
