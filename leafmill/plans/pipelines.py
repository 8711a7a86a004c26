"""Whole ways from recognised boxes to formatted text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.geometry import shift
from leafmill.operators import cleaner, coordinates, layout, quality, tables


@dataclass(frozen=True)
class Options:
    """What the command line of such a tool would ask for."""

    framework: str = "livetext"
    level: str = "accurate"
    threshold: float = 0.0
    languages: tuple[str, ...] = ()
    output_format: str = "markdown"
    metadata: bool = True
    details: bool = False
    layout: bool = False
    clean: bool = True
    regions: str = "auto"
    detect_tables: bool = True
    binarize: bool = False
    max_retries: int = quality.RETRIES
    quality_threshold: float = quality.THRESHOLD

    def __post_init__(self) -> None:
        if self.regions not in ("auto", "on", "off"):
            raise ValueError("regions must be auto, on or off")
        if self.output_format not in ("markdown", "text", "json"):
            raise ValueError("output_format must be markdown, text or json")


def route(profiles: DataFrame, mode: str = "auto") -> DataFrame:
    """profiles with `branch`: regions, slices or whole. Long pictures never go to regions, whatever the mode."""
    wanted = {"on": F.lit(True), "off": F.lit(False)}.get(mode, F.col("recommended_region_detection"))
    regions = wanted & ~F.col("is_long_screenshot")
    return profiles.withColumn("branch", F.when(regions, "regions").when(F.col("needs_slicing"), "slices").otherwise("whole"))


def assemble(whole: DataFrame, sliced: DataFrame | None = None, slices: DataFrame | None = None, regional: DataFrame | None = None, regions: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, branch, box_no, text, confidence, x, y, w, h) of all three branches, origin at the top.

    whole: relative boxes, origin at the bottom. sliced and slices as for merge_results. regional: boxes in pixels of their region
    (key, region_index, ...), regions: their places on the page, in reading order by `place`.
    """
    cols = ["box_no", "text", "confidence", "x", "y", "w", "h"]
    out = whole.select(key, F.lit("whole").alias("branch"), *cols).withColumn("y", 1 - F.col("y") - F.col("h")).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    if sliced is not None and slices is not None:
        merged = coordinates.merge_results(sliced, slices, key=key).withColumn("box_no", F.col("place").cast("long"))
        out = out.unionByName(merged.select(key, F.lit("slices").alias("branch"), *cols))
    if regional is not None and regions is not None:
        at = regions.select(key, "region_index", "place", F.col("x").alias("rx"), F.col("y").alias("ry"))
        moved = regional.join(at, [key, "region_index"])
        x, y, w, h = shift((F.col("x"), F.col("y"), F.col("w"), F.col("h")), F.col("rx"), F.col("ry"))
        number = (F.col("place").cast("long") * 1_000_000 + F.col("box_no")).alias("box_no")
        out = out.unionByName(moved.select(key, F.lit("regions").alias("branch"), number, "text", "confidence", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))
    return out


def region_text(boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): each region's text under a line that numbers it, in reading order; a page of one region has its text alone."""
    per = boxes.groupBy(key, "place").agg(layout.joined(F.collect_list(F.struct("box_no", "text")), "\n").alias("text"))
    n = F.size("r")
    got = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("r"))
    headed = F.transform("r", lambda p, i: F.concat(F.lit("--- 区域 "), (i + 1).cast("string"), F.lit(" ---\n"), p["text"]))
    return got.select(key, F.when(n == 1, F.get("r", F.lit(0))["text"]).otherwise(F.array_join(headed, "\n\n")).alias("text"))


def smart(attempts: DataFrame, options: Options | None = None, key: str = "doc_id") -> DataFrame:
    """The best attempt (key, attempt, strategy, text, quality_score) of each document; attempts: (key, attempt, strategy, text, avg_confidence, n_boxes).

    In production run attempt k + 1 only for the documents of which no attempt so far reached the threshold.
    """
    o = options or Options()
    scored = quality.metrics(attempts.withColumn("__k", F.struct(key, "attempt")), key="__k").select("__k.*", "quality_score")
    best = quality.best_attempt(scored, o.quality_threshold, o.max_retries, key)
    return attempts.join(best, [key, "attempt"]).select(key, "attempt", "strategy", "text", "quality_score")


def unsatisfied(scored: DataFrame, threshold: float = quality.THRESHOLD, key: str = "doc_id") -> DataFrame:
    """Keys that need another attempt."""
    return scored.groupBy(key).agg(F.max("quality_score").alias("m")).filter(F.col("m") < threshold).select(key)


def layout_text(boxes: DataFrame, clean: bool = True, key: str = "doc_id") -> DataFrame:
    """(key, text): Markdown with headings and lists, cleaned."""
    out = layout.format_with_layout(boxes, key).withColumnRenamed("markdown", "text")
    return cleaner.clean_text(out) if clean else out


def detected_tables(boxes: DataFrame, key: str = "doc_id", top_origin: bool = True) -> DataFrame:
    """(key, markdown) of the pages that have a table."""
    return tables.to_markdown(tables.tables(boxes, key=key, top_origin=top_origin), key)


def batch(results: DataFrame, inputs: DataFrame) -> DataFrame:
    """inputs (input_idx, path) with their results (path, output, error), in the order given; what has no result has an error that says so."""
    out = inputs.join(results, "path", "left")
    missing = F.col("output").isNull() & F.col("error").isNull()
    return out.withColumn("error", F.when(missing, F.lit("no result")).otherwise(F.col("error"))).orderBy("input_idx")
