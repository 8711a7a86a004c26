"""Paragraphs, headings and lists from boxes with their origin at the top (y grows downwards)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import heading_by_text, list_kind, strip

#: Average height of a page without boxes, and the usual distance between paragraphs in average heights.
NO_HEIGHT = 0.05
SPACING = 1.5
MARKDOWN_SPACING = 1.8


def joined(pieces: Column, between: str) -> Column:
    """Texts of an array of (order, text) structs in that order."""
    return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["text"]), between)


def average_height(boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    return boxes.groupBy(key).agg(F.coalesce(F.avg("h"), F.lit(NO_HEIGHT)).alias("avg_h"))


def paragraph_numbers(boxes: DataFrame, spacing: float = SPACING, key: str = "doc_id") -> DataFrame:
    """boxes with avg_h, line_pos (from 0, downwards) and para_no (from 0).

    A paragraph ends where the gap to the line just above exceeds `spacing` average heights. All three windows
    share one exchange by key and one sort.
    """
    down = Window.partitionBy(key).orderBy("y", "box_no")
    gap = F.col("y") - F.lag(F.col("y") + F.col("h")).over(down)
    return (
        boxes.withColumn("avg_h", F.avg("h").over(Window.partitionBy(key)))
        .withColumn("line_pos", F.row_number().over(down) - 1)
        .withColumn("__new", F.coalesce((gap > F.col("avg_h") * spacing).cast("int"), F.lit(0)))
        .withColumn("para_no", F.sum("__new").over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        .drop("__new")
    )


def paragraphs(boxes: DataFrame, spacing: float = SPACING, key: str = "doc_id") -> DataFrame:
    """(key, para_no, n_lines, text, x, y, w, h, avg_h): lines joined by line ends, the box being the first line's.

    The grouping keeps the windows' partitioning: no second exchange.
    """
    numbered = paragraph_numbers(boxes, spacing, key)
    piece = F.struct("line_pos", "text")
    first = F.min(F.struct("line_pos", "x", "y", "w", "h"))
    out = numbered.groupBy(key, "para_no").agg(
        F.count("*").cast("int").alias("n_lines"), joined(F.collect_list(piece), "\n").alias("text"), first.alias("f"), F.first("avg_h").alias("avg_h")
    )
    return out.select(key, "para_no", "n_lines", "text", "f.x", "f.y", "f.w", "f.h", "avg_h")


def mark_headings(paras: DataFrame, size: float = 1.3, longest: int = 100) -> DataFrame:
    """With is_heading and heading_level (0 for none).

    The first line's text decides first (brackets or a numeral in front), then its height against the average;
    a short single line needs to be a tenth taller only.
    """
    first = strip(F.substring_index("text", "\n", 1))
    by_height = F.when(F.col("h") > F.col("avg_h") * size, F.when(F.col("h") >= F.col("avg_h") * 2.0, 1).when(F.col("h") >= F.col("avg_h") * 1.6, 2).otherwise(3))
    short = F.when((F.col("n_lines") == 1) & (F.length(first) < longest) & (F.col("h") > F.col("avg_h") * 1.1), 3)
    level = F.coalesce(heading_by_text(first), by_height, short, F.lit(0))
    return paras.withColumn("heading_level", level).withColumn("is_heading", F.col("heading_level") > 0)


def mark_lists(paras: DataFrame) -> DataFrame:
    """With is_list and list_type (unordered, ordered or null), by the paragraph's first line."""
    kind = list_kind(strip(F.substring_index("text", "\n", 1)))
    return paras.withColumn("list_type", kind).withColumn("is_list", F.col("list_type").isNotNull())


def analyze(boxes: DataFrame, spacing: float = SPACING, size: float = 1.3, key: str = "doc_id") -> DataFrame:
    return mark_lists(mark_headings(paragraphs(boxes, spacing, key), size))


def summary(analyzed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, avg_height, total_paragraphs, headings, lists)."""
    return analyzed.groupBy(key).agg(
        F.first("avg_h").alias("avg_height"), F.count("*").alias("total_paragraphs"), F.count_if("is_heading").alias("headings"), F.count_if("is_list").alias("lists")
    )


def to_markdown(analyzed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, markdown): a blank line after each paragraph; a heading's signs win over a list's."""
    line = F.when(F.col("is_heading"), F.concat(F.repeat(F.lit("#"), F.col("heading_level")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    piece = F.struct("para_no", line.alias("text"))
    return analyzed.groupBy(key).agg(F.concat(joined(F.collect_list(piece), "\n\n"), F.lit("\n")).alias("markdown"))


def format_with_layout(boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Markdown of whole pages, with the wider spacing that this use has; clean it with cleaner.clean_text if wanted."""
    return to_markdown(analyze(boxes, MARKDOWN_SPACING, key=key), key)
