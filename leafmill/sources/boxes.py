"""Recognised boxes: their schema, validation, and the interface behind which a recogniser stands."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.geometry import flip_y

BOXES = "doc_id long, page_no int, box_no long, text string, confidence double, x double, y double, w double, h double"
LEVELS = ("fast", "accurate")
FRAMEWORKS = ("vision", "livetext")


def check_options(framework: str = "vision", level: str = "accurate", threshold: float = 0.0, unit: str = "token", languages: list[str] | None = None, supported: list[str] | None = None) -> None:
    """Options that no recogniser could honour are an error before any picture is read."""
    if framework not in FRAMEWORKS:
        raise ValueError(f"framework must be one of {FRAMEWORKS}")
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    if unit not in ("token", "line"):
        raise ValueError("unit must be token or line")
    if framework == "livetext" and (level != "accurate" or threshold != 0.0):
        raise ValueError("livetext has neither levels nor confidences")
    if languages and supported is not None and not set(languages) <= set(supported):
        raise ValueError(f"languages must be among {supported}")


def recognise(pictures: DataFrame, recogniser: Callable[[bytes], list[tuple]], threshold: float = 0.0, page: str = "page_no") -> DataFrame:
    """BOXES of pictures (doc_id, page_no, data). The recogniser gets a picture's bytes and gives (text, confidence, x, y, w, h) tuples.

    This engine reads no characters itself. A recogniser's failure is a row with a null box_no and the message in `error`; it never becomes text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, no, data in zip(*[c.to_pylist() for c in batch.columns]):
                try:
                    rows += [(doc, no, i, *b, None) for i, b in enumerate(recogniser(data))]
                except Exception as e:  # one picture's failure is a value, not the job's end
                    rows.append((doc, no, *[None] * 7, f"{type(e).__name__}: {e}"))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), *[pa.float64()] * 5, pa.string()]
                names = ["doc_id", "page_no", "box_no", "text", "confidence", "x", "y", "w", "h", "error"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    got = pictures.select(F.col("doc_id").cast("long"), F.col(page).cast("int"), "data").mapInArrow(run, BOXES + ", error string")
    return got.filter(F.col("error").isNotNull() | (F.coalesce("confidence", F.lit(1.0)) >= threshold))


def normalise(boxes: DataFrame, origin: str = "bottom") -> DataFrame:
    """boxes with their origin at the top and confidences that are never null."""
    if origin not in ("top", "bottom"):
        raise ValueError("origin must be top or bottom")
    out = boxes.withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    return out.withColumn("y", flip_y(F.col("y"), F.col("h"))) if origin == "bottom" else out


def text_only(boxes: DataFrame) -> DataFrame:
    return boxes.select("doc_id", "box_no", "text")


def page_text(boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): lines in the recogniser's order, joined by line ends."""
    from leafmill.operators.layout import joined

    return boxes.groupBy(key).agg(joined(F.collect_list(F.struct("box_no", "text")), "\n").alias("text"))


def explode_tokens(lines: DataFrame, unit: str = "token") -> DataFrame:
    """Lines with `children` (text, x, y, w, h) as boxes: the children, or with unit line the lines; confidence 1."""
    if unit == "line":
        return lines.drop("children").withColumn("confidence", F.lit(1.0))
    got = lines.select("doc_id", "line_no", F.posexplode("children").alias("i", "c"))
    order = F.struct("line_no", "i")
    out = got.select("doc_id", order.alias("o"), "c.*", F.lit(1.0).alias("confidence"))
    from pyspark.sql import Window

    return out.withColumn("box_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("o")) - 1).drop("o")
