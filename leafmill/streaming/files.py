"""Boxes that arrive as Parquet files: whole pages of one file at a time become text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from leafmill.operators import layout
from leafmill.sources.boxes import BOXES


def arriving_boxes(spark: SparkSession, folder: str, schema: str = BOXES, files_per_batch: int = 1000) -> DataFrame:
    """Boxes of the files that come into a folder. A page's boxes must be in one file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_pages(boxes: DataFrame, out: str, checkpoint: str, page: Callable[[DataFrame], DataFrame] = layout.format_with_layout) -> StreamingQuery:
    """Run `page` over all files that are there and stop; each micro-batch's result goes to a folder of its number, so that one that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        page(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return boxes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
