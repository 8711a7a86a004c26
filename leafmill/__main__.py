"""python -m leafmill (or spark-submit) INPUT... --recogniser package.module:function -o FOLDER: documents of pictures, PDFs, DOCX files, URLs and folders.

The recogniser turns a pixel array into (text, confidence, x, y, w, h) tuples; --decoder does the same for a picture's bytes and a pixel array.
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime
from importlib import import_module

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.paths import DOCUMENTS, IMAGES
from leafmill.plans.pipelines import Options
from leafmill.plans.recognition import process_inputs
from leafmill.sinks.documents import labelled, output_paths, write_files
from leafmill.sources.boxes import check_options
from leafmill.sources.files import list_files, read_list


def arguments(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="leafmill", description=__doc__)
    p.add_argument("inputs", nargs="*", help="pictures, PDF or DOCX files, URLs, folders")
    p.add_argument("--batch", help="a text file of one input a line")
    p.add_argument("--recogniser", required=True)
    p.add_argument("--decoder", required=True)
    p.add_argument("--fetcher", help="package.module:function from a URL to bytes")
    p.add_argument("-o", "--output", help="folder for the results; without it they go to standard output")
    p.add_argument("-f", "--format", choices=("markdown", "text", "json"), default="markdown")
    p.add_argument("-l", "--language", action="append", default=[])
    p.add_argument("--framework", choices=("vision", "livetext"), default="livetext")
    p.add_argument("--level", choices=("fast", "accurate"), default="accurate")
    p.add_argument("--threshold", type=float, default=0.0)
    p.add_argument("--way", choices=("smart", "adaptive", "basic"), default="smart")
    p.add_argument("--regions", choices=("auto", "on", "off"), default="auto")
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--no-metadata", action="store_true")
    p.add_argument("--details", action="store_true")
    p.add_argument("--no-clean", action="store_true")
    p.add_argument("--no-tables", action="store_true")
    p.add_argument("--binarize", action="store_true")
    p.add_argument("--max-retries", type=int, default=2)
    p.add_argument("--quality-threshold", type=float, default=0.6)
    return p.parse_args(args)


def named(name: str | None):
    if name is None:
        return None
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def listed(spark: SparkSession, a: argparse.Namespace):
    """(input_idx, path), folders replaced by the files in them, in the order given."""
    plain = lambda p: p.lower().startswith(("http:", "https:")) or p.lower().rpartition(".")[2] in (*IMAGES, *DOCUMENTS)
    parts = []
    for i, path in enumerate(a.inputs):
        one = spark.createDataFrame([(path,)], "path string") if plain(path) else list_files(spark, path, a.recursive).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
        parts.append(one.withColumn("i", F.lit(i)))
    if a.batch:
        parts.append(read_list(spark, a.batch).select("path", (F.col("input_idx") + len(a.inputs)).alias("i")))
    if not parts:
        raise SystemExit("no inputs")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.select((F.row_number().over(Window.orderBy("i", "path")) - 1).cast("long").alias("input_idx"), "path")


def run(spark: SparkSession, args: list[str]) -> int:
    """The number of inputs that failed."""
    a = arguments(args)
    check_options(a.framework, a.level, a.threshold, languages=a.language)
    options = Options(
        framework=a.framework, level=a.level, threshold=a.threshold, languages=tuple(a.language), output_format=a.format, metadata=not a.no_metadata, details=a.details, clean=not a.no_clean,
        regions=a.regions, detect_tables=not a.no_tables, binarize=a.binarize, max_retries=a.max_retries, quality_threshold=a.quality_threshold,
    )
    now = datetime.now()
    inputs = listed(spark, a)
    done = process_inputs(spark, inputs, named(a.recogniser), named(a.decoder), named(a.fetcher), options=options, way=a.way, stamp=f"{now:%Y-%m-%d %H:%M:%S}").withColumnRenamed("path", "source").persist()
    failed = done.filter("error is not null").count()
    if a.output:
        placed = output_paths(done.filter("output is not null"), a.format, folder=a.output, key="input_idx")
        print(f"{write_files(placed).count()} written, {failed} failed")
        for r in done.filter("error is not null").orderBy("input_idx").toLocalIterator():
            print(f"{r.source}: {r.error}", file=sys.stderr)
    else:
        total = inputs.count()
        shown = labelled(done, total) if total > 1 else done.withColumn("shown", F.coalesce("output", F.concat(F.lit("[ERROR] "), F.col("error"))))
        for r in shown.orderBy("input_idx").toLocalIterator():
            print(r.shown)
    return failed


if __name__ == "__main__":
    sys.exit(min(1, run(SparkSession.builder.getOrCreate(), sys.argv[1:])))
