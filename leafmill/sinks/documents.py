"""Documents of pages as Markdown, plain text or JSON, and their files.

pages: (doc_id, source, page_no, text, docx_text, ts), a row each; an empty or null text is a page without any.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.layout import joined

EXTENSIONS = {"markdown": ".md", "text": ".txt", "json": ".json"}
NOTHING = "*(No text recognized)*"
BETWEEN = "\n\n---\n\n"


def _has(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _documents(pages: DataFrame, page: Column, key: str) -> DataFrame:
    return pages.groupBy(key).agg(
        F.first("source").alias("source"), F.max("docx_text").alias("docx_text"), F.first("ts").alias("ts"), F.count("page_no").alias("total_pages"),
        F.array_sort(F.collect_list(F.when(F.col("page_no").isNotNull(), F.struct("page_no", page.alias("text"))))).alias("pages"),
    )


def add_page(pages: DataFrame, more: DataFrame) -> DataFrame:
    return pages.unionByName(more)


def all_text(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): the document's own text and the pages that have any, with empty lines between."""
    docs = _documents(pages, F.col("text"), key)
    some = F.filter(F.transform("pages", lambda p: p["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    own = F.when(_has(F.col("docx_text")), F.array("docx_text")).otherwise(F.array().cast("array<string>"))
    return docs.select(key, F.array_join(F.concat(own, some), "\n\n").alias("text"))


def markdown(pages: DataFrame, metadata: bool = True, key: str = "doc_id") -> DataFrame:
    """(key, markdown). A single page without a document text has no header; others have "## Page n", or "## Image n" beside one."""
    docs = _documents(pages, F.col("text"), key)
    docx = _has(F.col("docx_text"))
    none = F.array().cast("array<string>")
    head = none
    if metadata:
        count = F.when(F.col("total_pages") > 0, F.array(F.concat(F.lit("**Pages**: "), F.col("total_pages").cast("string")))).otherwise(none)
        stamp = F.concat(F.lit("**Time**: "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        head = F.concat(F.array(F.concat(F.lit("**Source**: "), F.col("source"))), count, F.array(stamp, F.lit(""), F.lit("---"), F.lit("")))
    own = F.when(docx, F.array(F.lit("## Document Text"), F.lit(""), F.col("docx_text"), F.lit(""))).otherwise(none)
    text = lambda p: p["text"]
    name = F.when(docx, "## Image ").otherwise("## Page ")
    page = lambda p: F.array(F.concat(name, p["page_no"].cast("string")), F.lit(""), F.when(_has(text(p)), text(p)).otherwise(F.lit(NOTHING)), F.lit(""))
    only = F.get("pages", F.lit(0))
    single = F.when(_has(only["text"]), F.array(only["text"])).otherwise(none)
    body = F.when((F.col("total_pages") == 1) & ~docx, single).otherwise(F.flatten(F.transform("pages", page)))
    return docs.select(key, F.array_join(F.concat(head, own, body), "\n").alias("markdown"))


def as_json(pages: DataFrame, details: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, json). details: boxes (key, page_no, box_no, text, confidence, x, y, w, h), which then go with their pages."""
    page: list[Column] = [F.col("page_no").alias("page_num"), F.coalesce("text", F.lit("")).alias("text")]
    if details is not None:
        b = F.struct("box_no", F.struct("text", "confidence", F.array("x", "y", "w", "h").alias("bbox")).alias("d"))
        per = details.groupBy(key, "page_no").agg(F.transform(F.array_sort(F.collect_list(b)), lambda r: r["d"]).alias("details"))
        pages = pages.join(per, [key, "page_no"], "left")
        page.append(F.col("details"))
    docs = pages.groupBy(key).agg(
        F.first("source").alias("source"), F.date_format(F.first("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.count("page_no").alias("total_pages"),
        F.nullif(F.max("docx_text"), F.lit("")).alias("docx_text"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("page_no").isNotNull(), F.struct("page_no", F.struct(*page).alias("p"))))), lambda r: r["p"]).alias("pages"),
    )
    return docs.select(key, F.to_json(F.struct("source", "timestamp", "total_pages", "docx_text", "pages")).alias("json"))


def format_pages(pages: DataFrame, kind: str = "markdown", metadata: bool = True, details: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, output) in the format named."""
    if kind == "markdown":
        return markdown(pages, metadata, key).withColumnRenamed("markdown", "output")
    if kind == "text":
        return all_text(pages, key).withColumnRenamed("text", "output")
    if kind == "json":
        return as_json(pages, details, key).withColumnRenamed("json", "output")
    raise ValueError(f"unknown format: {kind}")


def stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(name.rlike(r"^[^.].*\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def output_paths(outputs: DataFrame, kind: str, stamp: str | None = None, folder: str | None = None, label: str = "leafmill", key: str = "doc_id") -> DataFrame:
    """(key, source, output, out_path): in the folder by stem, or beside the source with a time stamp.

    Results of equal stems would overwrite each other: from the second on, in the order of key, they get a number.
    """
    end = F.lit(EXTENSIONS[kind])
    web = F.col("source").contains("://")
    name = F.when(web, F.coalesce(F.nullif(F.regexp_extract("source", r"([^/?]*)(\?.*)?$", 1), F.lit("")), F.lit("url_result"))).otherwise(stem(F.col("source")))
    base = F.concat(F.lit(f"{folder}/"), stem(F.col("source"))) if folder else F.concat(F.when(web, F.lit("")).otherwise(F.regexp_extract("source", r"^(.*/)?[^/]*$", 1)), name, F.lit(f"_{label}_{stamp}"))
    nth = F.row_number().over(Window.partitionBy("__base").orderBy(key))
    out = outputs.withColumn("__base", base).withColumn("__nth", nth)
    return out.withColumn("out_path", F.concat("__base", F.when(F.col("__nth") > 1, F.concat(F.lit("-"), F.col("__nth").cast("string"))).otherwise(F.lit("")), end)).drop("__base", "__nth")


def combined(outputs: DataFrame, order: str = "input_idx") -> DataFrame:
    """One row: all outputs, in input order, with rules between. For a few results that one reader wants as one text."""
    return outputs.agg(joined(F.collect_list(F.struct(order, F.col("output").alias("text"))), BETWEEN).alias("output"))


def labelled(outputs: DataFrame, total: int, order: str = "input_idx") -> DataFrame:
    """outputs with `shown`: "--- [i/N] source ---" and the output, or the error."""
    i = F.col(order) + 1
    head = F.concat(F.lit("--- ["), i.cast("string"), F.lit(f"/{total}] "), F.col("source"), F.lit(" ---\n"))
    return outputs.withColumn("shown", F.concat(head, F.coalesce("output", F.concat(F.lit("[ERROR] "), F.col("error")))))


def write_files(placed: DataFrame) -> DataFrame:
    """Write each output to its out_path on storage that all workers mount; (out_path, bytes). Written aside and renamed: a task that runs again does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for path, text in zip(*[c.to_pylist() for c in batch.columns]):
                data = (text or "").encode()
                os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                aside = f"{path}.{os.getpid()}.part"
                with open(aside, "wb") as f:
                    f.write(data)
                os.replace(aside, path)
                done.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.int64())], names=["out_path", "bytes"])

    return placed.select("out_path", "output").mapInArrow(run, "out_path string, bytes long")
