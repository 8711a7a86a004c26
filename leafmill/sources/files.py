"""Listing and reading of input files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.paths import DOCUMENTS, IMAGES, extension

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, length) of the pictures and documents in a folder, in the order of paths; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.filter(extension(F.col("path")).isin(*IMAGES, *DOCUMENTS)).select("path", "length").orderBy("path")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(input_idx, path) from a text file of one input a line; blank lines don't count."""
    lines = spark.read.text(path).select(F.trim("value").alias("path"), F.monotonically_increasing_id().alias("o")).filter("path <> ''")
    from pyspark.sql import Window

    return lines.select((F.row_number().over(Window.orderBy("o")) - 1).alias("input_idx"), "path")


def read_images(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    """(path, height, width, nChannels, data); what can't be decoded is left out or an error at reading."""
    got = spark.read.format("image").option("dropInvalid", drop_invalid).load(path)
    return got.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")


def fetch(urls: DataFrame, get: Callable[[str], bytes], column: str = "url") -> DataFrame:
    """urls with `data`, or `error` where `get` failed. Workers call `get`; a timeout is its own affair."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema) + ", data binary, error string"
    at = urls.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, errors = [], []
            for url in batch.column(at).to_pylist():
                try:
                    data.append(get(url))
                    errors.append(None)
                except Exception as e:
                    data.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary()), pa.array(errors, pa.string())], names=[*batch.schema.names, "data", "error"])

    return urls.mapInArrow(run, ddl)


def pdf_pages(files: DataFrame, dpi: int = 150) -> DataFrame:
    """(path, page_no, data): pages as PNG pictures, from 1. Needs PyMuPDF on the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import fitz

        for batch in batches:
            for path, content in zip(*[c.to_pylist() for c in batch.columns]):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    for i, page in enumerate(doc, 1):
                        png = page.get_pixmap(matrix=fitz.Matrix(dpi / 72, dpi / 72)).tobytes("png")
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([i], pa.int32()), pa.array([png], pa.binary())], names=["path", "page_no", "data"])

    return files.select("path", "content").mapInArrow(run, "path string, page_no int, data binary")


def docx_content(data: bytes) -> tuple[str, list[tuple[int, bytes]]]:
    """Paragraphs of the body that aren't blank, then the rows of all its tables, with an empty line between; and the pictures, from 1."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = set(z.namelist())
        texts = [_text(p) for p in body.findall(f"{_W}p")]
        parts = [t for t in texts if t.strip()]
        for table in body.findall(f"{_W}tbl"):
            for row in table.findall(f"{_W}tr"):
                cells = ["\n".join(_text(p) for p in cell.findall(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")]
                if any(cells):
                    parts.append(" | ".join(cells))
        pictures = []
        if "word/_rels/document.xml.rels" in names:
            for rel in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")):
                place = rel.get("Target", "")
                if "image" in place and f"word/{place}" in names:
                    pictures.append(z.read(f"word/{place}"))
    return "\n\n".join(parts), list(enumerate(pictures, 1))


def _text(p: ElementTree.Element) -> str:
    out = []
    for x in p.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab":
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def read_docx(files: DataFrame) -> DataFrame:
    """(path, docx_text, pictures, error) of binaryFile rows; a broken file has its message in `error` instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("index", pa.int32()), ("data", pa.binary())]))
        for batch in batches:
            rows = []
            for path, content in zip(*[c.to_pylist() for c in batch.columns]):
                try:
                    text, pictures = docx_content(content)
                    rows.append((path, text, [{"index": i, "data": d} for i, d in pictures], None))
                except Exception as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), kind, pa.string()))], names=["path", "docx_text", "pictures", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, docx_text string, pictures array<struct<index: int, data: binary>>, error string")
