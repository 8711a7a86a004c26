"""Synthetic box relations as pure functions of the test tables' keys, each in Spark and as SQL.

Geometry is in whole units of a page of 10,000, so that both engines compute the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Slices of SLICE units every STRIDE; they overlap by more than the tallest line.
SLICE, STRIDE = 5000, 4200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(keys: DataFrame) -> DataFrame:
    """A narrow table's rows over all cores, before each is made into a picture: its file is a few tasks' only."""
    spark = keys.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return keys.repartition(n, *keys.columns)


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, box_no, text, conf, x, y, w, h), a box for each line of each document, origin at the top."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("box_no", "text")).withColumn("box_no", F.col("box_no").cast("long"))
    d, n = F.col("doc_id"), F.col("box_no")
    tall = F.when((n == 0) & (d % 3 == 0), 600).when((d + n) % 11 == 0, 480).when((d + n) % 7 == 0, 420).otherwise(300)
    gap = F.when(n == 0, 200).when((d * 7 + n) % 5 == 0, 700).otherwise(100)
    lines = lines.withColumns({"h": tall.cast("long"), "gap": gap.cast("long"), "x": (F.lit(500) + 300 * ((d + n) % 2)).cast("long"), "w": F.least(F.lit(9000), 50 * F.length("text")).cast("long"), "conf": (50 + (d * 31 + n * 17) % 51).cast("long")})
    down = Window.partitionBy("doc_id").orderBy("box_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("y", F.sum(F.col("gap") + F.col("h")).over(down) - F.col("h")).select("doc_id", "box_no", "text", "conf", "x", "y", "w", "h")


OCR_LINES = """
ocr0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS box_no FROM documents),
ocr1 AS (
  SELECT *, (CASE WHEN box_no = 0 AND doc_id % 3 = 0 THEN 600 WHEN (doc_id + box_no) % 11 = 0 THEN 480 WHEN (doc_id + box_no) % 7 = 0 THEN 420 ELSE 300 END)::BIGINT AS h,
         (CASE WHEN box_no = 0 THEN 200 WHEN (doc_id * 7 + box_no) % 5 = 0 THEN 700 ELSE 100 END)::BIGINT AS gap,
         (500 + 300 * ((doc_id + box_no) % 2))::BIGINT AS x, least(9000, 50 * length(text))::BIGINT AS w, (50 + (doc_id * 31 + box_no * 17) % 51)::BIGINT AS conf
  FROM ocr0),
ocr_lines AS (SELECT doc_id, box_no, text, conf, x, (sum(gap + h) OVER (PARTITION BY doc_id ORDER BY box_no ROWS UNBOUNDED PRECEDING) - h)::BIGINT AS y, w, h FROM ocr1)"""


def table_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, box_no, text, x, y, w, h): a table of four columns for each order, origin at the top. Every 13th box is in the neighbouring column, which leaves a gap and two boxes in one cell."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = li.select(
        F.col("l_orderkey").cast("long").alias("doc_id"), (F.row_number().over(order) - 1).cast("long").alias("r"), F.col("l_partkey").cast("long").alias("p"), F.col("l_suppkey").cast("long").alias("s"),
        F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("int").cast("string"), "l_returnflag").alias("t"),
    )
    cells = rows.select("doc_id", "r", "p", "s", F.posexplode("t").alias("c", "text"))
    at = F.when((F.col("p") + 3 * F.col("c")) % 13 != 0, F.col("c")).when(F.col("c") == 0, 1).otherwise(F.col("c") - 1)
    return cells.select(
        "doc_id", (F.col("r") * 4 + F.col("c")).alias("box_no"), "text", (1000 + 2000 * at + ((F.col("p") + F.col("c")) % 5) * 20).cast("long").alias("x"),
        (500 + 600 * F.col("r") + ((F.col("s") + F.col("c")) % 4) * 15).cast("long").alias("y"), F.lit(800).cast("long").alias("w"), F.lit(300).cast("long").alias("h"),
    )


TABLE_BOXES = """
tb0 AS (
  SELECT l_orderkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS r,
         l_partkey::BIGINT AS p, l_suppkey::BIGINT AS s, l_quantity::INTEGER::VARCHAR AS q, l_returnflag AS f FROM lineitem),
tb1 AS (SELECT *, unnest([p::VARCHAR, s::VARCHAR, q, f]) AS text, unnest([0, 1, 2, 3])::BIGINT AS c FROM tb0),
tb2 AS (SELECT *, CASE WHEN (p + 3 * c) % 13 <> 0 THEN c WHEN c = 0 THEN 1 ELSE c - 1 END AS slot FROM tb1),
table_boxes AS (
  SELECT doc_id, r * 4 + c AS box_no, text, (1000 + 2000 * slot + ((p + c) % 5) * 20)::BIGINT AS x, (500 + 600 * r + ((s + c) % 4) * 15)::BIGINT AS y, 800::BIGINT AS w, 300::BIGINT AS h, r, c
  FROM tb2)"""


def slices(lines: DataFrame) -> DataFrame:
    """(doc_id, slice_index, y_start, y_end, page_height) of pages as long as their last line."""
    pages = lines.groupBy("doc_id").agg(F.max(F.col("y") + F.col("h")).alias("page_height"))
    n = F.when(F.col("page_height") <= SLICE, 1).otherwise(F.ceil((F.col("page_height") - (SLICE - STRIDE)) / STRIDE))
    out = pages.select("doc_id", "page_height", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("slice_index"))
    start = F.col("slice_index").cast("long") * STRIDE
    return out.select("doc_id", "slice_index", start.alias("y_start"), F.least(start + SLICE, F.col("page_height")).alias("y_end"), "page_height")


def slice_boxes(lines: DataFrame, cut: DataFrame) -> DataFrame:
    """What a recogniser would read in each slice: the lines that it has whole, relative to the slice, origin at the bottom; confidences differ by slice."""
    both = lines.join(cut, "doc_id").filter((F.col("y") >= F.col("y_start")) & (F.col("y") + F.col("h") <= F.col("y_end")))
    tall = F.col("y_end") - F.col("y_start")
    return both.select(
        "doc_id", "slice_index", "box_no", "text", ((F.col("conf") + 7 * F.col("slice_index")) % 101).cast("double").alias("confidence"), F.col("x").cast("double").alias("x"),
        ((tall - (F.col("y") - F.col("y_start")) - F.col("h")) / tall).alias("y"), F.col("w").cast("double").alias("w"), (F.col("h") / tall).alias("h"),
        F.col("page_height").alias("ph"),
    )


SLICES = f"""
pg AS (SELECT doc_id, max(y + h) AS page_height FROM ocr_lines GROUP BY doc_id),
sl0 AS (SELECT doc_id, page_height, unnest(range(CASE WHEN page_height <= {SLICE} THEN 1 ELSE ceil((page_height - {SLICE - STRIDE}) / {STRIDE}.0)::BIGINT END)) AS slice_index FROM pg),
slices AS (SELECT doc_id, slice_index, slice_index * {STRIDE} AS y_start, least(slice_index * {STRIDE} + {SLICE}, page_height) AS y_end, page_height FROM sl0),
slice_boxes AS (
  SELECT l.doc_id, s.slice_index, box_no, text, (conf + 7 * s.slice_index) % 101 AS conf, x, y, w, h, page_height
  FROM ocr_lines l JOIN slices s ON l.doc_id = s.doc_id AND y >= y_start AND y + h <= y_end)"""


def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): documents whose lines have got bracketed titles, numbers, Chinese full stops and blank lines by their place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def mark(x, i):
        return (
            F.when((i + F.col("doc_id")) % 5 == 0, F.concat(F.lit("【"), x, F.lit("】"))).when((i + F.col("doc_id")) % 7 == 0, F.concat((i + 1).cast("string"), F.lit(".x"), x))
            .when((i + F.col("doc_id")) % 3 == 0, F.concat(x, F.lit("。"))).when((i + F.col("doc_id")) % 11 < 2, F.lit("")).otherwise(x)
        )

    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), mark), "\n").alias("text"))


MARKED = """
mk0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
marked AS (
  SELECT doc_id, i, CASE WHEN (i + doc_id) % 5 = 0 THEN '【' || x || '】' WHEN (i + doc_id) % 7 = 0 THEN (i + 1)::VARCHAR || '.x' || x
    WHEN (i + doc_id) % 3 = 0 THEN x || '。' WHEN (i + doc_id) % 11 < 2 THEN '' ELSE x END AS line FROM mk0)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, region_index, x, y, w, h, confidence, region_type): 25 pixel boxes to a picture of 1000 x 1000."""
    p = F.col("p_partkey").cast("long")
    return table(spark, sf_dir, "part").select(
        F.floor(p / 25).alias("doc_id"), (p % 25).cast("int").alias("region_index"), (p * 37 % 700).alias("x"), (p * 53 % 650).alias("y"),
        (60 + p * 29 % 400).alias("w"), (40 + p * 31 % 300).alias("h"), F.lit(1.0).alias("confidence"), F.lit("contour").alias("region_type"),
    )


REGIONS = """
regions AS (
  SELECT (p_partkey // 25)::BIGINT AS doc_id, (p_partkey % 25)::INTEGER AS region_index, (p_partkey * 37 % 700)::BIGINT AS x, (p_partkey * 53 % 650)::BIGINT AS y,
         (60 + p_partkey * 29 % 400)::BIGINT AS w, (40 + p_partkey * 31 % 300)::BIGINT AS h FROM part)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of pictures that no one took, a row per part."""
    p = F.col("p_partkey").cast("long")
    return table(spark, sf_dir, "part").select(
        p.alias("doc_id"), (200 + p * 13 % 2400).cast("int").alias("width"), (200 + p * 97 % 14_000).cast("int").alias("height"), (p % 100 / 100).alias("contrast"),
        (p * 7 % 100 / 100).alias("noise"), (p * 11 % 100 / 100).alias("edge_sharpness"),
        F.when(p % 4 == 0, "table").when(p % 4 == 1, "mixed").otherwise("document").alias("content_type"), (p % 3 == 0).alias("has_code_blocks"), (p % 5 < 2).alias("multiple_regions"),
    )


PROFILES = """
profiles AS (
  SELECT p_partkey::BIGINT AS doc_id, (200 + p_partkey * 13 % 2400)::INTEGER AS width, (200 + p_partkey * 97 % 14000)::INTEGER AS height, (p_partkey % 100) / 100.0::DOUBLE AS contrast,
         (p_partkey * 7 % 100) / 100.0::DOUBLE AS noise, (p_partkey * 11 % 100) / 100.0::DOUBLE AS sharp,
         CASE p_partkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'mixed' ELSE 'document' END AS content_type, p_partkey % 3 = 0 AS code, p_partkey % 5 < 2 AS multi FROM part)"""


def banded_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray pictures of 2 to 61 bands of 100 rows, each of its own gray, a picture per part."""
    n = (2 + F.col("p_partkey") % 60).cast("int")
    band = lambda i: F.repeat(F.lpad(F.hex(i + 1), 2, "0"), F.lit(100 * 8))
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), band), ""))
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select(F.col("p_partkey").cast("long").alias("doc_id"), (n * 100).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"))


def read_bands(a) -> list[tuple]:
    """A stand-in for a recogniser: reads each band that it sees whole as the number of its gray."""
    import numpy as np

    column = a[:, 0].astype(int)
    starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
    ends = np.append(starts[1:], len(column))
    return [(f"b{column[s] - 1}", 1.0, 0.0, 1 - e / len(column), 1.0, (e - s) / len(column)) for s, e in zip(starts.tolist(), ends.tolist()) if e - s == 100]
