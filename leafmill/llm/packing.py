"""Harmonic packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import count_tokens, table, unit_hash

CAPACITY = 2048
#: Size classes: class j < CLASSES has lengths in (C/(j+1), C/j], the last class all that is shorter.
CLASSES = 16
#: Documents per worker that packs by itself; each leaves one bin per class partly filled.
PER_WORKER = 50_000
SEED = "pack-1"


def pack(docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, per_worker: int = PER_WORKER, workers: int | None = None) -> DataFrame:
    """(worker, size_class, bin, slot, doc_id, piece, first_token, n_tokens), a row per piece of a document.

    A text's tokens are its words. A text of more than `capacity` tokens is cut into full pieces and a
    rest, so that every token is in one bin. A hash of doc_id spreads the documents over workers; each
    worker numbers the pieces of a class in the order of doc_id and puts j of them into each bin
    of class j. The last class takes as many as fit whatever their length, `classes`. Bins never exceed the capacity.

    Rows without words (null or empty text) take no room and give no row. Null doc_ids are packed like
    others, by one worker. Rows with the same doc_id are packed each for itself; ties are ordered by
    piece and length. An empty table gives no rows.
    """
    if not 1 <= classes <= capacity:
        raise ValueError("classes must be between 1 and capacity")
    sized = docs.select("doc_id", count_tokens(F.col("text")).alias("len"))
    if workers is None:
        workers = max(1, math.ceil(docs.count() / per_worker))
    spread = unit_hash(F.lit(SEED), F.col("doc_id")) % workers
    cuts = F.ceil(F.col("len") / F.lit(capacity)).cast("int")
    pieces = (
        sized.filter("len > 0")
        .select("doc_id", "len", spread.cast("int").alias("worker"), F.explode(F.sequence(F.lit(0), cuts - 1)).alias("piece"))
        .withColumn("first_token", F.col("piece").cast("long") * capacity)
        .withColumn("n_tokens", F.least(F.lit(capacity).cast("long"), F.col("len") - F.col("first_token")))
        .withColumn("size_class", F.least(F.lit(classes), F.floor(F.lit(capacity) / F.col("n_tokens"))).cast("int"))
    )
    order = Window.partitionBy("worker", "size_class").orderBy(F.col("doc_id").asc_nulls_first(), "piece", "n_tokens")
    at = F.row_number().over(order) - 1
    return pieces.withColumn("at", at).select(
        "worker", "size_class", F.floor(F.col("at") / F.col("size_class")).cast("long").alias("bin"),
        (F.col("at") % F.col("size_class")).cast("int").alias("slot"), "doc_id", "piece", "first_token", "n_tokens",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def select_sql(docs: str, capacity: int = CAPACITY, classes: int = CLASSES, per_worker: int = PER_WORKER) -> str:
    return f"""
WITH sized AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+'))::BIGINT AS len,
         ('0x' || substr(md5('{SEED}|' || coalesce(cast(doc_id AS VARCHAR), '')), 1, 15))::BIGINT
           % greatest(1, ceil((SELECT count(*) FROM {docs}) / {per_worker}.0)::BIGINT) AS worker
  FROM {docs}),
pieces AS (
  SELECT doc_id, worker::INTEGER AS worker, piece::INTEGER AS piece, piece * {capacity} AS first_token, least({capacity}, len - piece * {capacity}) AS n_tokens
  FROM (SELECT *, unnest(range((len + {capacity} - 1) // {capacity})) AS piece FROM sized)),
classed AS (SELECT *, least({classes}, {capacity} // n_tokens)::INTEGER AS size_class FROM pieces),
placed AS (SELECT *, row_number() OVER (PARTITION BY worker, size_class ORDER BY doc_id NULLS FIRST, piece, n_tokens) - 1 AS pos FROM classed)
SELECT worker, size_class, pos // size_class AS bin, (pos % size_class)::INTEGER AS slot, doc_id, piece, first_token, n_tokens FROM placed"""


SQL = select_sql("documents")
