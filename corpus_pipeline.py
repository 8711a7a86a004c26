"""From raw documents to packed training sequences: five stages, each over all that the one before has kept.

run(spark, sf_dir) is the query `pipeline`. Between stages the rows are written as Parquet to the
shared scratch folder and read again.

All stages take nulls in any column, repeated rows, texts of any length, more columns (kept by all but the last) and empty tables, which give
empty results. Rows without doc_id go through as others do; no stage but the first drops a row for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import fertility, jaccard_join, line_dedup, mixing, packing
from leafmill.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility bands of their language reject go; so do null and empty texts. Rows of equal doc_id, language and text stay or go together."""
    return fertility.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line windows are cut out; a document of which no line is left goes. Of documents with null doc_id the passages count as the first."""
    return line_dedup.dedup_lines(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the rows with the least doc_id stay; so do texts without a word and rows without doc_id."""
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture of the target shares stay; null is a source of its own, texts without a word have 0 tokens."""
    return mixing.keep_mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences; texts without a word have none."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: The first stage runs tokenisers, which SQL doesn't have.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
