"""What the corpus operators share: scratch tables, table access, word hashes, Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors then need numpy and pyarrow only, not this package.
cloudpickle.register_pickle_by_value(sys.modules["leafmill"])

#: Characters between words; the same in Java's regex, RE2 and Python.
SPACE = r"[ \t\n\r\f\x0B]"
NOT_SPACE = r"[^ \t\n\r\f\x0B]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only a single-machine session (local[*]) may go without; it gets a folder under /tmp.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if conf.get("spark.master", "").startswith("local["):
        return f"/tmp/leafmill-scratch-{spark.sparkContext.applicationId}"
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back: lineage is cut and a lost
    executor costs nothing that was done before."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    root = scratch_root(spark)
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if root.removeprefix("file://") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def count_tokens(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE + "+")), F.lit(0)).cast("long")


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits, in order; empty words are EMPTY_WORD."""
    return F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w))


#: xxhash64 of the empty string with Spark's seed 42; split() leaves one at either end.
EMPTY_WORD = -7444071767201028348


def unit_hash(*cols: Column) -> Column:
    """A number of 60 bits from md5 of the values, which other engines can compute as well. Null counts as ''."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def list_values(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and row offsets (n + 1) of a list column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values, (offsets - offsets[0]).astype(np.int64)


def words_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat word hashes and offsets of a word_hashes column, without empty words."""
    values, offsets = list_values(batch.column(name))
    kept = values != EMPTY_WORD
    running = np.concatenate([[0], np.cumsum(kept)])
    return values[kept].astype(np.int64), running[offsets]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, that hands freed memory back to the system at its end: Spark keeps the worker, and what the C library
    and Arrow hold in reserve there counts against the executor while others work."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
            if trim is not None:
                trim(0)

    return wrapped


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        yield batch, batch.column(batch.schema.get_field_index(column)).to_pylist()


#: Rows of a narrow table up to which it is broadcast; beyond it Spark chooses another join.
MAX_BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df, a materialized narrow table, marked for broadcast if it has no more rows than the limit."""
    return F.broadcast(df) if df.count() <= limit else df
