"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import list_values, materialize, table

K = 10
#: Scores are cosines rounded to this many steps per unit, so that equal vectors have equal scores in any order of summing.
STEPS = 1_000_000
#: Below every score: that of a row with itself.
NEVER = -2 * STEPS
#: Rows in a block; a task scores one block of queries against one block of the corpus.
BLOCK = 2048
#: Bins of a round's histograms. Refining ends when every query has at most K + SLACK rows from its kth bin up, or bins are one step wide.
BINS = 64
SLACK = 54

_BLOCKS = "block long, ids binary, rows binary"
_STATE = "q_block long, low binary, above binary, width int, open boolean"
#: Rows of a block that are compared at once, which bounds a task's memory.
SLICE = 256
#: Query blocks whose counts a task holds before it passes them on.
HELD = 64


def _blocks(vectors: DataFrame, block: int) -> DataFrame:
    """Rows (block, ids, rows): up to `block` vectors each, brought to length 1, as bytes. Zero vectors stay zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId() << 32, 0
        ids, rows = np.empty(0, np.int64), np.empty((0, 0))

        def pack(i: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            made += 1
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            x = np.ascontiguousarray(x / np.where(norm > 0, norm, 1.0)[:, None])
            return pa.RecordBatch.from_arrays([pa.array([part + made]), pa.array([i.tobytes()]), pa.array([x.tobytes()])], names=["block", "ids", "rows"])

        for batch in batches:
            if not batch.num_rows:
                continue
            values, _ = list_values(batch.column(1))
            x = values.astype(np.float64).reshape(batch.num_rows, -1)
            rows = np.concatenate([rows, x]) if len(rows) else x
            ids = np.concatenate([ids, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)])
            while len(ids) >= block:
                yield pack(ids[:block], rows[:block])
                ids, rows = ids[block:], rows[block:]
        if len(ids):
            yield pack(ids, rows)

    return vectors.mapInArrow(run, _BLOCKS)


def _pairs(asked: DataFrame, blocks: DataFrame, state: DataFrame) -> DataFrame:
    """Each block of queries with each block of the corpus."""
    q = asked.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows")).join(state, "q_block")
    c = blocks.select(F.col("ids").alias("c_ids"), F.col("rows").alias("c_rows"))
    return q.crossJoin(c)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(query block, query ids, corpus ids, scores in steps, low, above, width) of each pair of blocks; a row never meets itself."""
    for batch in batches:
        at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for r in range(batch.num_rows):
            get = lambda name, kind: np.frombuffer(at[name][r].as_buffer(), kind)  # noqa: B023, E731
            q, c = get("q_ids", np.int64), get("c_ids", np.int64)
            x, y = get("q_rows", np.float64).reshape(len(q), -1), get("c_rows", np.float64).reshape(len(c), -1)
            s = np.rint((x @ y.T) * STEPS).astype(np.int32)
            _, i, j = np.intersect1d(q, c, assume_unique=True, return_indices=True)
            s[i, j] = NEVER
            yield at["q_block"][r].as_py(), q, c, s, get("low", np.int32), get("above", np.int64), at["width"][r].as_py()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}

    def out() -> pa.RecordBatch:
        keys = list(held)
        cols = [[held[k][i] for k in keys] for i in range(4)]
        counts, low, above = ([x.tobytes() for x in col] for col in cols[:3])
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(counts, pa.binary()), pa.array(low, pa.binary()), pa.array(above, pa.binary()), pa.array(cols[3], pa.int32())],
            names=["q_block", "counts", "low", "above", "width"],
        )

    for key, q, _, s, low, above, width in _scored(batches):
        if key not in held:
            if len(held) >= HELD:
                yield out()
                held.clear()
            held[key] = [np.zeros((len(q), BINS), np.int64), low, above, width]
        counts = held[key][0]
        for lo in range(0, len(q), SLICE):
            d = s[lo : lo + SLICE] - low[lo : lo + SLICE, None]
            n = len(d)
            bins = np.where((d >= 0) & (d < BINS * width), d // width, BINS) + np.arange(n)[:, None] * (BINS + 1)
            counts[lo : lo + n] += np.bincount(bins.ravel(), minlength=n * (BINS + 1)).reshape(n, BINS + 1)[:, :BINS]
    if held:
        yield out()


def _refine(k: int):
    """Sums the counts of each query block, which come one after the other, and cuts the range of each query."""

    def cut(key: int, counts: np.ndarray, low: np.ndarray, above: np.ndarray, width: int) -> pa.RecordBatch:
        upward = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]  # scores in this bin or higher ones
        enough = upward + above[:, None] >= k
        b = np.where(enough.any(1), BINS - 1 - enough[:, ::-1].argmax(1), 0)
        row = np.arange(len(b))
        from_here = above + upward[row, b]
        low = (low + b * width).astype(np.int32)
        above = from_here - counts[row, b]
        more = bool(width > 1 and (from_here > k + SLACK).any())
        return pa.RecordBatch.from_arrays(
            [pa.array([key]), pa.array([low.tobytes()]), pa.array([above.tobytes()]), pa.array([-(-width // BINS)], pa.int32()), pa.array([more])], names=["q_block", "low", "above", "width", "open"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for key, counts, low, above, width in zip(*[c.to_pylist() for c in batch.columns]):
                counts = np.frombuffer(counts, np.int64).reshape(-1, BINS)
                if now and now[0] == key:
                    now[1] = now[1] + counts
                    continue
                if now:
                    yield cut(*now)
                now = [key, counts, np.frombuffer(low, np.int32), np.frombuffer(above, np.int64), width]
        if now:
            yield cut(*now)

    return run


def _collect(k: int):
    """Pairs from each query's lower limit up, of one pair of blocks no more than k a query: the others can't be among its k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, q, c, s, low, _, _ in _scored(batches):
            for lo in range(0, len(q), SLICE):
                part = s[lo : lo + SLICE]
                i, j = np.nonzero((part >= low[lo : lo + SLICE, None]) & (part > NEVER))
                v = part[i, j]
                order = np.lexsort((c[j], -v, i))
                i, j, v = i[order], j[order], v[order]
                first = np.searchsorted(i, np.arange(len(part)))
                kept = np.arange(len(i)) - first[i] < k
                yield pa.RecordBatch.from_arrays([pa.array(q[lo + i[kept]]), pa.array(c[j[kept]]), pa.array(v[kept])], names=["query_id", "neighbor_id", "score"])

    return run


def nearest(vectors: DataFrame, k: int = K, key: str = "vec_id", column: str = "embedding", block: int = BLOCK, queries: Column | None = None) -> DataFrame:
    """(query_id, rank, neighbor_id, score): for every row of vectors (those for which `queries` is true) the k others of the highest cosine.

    Exact: each round scores all queries against all rows, block by block, counts each query's scores in BINS bins and adds the counts over
    all blocks; the bin that holds the kth score is cut into BINS again. When few rows are left from that bin up, a
    last pass keeps just those, and they are ranked by score (highest first) and then id (lowest first).

    Scores are cosines rounded to 1 / STEPS. Rows with a null id or a null vector, or with a null or a
    number that is not finite in it, take no part; nor do vectors of another length than the commonest (the least of equally common ones). A zero vector has cosine 0 to all.
    Of several rows with one id the least vector in array order counts, and the id is a query if any of its rows is. With fewer than k others all are
    returned. An empty table, or one without queries, gives no rows.
    """
    empty = "query_id long, rank int, neighbor_id long, score double"
    chosen = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    vectors = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"), chosen.alias("asked"))
    good = vectors.filter(F.col("id").isNotNull() & (F.size("v") > 0)).filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], empty)
    one = materialize(good.filter(F.size("v") == lengths["n"]).groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked")), "topk-vectors")
    # a file per block: pairs of blocks then spread over many tasks
    blocks = materialize(_blocks(one.select("id", "v"), block), "topk-blocks")
    blocks = materialize(blocks.repartition(max(1, blocks.count()), "block"), "topk-blocks")
    asked = blocks
    if queries is not None:
        some = one.filter("asked").select("id", "v")
        asked = materialize(_blocks(some.repartition(max(1, -(-some.count() // block))), block), "topk-queries")
    state = materialize(_start(asked), "topk-state")
    while True:
        counts = _pairs(asked, blocks, state).mapInArrow(_count, "q_block long, counts binary, low binary, above binary, width int")
        cut = counts.repartition("q_block").sortWithinPartitions("q_block").mapInArrow(_refine(k), _STATE)
        state = materialize(cut, "topk-state")
        if state.filter("open").isEmpty():
            break
    found = _pairs(asked, blocks, state).mapInArrow(_collect(k), "query_id long, neighbor_id long, score int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "neighbor_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", (F.col("score") / STEPS).alias("score"))


def _start(blocks: DataFrame) -> DataFrame:
    """The whole range of scores for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(x.as_buffer()) // 8 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([np.full(m, -STEPS - 1, np.int32).tobytes() for m in n], pa.binary()), pa.array([np.zeros(m, np.int64).tobytes() for m in n], pa.binary()),
                 pa.array([-(-(2 * STEPS + 3) // BINS)] * len(n), pa.int32()), pa.array([True] * len(n))],
                names=["q_block", "low", "above", "width", "open"],
            )

    return blocks.select("block", "ids").mapInArrow(run, _STATE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 50, against all."""
    return nearest(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0)


SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS score
  FROM u a, u b WHERE a.vec_id <> b.vec_id AND a.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id) AS rank, neighbor_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, neighbor_id, score FROM r WHERE rank <= {K}"""
