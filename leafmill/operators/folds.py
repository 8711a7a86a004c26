"""Order-dependent folds over groups: one exchange and sort, then plain Python over Arrow columns."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame

# Executors then need not have this package.
cloudpickle.register_pickle_by_value(sys.modules["leafmill"])

#: Output rows that are held before they are passed on.
HELD = 20_000


def hand_back() -> None:
    """Freed memory goes back to the system: Spark keeps the worker, and what Arrow and the C library hold in reserve there counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


Fold = Callable[[dict[str, list]], dict[str, list]]


def fold(df: DataFrame, keys: list[str], order: list[str | Column], step: Fold, schema: str) -> DataFrame:
    """step(columns of one group, in the order given) -> columns of its output, or nothing; schema names them.

    Groups are the rows of equal keys. Unlike applyInPandas a group costs no data frame of its own, and rows of
    many small groups travel in full Arrow batches. A group's rows are held in memory, as a page's are.
    """
    sorted_ = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = df.columns
    empty = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {n: [] for n in out_schema.names}
        now, group = None, {n: [] for n in names}

        def close() -> None:
            for n, values in step(group).items():
                out[n].extend(values)

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(out[f.name], f.type) for f in out_schema]
            for values in out.values():
                values.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=out_schema)

        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(names)}
            ids = list(zip(*[cols[k] for k in keys]))
            lo = 0
            while lo < len(ids):
                hi = lo + 1
                while hi < len(ids) and ids[hi] == ids[lo]:
                    hi += 1
                if ids[lo] != now:
                    if now is not None:
                        close()
                    now, group = ids[lo], {n: [] for n in names}
                for n in names:
                    group[n].extend(cols[n][lo:hi])
                lo = hi
                if len(out[out_schema.names[0]]) >= HELD:
                    yield flush()
        if now is not None:
            close()
        if out[out_schema.names[0]]:
            yield flush()

    return sorted_.mapInArrow(run, schema)


def fold_pages(df: DataFrame, keys: list[str], order: list[str | Column], step: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """As fold(), but step gets many whole groups at once as Arrow, and the place at which each begins; it gives batches of the schema's columns."""
    sorted_ = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def key(batch: pa.RecordBatch, i: int) -> tuple:
            return tuple(batch.column(k)[i].as_py() for k in keys)

        def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [p for p in parts if p.num_rows]
            if parts:
                one = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                yield from step(one, starts_of(one, keys))

        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(starts_of(batch, keys)[-1])
            if last or (held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0)):
                yield from whole([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        yield from whole(held)

    return sorted_.mapInArrow(run, schema)


def starts_of(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys begin; null is a key of its own."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        ids = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= ids[1:] != ids[:-1]
    return np.flatnonzero(new)
