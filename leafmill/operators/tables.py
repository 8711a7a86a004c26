"""Tables from boxes: rows, columns, cells, and their printed forms.

A page's rows, columns and cells come out of one fold: one exchange by page. From there on a table is one row with a
nested grid, and printing is array expressions within it. Boxes without a place (null x, y, w or h) are in no row, column or cell;
boxes with a null key make one page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.coordinates import _ddl
from leafmill.operators.folds import fold_pages


def _row_numbers(centers: list[float | None], tolerance: float) -> list[int | None]:
    """Rows of centres that come from the top down, and grow upwards: each joins the first row whose running mean is within the tolerance."""
    sums, counts, of = [], [], []
    means: list[float] = []
    for c in centers:
        if c is None:
            of.append(None)
            continue
        for r, m in enumerate(means):
            if abs(c - m) <= tolerance:
                break
        else:
            r = len(sums)
            sums.append(0.0)
            counts.append(0)
            means.append(0.0)
        sums[r] += c
        counts[r] += 1
        means[r] = sums[r] / counts[r]
        of.append(r)
    place = {r: i for i, r in enumerate(sorted(range(len(sums)), key=lambda r: -sums[r] / counts[r]))}
    return [None if r is None else place[r] for r in of]


def _chains(values: list[float], tolerance: float) -> list[float]:
    """Means of chains of ascending values no further apart than the tolerance."""
    out, held = [], []
    for v in values:
        if held and v - held[-1] > tolerance:
            out.append(sum(held) / len(held))
            held = []
        held.append(v)
    if held:
        out.append(sum(held) / len(held))
    return out


def _columns(x: list[float], row: list[int], tolerance: float, alignment: float) -> list[float]:
    """Ascending chain means that at least that share of the rows has a box at."""
    n_rows = len(set(row))
    centers = _chains(sorted(x), tolerance)
    near: list[set[int]] = [set() for _ in centers]
    for v, r in zip(x, row):
        for c, rows_ in zip(centers, near):
            if abs(v - c) <= tolerance:
                rows_.add(r)
    return [c for c, rows_ in zip(centers, near) if len(rows_) / n_rows >= alignment]


def _column_of(x: float, centers: list[float], tolerance: float) -> int:
    """The first column within the tolerance, else the nearest, the lowest on a tie."""
    for i, c in enumerate(centers):
        if abs(x - c) <= tolerance:
            return i
    off = [abs(x - c) for c in centers]
    return off.index(min(off))


#: Share by which values must keep away from a tolerance for the short way to be taken; rounding of means is far less.
AWAY = 1e-9


def _page_of(starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


def _rows_of_pages(c: np.ndarray, starts: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """_row_numbers() of many pages at once, and the pages for which that doesn't hold.

    Where centres fall into runs narrower than the tolerance and further apart than it, no box is within the tolerance of
    another run's mean nor beyond it from its own: the runs are the rows. Other pages, and those with boxes without a place, take the long way.
    """
    page = _page_of(starts, len(c))
    eps = AWAY * (np.abs(c) + tolerance)
    new = np.zeros(len(c), bool)
    new[1:] = ~(c[:-1] - c[1:] <= tolerance + eps[1:])
    new[starts] = True
    run = np.cumsum(new) - 1
    heads = c[np.flatnonzero(new)]
    off = ~(heads[run] - c <= tolerance - eps)
    return run - run[starts][page], np.bincount(page[off], minlength=len(starts)) > 0


def _numbers(column: pa.Array) -> np.ndarray:
    """Values, null as nan."""
    return column.to_numpy(zero_copy_only=False)


def _columns_of_pages(x: np.ndarray, row: np.ndarray, starts: np.ndarray, tolerance: float, alignment: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_columns() and _column_of() of many pages at once, all boxes placed: columns (page, center), the column within its page of each box (-1 without any), rows of each page, and the pages for which that doesn't hold."""
    page = _page_of(starts, len(x))
    order = np.lexsort((x, page))
    v, of = x[order], page[order]
    gap = np.zeros(len(v))
    gap[1:] = v[1:] - v[:-1]
    same = np.zeros(len(v), bool)
    same[1:] = of[1:] == of[:-1]
    new = ~same | (gap > tolerance)
    # a mean is rounded: chains that are only just apart take the long way
    off = same & new & ~(gap > tolerance + AWAY * (np.abs(v) + tolerance))
    bad = np.bincount(of[off], minlength=len(starts)) > 0
    chain = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(v)))
    if v.dtype.kind == "f":
        listed = v.tolist()
        center = np.array([sum(listed[a : a + k]) / k for a, k in zip(first.tolist(), size.tolist())], float)
    else:
        center = np.add.reduceat(v, first) / size
    n_rows = np.maximum.reduceat(row, starts) + 1
    hit = np.abs(v - center[chain]) <= tolerance
    wide = int(n_rows.max())
    near = np.bincount(np.unique(chain[hit] * wide + row[order][hit]) // wide, minlength=len(first))
    chain_page = of[first]
    valid = near / n_rows[chain_page] >= alignment
    col_page, col_center = chain_page[valid], center[valid]
    begins = np.searchsorted(col_page, np.arange(len(starts) + 1))
    number = np.cumsum(valid) - 1 - begins[chain_page]
    col = np.where(hit & valid[chain], number[chain], -1)
    # boxes of no column go to the nearest, the lowest on a tie
    lost = np.flatnonzero(col < 0)
    best = np.full(len(lost), np.inf)
    n_cols = np.diff(begins)
    for k in range(int(n_cols[of[lost]].max(initial=0))):
        has = n_cols[of[lost]] > k
        away = np.full(len(lost), np.inf)
        away[has] = np.abs(v[lost[has]] - col_center[begins[of[lost[has]]] + k])
        col[lost[away < best]] = k
        best = np.minimum(best, away)
    out = np.empty(len(x), np.int64)
    out[order] = col
    return col_page, col_center, out, n_rows, bad


def _group(batch: pa.RecordBatch, a: int, b: int) -> dict[str, list]:
    part = batch.slice(a, b - a)
    return {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}


def _by_page(key: str, fast, step, schema: str):
    """A step for fold_pages: fast(batch of pages, starts) gives a batch, and which pages it left out; these go through step one by one."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def run(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.append(starts[1:], batch.num_rows)
        c, x = _numbers(batch.column("__c")), _numbers(batch.column("x"))
        odd = np.isnan(c) | (np.isnan(x) if x.dtype.kind == "f" else x.dtype.kind not in "iu") | _numbers(batch.column("box_no").is_null())
        bad = np.add.reduceat(odd.astype(np.int64), starts) > 0
        if not bad.any():
            good = batch
        elif not bad.all():
            good = batch.filter(pa.array(np.repeat(~bad, ends - starts)))
        if not bad.all():
            from_ = np.append(0, np.cumsum((ends - starts)[~bad]))[:-1]
            made, left = fast(good, from_)
            bad[np.flatnonzero(~bad)[left]] = True
            if made.num_rows:
                yield made
        out: dict[str, list] = {n: [] for n in kinds.names}
        for a, b in zip(starts[bad].tolist(), ends[bad].tolist()):
            for n, values in step(_group(batch, a, b)).items():
                out[n].extend(values)
        if out[kinds.names[0]]:
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

    return run


def _from_the_top(boxes: DataFrame, key: str, top_origin: bool, step, schema: str, fast) -> DataFrame:
    center = F.col("y") + F.col("h") / 2
    placed = F.col("x").isNotNull() & F.col("w").isNotNull()
    center = F.when(placed, -center if top_origin else center)
    kinds = boxes.sparkSession.createDataFrame([], schema).schema
    return fold_pages(boxes.withColumn("__c", center.cast("double")), [key], [F.col("__c").desc_nulls_last(), "box_no"], _by_page(key, fast, step, kinds), schema)


def rows(boxes: DataFrame, tolerance: float = 0.015, key: str = "doc_id", top_origin: bool = False) -> DataFrame:
    """boxes with row_no, from 0 at the top of the page; null for a box without a place.

    From the top down a box joins the first row whose *running mean* of centres is within the tolerance. Rows are then
    numbered by their final means. y grows upwards unless top_origin says otherwise.
    """

    def step(g: dict[str, list]) -> dict[str, list]:
        return {k: v for k, v in g.items() if k != "__c"} | {"row_no": _row_numbers(g["__c"], tolerance)}

    names = boxes.columns

    def fast(batch: pa.RecordBatch, starts: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        row, bad = _rows_of_pages(_numbers(batch.column("__c")), starts, tolerance)
        made = pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(row, pa.int32())], names=[*names, "row_no"])
        return (made.filter(pa.array(~bad[_page_of(starts, len(row))])) if bad.any() else made), bad

    return _from_the_top(boxes, key, top_origin, step, _ddl(boxes) + ", row_no int", fast)


def columns(boxes: DataFrame, y_tolerance: float = 0.015, x_tolerance: float = 0.025, alignment: float = 0.6, key: str = "doc_id", top_origin: bool = False) -> DataFrame:
    """(key, n_rows, centers): ascending left edges at which at least that share of the rows has a box. A page without such an edge has no row here."""

    def step(g: dict[str, list]) -> dict[str, list]:
        row = _row_numbers(g["__c"], y_tolerance)
        kept = [i for i, r in enumerate(row) if r is not None]
        centers = _columns([g["x"][i] for i in kept], [row[i] for i in kept], x_tolerance, alignment) if kept else []
        return {key: g[key][:1], "n_rows": [len({row[i] for i in kept})], "centers": [centers]} if centers else {}

    def fast(batch: pa.RecordBatch, starts: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        row, bad = _rows_of_pages(_numbers(batch.column("__c")), starts, y_tolerance)
        page, center, _, n_rows, off = _columns_of_pages(_numbers(batch.column("x")), row, starts, x_tolerance, alignment)
        bad |= off
        use = ~bad[page]
        found, n = np.unique(page[use], return_counts=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(center[use], pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(starts[found])), pa.array(n_rows[found], pa.int32()), lists], names=[key, "n_rows", "centers"]), bad

    narrow = boxes.select(key, "box_no", "x", "y", "w", "h")
    return _from_the_top(narrow, key, top_origin, step, f"`{key}` {dict(boxes.dtypes)[key]}, n_rows int, centers array<double>", fast)


def tables(boxes: DataFrame, y_tolerance: float = 0.015, x_tolerance: float = 0.025, min_rows: int = 2, min_cols: int = 2, alignment: float = 0.6, key: str = "doc_id", top_origin: bool = False) -> DataFrame:
    """(key, n_rows, n_cols, cells) for each page that has a table; cells is an array of (row, col, text, x, y, w, h) by row and column. Of boxes in one cell the rightmost counts."""

    def step(g: dict[str, list]) -> dict[str, list]:
        row = _row_numbers(g["__c"], y_tolerance)
        kept = [i for i, r in enumerate(row) if r is not None]
        n_rows = len({row[i] for i in kept})
        centers = _columns([g["x"][i] for i in kept], [row[i] for i in kept], x_tolerance, alignment) if n_rows >= min_rows else []
        if len(centers) < min_cols:
            return {}
        cell: dict[tuple[int, int], int] = {}
        for i in kept:
            at = row[i], _column_of(g["x"][i], centers, x_tolerance)
            j = cell.get(at)
            if j is None or (g["x"][i], g["box_no"][i]) > (g["x"][j], g["box_no"][j]):
                cell[at] = i
        at = sorted(cell)
        return {key: g[key][:1], "n_rows": [n_rows], "n_cols": [len(centers)], "row": [[r for r, _ in at]], "col": [[c for _, c in at]]} | {n: [[g[n][cell[p]] for p in at]] for n in ("text", "x", "y", "w", "h")}

    def fast(batch: pa.RecordBatch, starts: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        row, bad = _rows_of_pages(_numbers(batch.column("__c")), starts, y_tolerance)
        x = _numbers(batch.column("x"))
        col_page, _, col, n_rows, off = _columns_of_pages(x, row, starts, x_tolerance, alignment)
        bad |= off
        n_cols = np.bincount(col_page, minlength=len(starts))
        use = ~bad & (n_rows >= min_rows) & (n_cols >= min_cols) & (n_cols > 0)
        page = _page_of(starts, len(x))
        at = np.flatnonzero(use[page])
        # of each cell's boxes the last by x and number, the first of equal ones
        at = at[np.lexsort((-at, _numbers(batch.column("box_no"))[at], x[at], col[at], row[at], page[at]))]
        cell = np.stack([page[at], row[at], col[at]])
        last = np.ones(len(at), bool)
        last[:-1] = (cell[:, 1:] != cell[:, :-1]).any(axis=0)
        at = at[last]
        found, n = np.unique(page[at], return_counts=True)
        ends, taken = pa.array(np.append(0, np.cumsum(n)), pa.int32()), batch.take(pa.array(at))
        values = [pa.array(row[at], pa.int32()), pa.array(col[at], pa.int32()), *[taken.column(c) for c in ("text", "x", "y", "w", "h")]]
        arrays = [batch.column(key).take(pa.array(starts[found])), pa.array(n_rows[found], pa.int32()), pa.array(n_cols[found], pa.int32()), *[pa.ListArray.from_arrays(ends, v) for v in values]]
        return pa.RecordBatch.from_arrays(arrays, names=[key, "n_rows", "n_cols", *lists]), bad

    kinds = dict(boxes.dtypes)
    lists = {"row": "int", "col": "int"} | {c: kinds[c] for c in ("text", "x", "y", "w", "h")}
    schema = f"`{key}` {kinds[key]}, n_rows int, n_cols int, " + ", ".join(f"{c} array<{k}>" for c, k in lists.items())
    found = _from_the_top(boxes.select(key, "box_no", "text", "x", "y", "w", "h"), key, top_origin, step, schema, fast)
    return found.select(key, "n_rows", "n_cols", F.arrays_zip(*lists).alias("cells"))  # flat lists come out of Python faster than structs


def cells(boxes: DataFrame, y_tolerance: float = 0.015, x_tolerance: float = 0.025, min_rows: int = 2, min_cols: int = 2, alignment: float = 0.6, key: str = "doc_id", top_origin: bool = False) -> DataFrame:
    """(key, row, col, n_rows, n_cols, text, x, y, w, h): tables() with a row for each cell."""
    found = tables(boxes, y_tolerance, x_tolerance, min_rows, min_cols, alignment, key, top_origin)
    return found.select(key, "n_rows", "n_cols", F.inline("cells")).select(key, "row", "col", "n_rows", "n_cols", "text", "x", "y", "w", "h")


def of_cells(cell: DataFrame, key: str = "doc_id") -> DataFrame:
    """cells() as tables() again, one exchange; for cells that come from elsewhere."""
    whole = F.array_sort(F.collect_list(F.struct("row", "col", "text", "x", "y", "w", "h")))
    return cell.groupBy(key).agg(F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"), whole.alias("cells"))


def _grid(found: DataFrame, empty: Column, entry) -> DataFrame:
    """found with `grid`: by row, for each column entry(cell), or empty where there is none. A row's cells are looked at, not the whole page's."""
    per = F.transform(F.sequence(F.lit(0), F.col("n_rows") - 1), lambda r: F.filter("cells", lambda c: c["row"] == r))
    out = found.withColumn("__rows", F.when(F.col("n_rows") > 0, per))

    def line(cs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda k: F.coalesce(F.get(F.transform(F.filter(cs, lambda c: c["col"] == k), entry), F.lit(0)), empty))

    return out.withColumn("grid", F.transform("__rows", line)).drop("__rows")


def _text(c: Column) -> Column:
    return F.coalesce(c["text"], F.lit(""))


def to_markdown(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, markdown): the first row is the header; a missing cell is empty."""
    printed = _grid(found, F.lit(""), _text)
    lines = F.transform("grid", lambda t: F.concat(F.lit("| "), F.array_join(t, " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("n_cols")), " | "), F.lit(" |"))
    whole = F.concat(F.slice("lines", 1, 1), F.array(rule), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))))
    return printed.select(key, "n_cols", lines.alias("lines")).select(key, F.array_join(whole, "\n").alias("markdown"))


def to_html(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, html); texts go in as they are."""

    def line(texts: Column, i: Column) -> Column:
        tag = F.when(i == 0, "th").otherwise("td")
        return F.concat(F.lit("  <tr>\n"), F.array_join(F.transform(texts, lambda t: F.concat(F.lit("    <"), tag, F.lit(">"), t, F.lit("</"), tag, F.lit(">\n"))), ""), F.lit("  </tr>"))

    return _grid(found, F.lit(""), _text).select(key, F.concat(F.lit("<table>\n"), F.array_join(F.transform("grid", line), "\n"), F.lit("\n</table>")).alias("html"))


def to_json(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, json): rows, cols and cells (text, and bbox or null)."""
    bbox = lambda c: F.array(c["x"], c["y"], c["w"], c["h"])
    kind = found.schema["cells"].dataType.elementType["x"].dataType
    none = F.struct(F.lit("").alias("text"), F.lit(None).cast(f"array<{kind.simpleString()}>").alias("bbox"))
    printed = _grid(found, none, lambda c: F.struct(_text(c).alias("text"), bbox(c).alias("bbox")))
    body = F.struct(F.col("n_rows").alias("rows"), F.col("n_cols").alias("cols"), F.col("grid").alias("cells"))
    return printed.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
