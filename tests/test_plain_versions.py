"""Steps that SQL can't say, over whole tables, against versions written apart from them in plain Python; and odd rows."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from leafmill.operators import coordinates, layout, regions, tables
from leafmill.plans import fixtures as fx
from leafmill.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_ratio(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    return 0.9 if a in b or b in a else SequenceMatcher(None, a, b).ratio()


def plain_overlap(a, b):
    return next((n for n in range(10, min(len(a), len(b), 100) + 1) if a[-n:] == b[:n]), 0)


def plain_relation(a, b, threshold=0.95):
    if a == b:
        return "same"
    if b[: len(a)] == a:
        return "longer"
    if a[: len(b)] == b:
        return "shorter"
    if plain_overlap(a, b) > 0.7 * min(len(a), len(b)):
        return "longer" if len(b) > len(a) else "shorter"
    return "similar" if plain_ratio(a, b) > threshold else "different"


def test_relations_of_the_whole_table(spark):
    got = {(r.doc_id, r.i): (r.relation, r.ratio) for r in QUERIES["g_relation"](spark, SF).collect()}
    n = 0
    for r in fx.table(spark, SF, "documents").collect():
        lines = r.text.split("\n")
        for i, (a, b) in enumerate(zip(lines, lines[1:])):
            n += 1
            assert got[r.doc_id, i] == (plain_relation(a, b), pytest.approx(plain_ratio(a, b), abs=1e-6))
    assert n == len(got) > 0


STARTS = ("所以", "因此", "但是", "然而", "首先", "其次", "最后", "总之", "例如", "比如", "【", "#")


def new_paragraph(x):
    return bool(re.match(r"\d+\.", x)) or x.startswith(STARTS)


def unfinished(a, b):
    if a[-1] in "，、：；\"（的是和与在了为对向被把让给从到以因但而或及筛防密告":
        return True
    return b[0] in '"）。！？御码诉' or b.startswith("选器") or (len(a) < 5 and not new_paragraph(b)) or len(b) < 3


def plain_clean(text, legacy):
    lines = text.split("\n")
    kept = lines[:1]
    for line in lines[1:]:
        x = line.strip()
        if legacy:
            like = False
            for k in kept[-5:]:
                k = k.strip()
                share = 0.0 if not x or not k else 1.0 if x == k else 0.9 if x in k or k in x else len(set(x) & set(k)) / len(set(x) | set(k))
                like |= share > 0.8
            if not like:
                kept.append(line)
            continue
        for i in range(max(0, len(kept) - 10), len(kept)) if x else ():
            k = kept[i].strip()
            how = plain_relation(k, x) if k else "different"
            if how == "similar":
                how = "longer" if len(x) > len(k) else "shorter"
            if how != "different":
                if how == "longer":
                    kept[i] = line
                break
        else:
            kept.append(line)
    glued, open_ = [], ""
    for line in kept:
        x = line.strip()
        if open_ and x and unfinished(open_, x):
            open_ += x
            continue
        if open_:
            glued.append(open_)
        open_ = x
        if not x:
            glued.append(line)
    glued += [open_] if open_ else []
    han = lambda c: 0x4E00 <= ord(c) <= 0x9FFF
    words = []
    if len(glued) < 2:
        words = glued
    i = 0
    while len(glued) > 1 and i < len(glued):
        x = glued[i].strip()
        m = re.fullmatch(r"\*\*\d+\.\*\*\s*(.+)", x)
        title = m is not None and len(m[1]) < 15
        ends = x[:1] in "#◎" or x[-1:] in "】？：" or title or (len(x) < 25 and not (x.startswith("**") and not title))
        j = next((j for j in range(i + 1, len(glued)) if glued[j].strip()), None)
        y = glued[j].strip() if j is not None else ""
        if x and not ends and han(x[-1]) and y and han(y[0]) and not new_paragraph(y):
            words.append(x + y)
            i = j + 1
        else:
            words.append(glued[i])
            i += 1
    return plain_format("\n".join(words).split("\n"))


def plain_format(lines):
    out = ["\n## " + x.strip()[1:-1] + "\n" if re.fullmatch("【.+】", x.strip(), re.S) else x for x in lines]
    numbered = []
    for k, x in enumerate(out):
        m = re.fullmatch(r"(\d+)\.([^\s\d].*)", x.strip(), re.S)
        if m and k and out[k - 1].strip():
            numbered.append("")
        numbered.append(f"**{m[1]}.** {m[2]}" if m else x)
    spaced = []
    for k, x in enumerate(numbered):
        spaced.append(x)
        after = numbered[k + 1].strip() if k + 1 < len(numbered) else ""
        if x.strip()[-1:] and x.strip()[-1] in "。！？" and len(after) > 15 and not re.match(r"[#*\-\d]", after):
            spaced.append("")
    return "\n".join(x for k, x in enumerate(spaced) if x.strip() or k == 0 or spaced[k - 1].strip())


@pytest.mark.parametrize(("name", "legacy"), [("h_clean_text", False), ("h_clean_text_legacy", True)])
def test_cleaned_texts_of_the_whole_table(spark, name, legacy):
    got = {r.doc_id: r.text for r in QUERIES[name](spark, SF).collect()}
    for r in fx.marked_texts(spark, SF).collect():
        assert got[r.doc_id] == plain_clean(r.text, legacy), r.doc_id


def test_safe_cuts_of_the_whole_table(spark):
    got: dict[int, list[int]] = {}
    for r in QUERIES["f_safe_cuts"](spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r.cut)
    for r in fx.profiles(spark, SF).select("doc_id", "height").collect():
        rows, small = (r.height - 1) // 20 + 1, r.height // 20
        blank = [(y * 7 + r.doc_id) % 100 < 60 for y in range(rows)]
        centers, y = [], 0
        while y < rows:
            z = y
            while z < rows and blank[z]:
                z += 1
            if z - y >= 5:
                centers.append((y + z) // 2)
            y = max(z, y + 1)
        want, target = set(), 200
        while target < small:
            near = sorted((abs(c - target), k) for k, c in enumerate(centers) if abs(c - target) <= 60)
            cut = centers[near[0][1]] if near else target
            if cut + 180 <= target:
                cut = target
            want.add(cut)
            target = cut + 180
        assert sorted(got[r.doc_id]) == sorted(want | {small})


# odd rows

BOX = "doc_id long, slice_index int, box_no long, text string, confidence double, x double, y double, w double, h double"
GOOD = [(1, 0, 0, "A1", 1.0, 0.1, 0.8, 0.1, 0.05), (1, 0, 1, "A2", None, 0.3, 0.8, 0.1, 0.05), (1, 0, 2, "B1", 1.0, 0.1, 0.6, 0.1, 0.05), (1, 0, 3, "B2", 1.0, 0.3, 0.6, 0.1, 0.05)]
ODD = [(1, 0, 4, None, None, None, None, None, None), (1, 0, 5, "no y", 1.0, 0.1, None, 0.1, 0.05), (1, 0, 6, "no x", 1.0, None, 0.8, 0.1, 0.05), (1, 0, 7, "no w", 1.0, 0.1, 0.8, None, 0.05), (1, 0, 8, "no h", 1.0, 0.1, 0.6, 0.1, None)]
REST = [(None, 0, 0, "z", 1.0, 0.1, 0.8, 0.1, 0.05), (2, 0, 0, "", 0.0, 0.0, 0.0, 0.0, 0.0), (2, 0, 0, "", 0.0, 0.0, 0.0, 0.0, 0.0)]
CUT = "doc_id long, slice_index int, y_start int, y_end int, page_height int"
FOLDS = {
    "rows": lambda b: tables.rows(b), "columns": lambda b: tables.columns(b), "tables": lambda b: tables.tables(b), "cells": lambda b: tables.cells(b), "deduplicate": lambda b: coordinates.deduplicate(b), "placed": lambda b: coordinates.deduplicate(b, placed=True),
    "line numbers": lambda b: coordinates.line_numbers(b), "segments": lambda b: coordinates.segments(b), "text": lambda b: coordinates.merge_to_text(b), "order": lambda b: coordinates.reading_order(b),
    "suppress": lambda b: regions.suppress(b.withColumn("region_index", F.col("box_no").cast("int"))).drop("region_index"), "region order": lambda b: regions.reading_order(b, tie="box_no"), "layout": lambda b: layout.format_with_layout(b),
    "merged": lambda b: coordinates.merge_results(b, b.sparkSession.createDataFrame([(1, 0, 0, 1000, 1000), (2, 0, 0, 1000, 1000)], CUT)),
}


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_odd_boxes(spark, name):
    """Nulls in any column, repeated rows, more columns and empty tables: no failure, and good boxes fare as without the odd ones."""
    run = FOLDS[name]
    make = lambda rows: spark.createDataFrame(rows, BOX)
    alone = run(make(GOOD))
    got = run(make(GOOD + ODD + REST))
    assert got.columns == alone.columns
    keyed = [c for c in ("box_no", "row", "col") if c in alone.columns]
    plain = lambda df: {tuple(r[c] for c in keyed): tuple(str(v) for v in r) for r in df.filter("doc_id = 1").collect()}
    if name not in ("layout",):
        mine = plain(got)
        assert all(mine[k] == v for k, v in plain(alone).items())
    assert run(make([])).count() == 0
    more = run(make(GOOD).withColumns({c: F.lit(1) for c in ("y_start", "y_end", "page_height", "center", "n", "cells", "b")}))
    assert sorted(map(str, more.select(*alone.columns).collect())) == sorted(map(str, alone.collect()))


def test_boxes_without_a_confidence_stay(spark):
    from leafmill.sources.boxes import recognise

    p = spark.createDataFrame([(1, 1, b"x")], "doc_id long, page_no int, data binary")
    assert recognise(p, lambda d: [("a", None, 0.0, 0.0, 1.0, 1.0), ("b", 0.2, 0.0, 0.0, 1.0, 1.0)], threshold=0.5).first().text == "a"


def test_one_exchange_a_fold(spark):
    b = spark.createDataFrame(GOOD, BOX)
    for run in (tables.to_markdown(tables.tables(b)), coordinates.merge_to_text(b), coordinates.segments(b), coordinates.deduplicate(b, placed=True)):
        plan = run._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1
