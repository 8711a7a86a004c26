"""Small inline fixtures with results worked out by hand."""

from __future__ import annotations

import io
import json
import random
import struct
import zipfile
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import paths
from leafmill.functions.text import character_similarity, overlap_length, ratio, relation, sequence_ratio
from leafmill.operators import cleaner, coordinates, images, layout, quality, regions, slicing, tables
from leafmill.plans import pipelines
from leafmill.plans.queries import QUERIES
from leafmill.sinks import documents as sink
from leafmill.sources import boxes as src
from leafmill.sources import files


def boxes(spark, rows, key=1):
    """rows: (text, confidence, [x, y, w, h])"""
    return spark.createDataFrame([(key, i, t, None if c is None else float(c), *map(float, b)) for i, (t, c, b) in enumerate(rows)], "doc_id long, box_no long, text string, confidence double, x double, y double, w double, h double")


GRID = [("A1", 1.0, [0.1, 0.8, 0.1, 0.05]), ("A2", 1.0, [0.3, 0.8, 0.1, 0.05]), ("B1", 1.0, [0.1, 0.6, 0.1, 0.05]), ("B2", 1.0, [0.3, 0.6, 0.1, 0.05])]


def test_rows_and_columns(spark):
    rowed = tables.rows(boxes(spark, GRID), 0.02)
    assert {(r.text, r.row_no) for r in rowed.collect()} == {("A1", 0), ("A2", 0), ("B1", 1), ("B2", 1)}
    assert tables.columns(boxes(spark, GRID), 0.02, 0.03, 0.5).first().centers == pytest.approx([0.1, 0.3])


def test_table_markdown_html_json(spark):
    g = tables.of_cells(tables.cells(boxes(spark, GRID)))
    assert tables.to_markdown(g).first().markdown == "| A1 | A2 |\n| --- | --- |\n| B1 | B2 |"
    assert tables.to_html(g).first().html == "<table>\n  <tr>\n    <th>A1</th>\n    <th>A2</th>\n  </tr>\n  <tr>\n    <td>B1</td>\n    <td>B2</td>\n  </tr>\n</table>"
    got = json.loads(tables.to_json(g).first().json)
    assert (got["rows"], got["cols"], got["cells"][1][0]["text"]) == (2, 2, "B1")


def test_no_table(spark):
    assert tables.cells(boxes(spark, GRID[:2])).count() == 0
    assert tables.cells(boxes(spark, [])).count() == 0


def test_missing_cell_and_single_row_markdown(spark):
    g = tables.tables(boxes(spark, GRID[:3]), alignment=0.5)
    assert tables.to_markdown(g).first().markdown == "| A1 | A2 |\n| --- | --- |\n| B1 |  |"


def test_rows_follow_the_running_mean(spark):
    got = tables.rows(boxes(spark, [("a", 1, [0, 0.500, 0.1, 0]), ("b", 1, [0.2, 0.488, 0.1, 0]), ("c", 1, [0.4, 0.482, 0.1, 0]), ("d", 1, [0.6, 0.470, 0.1, 0])]), 0.015)
    assert {r.text: r.row_no for r in got.collect()} == {"a": 0, "b": 0, "c": 0, "d": 1}


def test_paragraphs_top_origin(spark):
    b = boxes(spark, [("one", 1.0, [0.1, 0.10, 0.8, 0.03]), ("two", 1.0, [0.1, 0.14, 0.8, 0.03]), ("three", 1.0, [0.1, 0.30, 0.8, 0.03])])
    assert [(r.text, r.n_lines) for r in layout.paragraphs(b).orderBy("para_no").collect()] == [("one\ntwo", 2), ("three", 1)]


def test_headings(spark):
    p = spark.createDataFrame([(1, 1, "Title", 0.06), (2, 1, "body", 0.03), (3, 1, "【x】", 0.03), (4, 1, "一、y", 0.03), (5, 1, "1. z", 0.03), (6, 2, "long\nline", 0.034), (7, 1, "short", 0.034), (8, 1, "mid", 0.05)], "para_no int, n_lines int, text string, h double")
    got = {r.para_no: r.heading_level for r in layout.mark_headings(p.withColumn("avg_h", F.lit(0.03))).collect()}
    assert got == {1: 1, 2: 0, 3: 2, 4: 2, 5: 3, 6: 0, 7: 3, 8: 2}


def test_lists(spark):
    p = spark.createDataFrame([("• 列表项 1",), ("1. 有序列表项",), ("2) x",), ("普通段落",)], "text string")
    assert [r.list_type for r in layout.mark_lists(p).collect()] == ["unordered", "ordered", "ordered", None]


def test_markdown_heading_wins_over_list(spark):
    b = boxes(spark, [("1. first", 1.0, [0.1, 0.1, 0.5, 0.03]), ("- item", 1.0, [0.1, 0.4, 0.5, 0.03])])
    assert layout.format_with_layout(b).first().markdown == "### 1. first\n\n- item\n"


def test_lines_use_the_first_box_as_anchor(spark):
    got = coordinates.line_numbers(boxes(spark, [("a", 1, [0, 0.100, 0.1, 0.03]), ("b", 1, [0.2, 0.109, 0.1, 0.03]), ("c", 1, [0.4, 0.112, 0.1, 0.03])]))
    assert {r.text: r.line_no for r in got.collect()} == {"a": 0, "b": 0, "c": 1}


def test_merge_to_text(spark):
    b = boxes(spark, [("right", 1, [0.5, 0.1, 0.1, 0.03]), ("left", 1, [0.1, 0.1, 0.1, 0.03]), ("near", 1, [0.22, 0.101, 0.1, 0.03]), ("below", 1, [0.1, 0.3, 0.1, 0.03])])
    assert coordinates.merge_to_text(b).first().text == "left near\nright\nbelow"
    assert coordinates.merge_to_text(b, keep_lines=False).first().text == "right left near below"


def test_deduplicate_rules(spark):
    def run(*rows):
        return [r.text for r in coordinates.deduplicate(boxes(spark, rows)).orderBy("y", "x", "box_no").collect()]

    same = [0.1, 0.1, 0.5, 0.03]
    assert run(("hello", 0.5, same), ("hello", 0.5, same)) == ["hello"]
    assert run(("hello", 0.5, same), ("hello there", 0.9, same)) == ["hello there"]
    assert run(("hello", 0.5, same), ("world", 0.9, same)) == ["hello", "world"]
    assert run(("hello", 0.5, same), ("hello", 0.9, [0.1, 0.5, 0.5, 0.03])) == ["hello", "hello"]


def test_slices_round_trip(spark):
    cut = spark.createDataFrame([(1, 0, 0, 500, 900), (1, 1, 400, 900, 900)], "doc_id long, slice_index int, y_start long, y_end long, page_height long")
    # a line at y 420..440 is in both slices; in either its lower edge is measured from the slice's bottom
    b = spark.createDataFrame([(1, 0, 0, "line", 0.5, 0.1, (500 - 440) / 500, 0.5, 20 / 500), (1, 1, 0, "line", 0.9, 0.1, (900 - 440) / 500, 0.5, 20 / 500)], "doc_id long, slice_index int, box_no long, text string, confidence double, x double, y double, w double, h double")
    got = coordinates.merge_results(b, cut).collect()
    assert len(got) == 1 and got[0].slice_index == 1
    assert (got[0].y * 900, got[0].h * 900) == pytest.approx((420, 20))


def test_similarities(spark):
    df = spark.createDataFrame([("  ", "abc"), ("", "abc"), ("abc ", "abc"), ("abcd", "bc"), ("abc", "abd")], "a string, b string")
    assert [r[0] for r in df.select(character_similarity(F.col("a"), F.col("b"))).collect()] == [0.9, 0.0, 1.0, 0.9, 0.5]
    df = spark.createDataFrame([("xx0123456789", "0123456789yy"), ("short", "rt"), ("a" * 30, "a" * 30), ("0123456789", "abc0123456789")], "a string, b string")
    assert [r[0] for r in df.select(overlap_length(F.col("a"), F.col("b"))).collect()] == [10, 0, 10, 0]
    assert [r[0] for r in spark.createDataFrame([("abcd", "bcde"), ("", "x")], "a string, b string").select(sequence_ratio("a", "b")).collect()] == [0.75, 0.0]


def test_relation():
    assert relation("abc", "abc") == "same" and relation("abc", "abcd") == "longer" and relation("abcd", "abc") == "shorter"
    assert relation("xy0123456789", "0123456789zzz") == "longer"
    assert relation("the quick brown fox", "quick brown") == "different"
    assert ratio("quick", "the quick") == 0.9


def test_regions(spark):
    r = spark.createDataFrame([(1, 0, 0, 0, 100, 100), (1, 1, 10, 10, 20, 20), (1, 2, 50, 0, 100, 100), (1, 3, 200, 0, 50, 50), (1, 4, 0, 300, 5, 5)], "doc_id long, region_index int, x int, y int, w int, h int")
    assert sorted(x.region_index for x in regions.suppress(r).collect()) == [0, 2, 3, 4]
    assert sorted(x.region_index for x in regions.suppress(r, contained=None).collect()) == [0, 1, 2, 3, 4]
    order = regions.reading_order(r.filter("region_index in (2, 3, 4)")).orderBy("place")
    assert [x.region_index for x in order.collect()] == [3, 2, 4] or [x.region_index for x in order.collect()] == [2, 3, 4]
    p = spark.createDataFrame([(1, 400, 400), (2, 300, 200)], "doc_id long, width int, height int")
    assert {(x.doc_id, x.region_type) for x in regions.with_fallback(r.withColumns({"confidence": F.lit(1.0), "region_type": F.lit("contour")}), p).collect()} == {(1, "contour"), (2, "whole")}
    assert regions.plausible(r.join(p, "doc_id").filter("region_index in (0, 4)")).count() == 1
    assert regions.combine(r, r).count() == regions.suppress(r).count()


def test_quality(spark):
    text = "\n".join(["x" * 99 + "."] * 1 + ["y" * 99 + "。"] * 1)
    t = spark.createDataFrame([(1, text, 1.0, 30), (2, "", 0.0, 0), (3, None, None, None)], "doc_id long, text string, avg_confidence double, n_boxes int")
    got = {r.doc_id: r for r in quality.metrics(t).collect()}
    assert got[1].char_count == 200 and got[1].coherence_score == pytest.approx(1.0) and got[1].duplicate_ratio == 0
    assert got[1].structure_score == pytest.approx(0.2)
    assert got[2].quality_score == pytest.approx(0.2) and got[3].quality_score == pytest.approx(0.2)


def test_best_attempt(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.7), (1, 2, 0.9), (2, 0, 0.3), (2, 1, 0.5), (2, 2, 0.5), (3, 0, 0.1), (3, 3, 0.9)], "doc_id long, attempt int, quality_score double")
    assert {r.doc_id: r.attempt for r in quality.best_attempt(df).collect()} == {1: 1, 2: 1, 3: 0}
    assert {r.doc_id for r in pipelines.unsatisfied(df).collect()} == {2}


def clean(spark, text, **how):
    return cleaner.clean_text(spark.createDataFrame([(text,)], "text string"), **how).first().text


def test_format_steps(spark):
    def fmt(lines):
        return cleaner.format_only(spark.createDataFrame([("\n".join(lines),)], "text string")).first().text.split("\n")

    assert fmt(["【标题】"]) == ["", "## 标题", ""]
    assert fmt(["正文", "1.苹果"]) == ["正文", "", "**1.** 苹果"]
    assert fmt(["1. 苹果"]) == ["1. 苹果"]
    assert fmt(["结束。", "字" * 16]) == ["结束。", "", "字" * 16]
    assert fmt(["结束。", "字" * 15]) == ["结束。", "字" * 15]
    assert fmt(["a", "", "", "b"]) == ["a", "", "b"]


def test_fold_steps():
    assert cleaner.join_fragments(["他说的", "话很重要"]) == ["他说的话很重要"]
    assert cleaner.join_fragments(["ab", "cdef"]) == ["abcdef"]
    assert cleaner.drop_repeats(["the quick brown fox", "quick brown"]) == ["the quick brown fox", "quick brown"]
    assert cleaner.drop_repeats_by_characters(["the quick brown fox", "quick brown"]) == ["the quick brown fox"]
    assert cleaner.drop_repeats(["abcdefghijkl", "abcdefghijklmno"]) == ["abcdefghijklmno"]
    assert cleaner.drop_repeats(["abcdefghijkl", "abcdefghijklmno"], compat=True) == ["abcdefghijkl"]
    long = "这是一个很长的句子它没有以句号结束而是被切断了后面还"
    assert cleaner.join_broken_words([long, "", "有一半", "x"]) == [long + "有一半", "x"]
    assert cleaner.join_broken_words([long, "所以另起"]) == [long, "所以另起"]


def test_clean_text_nulls_and_empty(spark):
    got = cleaner.clean_text(spark.createDataFrame([(1, None), (2, ""), (3, "a long enough line\na long enough line")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in got] == [None, "", "a long enough line"]
    assert clean(spark, "the quick brown fox runs\nthe quick brown fox", variant="legacy") == "the quick brown fox runs"


def test_slices(spark):
    p = spark.createDataFrame([(1, 12000), (2, 5000), (3, 5001), (4, 100)], "doc_id long, height int")
    got = [(r.doc_id, r.y_start, r.y_end) for r in slicing.plan(p).orderBy("doc_id", "slice_index").collect()]
    assert got == [(1, 0, 5000), (1, 4600, 9600), (1, 9200, 12000), (2, 0, 5000), (3, 0, 5000), (3, 4600, 5001), (4, 0, 100)]
    assert [r[0] for r in p.select(slicing.count(F.col("height"))).collect()] == [3, 1, 2, 1]
    with pytest.raises(ValueError):
        slicing.plan(p, 400, 400)


def test_safe_cuts(spark):
    p = spark.createDataFrame([(1, 250)], "doc_id long, height int")
    runs = spark.createDataFrame([(1, 90, 100), (1, 60, 62)], "doc_id long, start int, stop int")
    assert sorted(r.cut for r in slicing.safe_cuts(runs, p, 100, 10).collect()) == [95, 185, 250]


def test_pixels():
    assert images.otsu(np.array([[10, 10], [200, 200]], np.uint8)) == 10
    g = np.full((8, 8), 100, np.uint8)
    assert images.contrast(g) == 0 and images.noise(g) == 0 and images.sharpness(g) == 0
    assert images.longest_run(np.array([0, 1, 1, 0, 1])) == 2
    assert images.distinct_colors(np.array([[0, 0, 0], [10, 0, 0], [100, 0, 0.0]])) == 2
    assert images.gray(np.array([[[255, 255, 255], [255, 0, 0]]], np.uint8)).tolist() == [[255, 76]]
    assert images.red_to_dark(np.array([[[255, 0, 0], [255, 255, 255]]], np.uint8)).tolist() == [[0, 255]]
    dark = np.full((4, 4), 50, np.uint8)
    assert images.gamma(dark)[0, 0] > 50 > images.gamma(dark, compat=True)[0, 0]
    assert images.whiten_background(np.array([[10, 201]], np.uint8)).tolist() == [[10, 255]]
    assert set(images.block_binarize(np.arange(100, dtype=np.uint8).reshape(10, 10)).ravel()) == {0, 255}
    assert images.stretch(np.full((3, 3), 7, np.uint8)).tolist() == [[7] * 3] * 3
    assert images.median3(np.array([[1, 1, 1], [1, 99, 1], [1, 1, 1]], np.uint8))[1, 1] == 1


def png(a: np.ndarray) -> bytes:
    h, w, _ = a.shape
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (60, 50, 3), np.uint8)
    (tmp_path / "x.png").write_bytes(png(a))
    (tmp_path / "bad.png").write_bytes(b"no picture")
    (tmp_path / "note.txt").write_text("x")
    sub = tmp_path / "sub"
    sub.mkdir()
    (sub / "Y.PNG").write_bytes(png(np.zeros((60, 50, 3), np.uint8)))
    assert [r.path.rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path)).collect()] == ["bad.png", "x.png"]
    assert files.list_files(spark, str(tmp_path), recursive=True).count() == 3
    pics = files.read_images(spark, str(tmp_path / "*.png")).withColumn("doc_id", F.lit(1))
    row = pics.first()
    assert (images.pixels(row.height, row.width, row.nChannels, row.data) == a).all()
    got = images.profiles(pics).first()
    assert got.contrast == pytest.approx(images.contrast(images.gray(a))) and got.source == "digital" and not got.needs_slicing
    assert images.apply(pics, ["gray", "otsu"]).first().nChannels == 1
    assert images.code_region(pics).first().is_code_block is False


def docx(paragraphs, table, picture=None) -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{''.join(map(p, paragraphs))}<w:tbl>{rows}</w:tbl></w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="media/image1.png"/></Relationships>')
        if picture:
            z.writestr("word/media/image1.png", picture)
    return out.getvalue()


def test_docx(spark):
    good = docx(["one", " ", "two"], [["a ", "b"], ["", ""]], b"png")
    f = spark.createDataFrame([("g.docx", bytearray(good)), ("bad.docx", bytearray(b"x"))], "path string, content binary")
    got = {r.path: r for r in files.read_docx(f).collect()}
    assert got["g.docx"].docx_text == "one\n\ntwo\n\na | b"
    assert [(p["index"], bytes(p["data"])) for p in got["g.docx"].pictures] == [(1, b"png")]
    assert got["bad.docx"].docx_text is None and "BadZipFile" in got["bad.docx"].error


def test_recogniser(spark):
    def read(data):
        if data == b"bad":
            raise RuntimeError("cannot")
        return [("low", 0.2, 0.0, 0.0, 1.0, 0.1), ("high", 0.9, 0.0, 0.5, 1.0, 0.1)]

    p = spark.createDataFrame([(1, 1, bytearray(b"x")), (2, 1, bytearray(b"bad"))], "doc_id long, page_no int, data binary")
    got = src.recognise(p, read, threshold=0.5).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.error) for r in got] == [(1, "high", None), (2, None, "RuntimeError: cannot")]
    with pytest.raises(ValueError):
        src.check_options(framework="livetext", level="fast")
    with pytest.raises(ValueError):
        src.check_options(languages=["xx"], supported=["en"])
    b = boxes(spark, [("a", None, [0, 0.2, 1, 0.1])])
    assert src.normalise(b).first().y == pytest.approx(0.7) and src.normalise(b).first().confidence == 1.0


def test_paths(spark):
    df = spark.createDataFrame([("HTTP://a/b.pdf?x",), ("x.PDF",), ("a/.png",), ("a.b/c.jpeg",), ("c.docx",), ("dir",)], "p string")
    assert [r[0] for r in df.select(paths.input_type(F.col("p"))).collect()] == ["url", "pdf", "unknown", "image", "docx", "unknown"]


def test_files_list_and_fetch(spark, tmp_path):
    (tmp_path / "l.txt").write_text(" a.png \n\nb.pdf\n")
    assert [(r.input_idx, r.path) for r in files.read_list(spark, str(tmp_path / "l.txt")).collect()] == [(0, "a.png"), (1, "b.pdf")]

    def get(url):
        if "bad" in url:
            raise OSError("gone")
        return b"ok"

    got = files.fetch(spark.createDataFrame([("good",), ("bad",)], "url string"), get).collect()
    assert [(r.url, r.error) for r in got] == [("good", None), ("bad", "OSError: gone")]


def pages(spark, rows):
    ts = datetime(2024, 1, 2, 3, 4, 5)
    return spark.createDataFrame([(1, "s.png", n, t, d, ts) for n, t, d in rows], "doc_id long, source string, page_no int, text string, docx_text string, ts timestamp")


def test_markdown_documents(spark):
    md = lambda rows, m=True: sink.markdown(pages(spark, rows), m).first().markdown
    head = "**Source**: s.png\n**Pages**: 1\n**Time**: 2024-01-02 03:04:05\n\n---\n\n"
    assert md([(1, "hi", None)]) == head + "hi"
    assert md([(1, "hi", None), (2, "", None)], False) == "## Page 1\n\nhi\n\n## Page 2\n\n*(No text recognized)*\n"
    assert md([(1, "hi", "doc")], False) == "## Document Text\n\ndoc\n\n## Image 1\n\nhi\n"
    assert sink.all_text(pages(spark, [(2, "b", "doc"), (1, "a", "doc"), (3, "", "doc")])).first().text == "doc\n\na\n\nb"
    got = json.loads(sink.as_json(pages(spark, [(1, "é", None)]), boxes(spark, GRID[:1]).withColumn("page_no", F.lit(1))).first().json)
    assert got["pages"][0]["text"] == "é" and got["pages"][0]["details"][0]["bbox"] == [0.1, 0.8, 0.1, 0.05] and "docx_text" not in got
    with pytest.raises(ValueError):
        sink.format_pages(pages(spark, [(1, "a", None)]), "pdf")


def test_output_files(spark, tmp_path):
    o = spark.createDataFrame([(1, "a/x.png", "one"), (2, "b/x.png", "two"), (3, "http://h/y.png?z=1", "three")], "doc_id long, source string, output string")
    placed = sink.output_paths(o, "text", folder=str(tmp_path / "out"))
    assert sink.write_files(placed).count() == 3
    assert (tmp_path / "out" / "x.txt").read_text() == "one" and (tmp_path / "out" / "x-2.txt").read_text() == "two"
    auto = {r.doc_id: r.out_path for r in sink.output_paths(o, "json", stamp="T").collect()}
    assert auto == {1: "a/x_leafmill_T.json", 2: "b/x_leafmill_T.json", 3: "y.png_leafmill_T.json"}
    assert sink.combined(o, "doc_id").first().output == "one\n\n---\n\ntwo\n\n---\n\nthree"


def test_batch_keeps_order_and_errors(spark):
    inputs = spark.createDataFrame([(0, "c"), (1, "a"), (2, "b")], "input_idx int, path string")
    results = spark.createDataFrame([("a", "A", None), ("c", None, "boom")], "path string, output string, error string")
    got = pipelines.batch(results, inputs).collect()
    assert [(r.path, r.output, r.error) for r in got] == [("c", None, "boom"), ("a", "A", None), ("b", None, "no result")]


def test_assemble_and_region_text(spark):
    whole = boxes(spark, [("w", None, [0.1, 0.2, 0.3, 0.1])])
    at = spark.createDataFrame([(2, 0, 1, 100.0, 50.0)], "doc_id long, region_index int, place int, x double, y double")
    regional = spark.createDataFrame([(2, 0, 0, "r", 1.0, 5.0, 6.0, 7.0, 8.0)], "doc_id long, region_index int, box_no long, text string, confidence double, x double, y double, w double, h double")
    got = {r.branch: r for r in pipelines.assemble(whole, regional=regional, regions=at).collect()}
    assert got["whole"].y == pytest.approx(0.7) and (got["regions"].x, got["regions"].y) == (105.0, 56.0)
    r = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "b"), (2, 0, 0, "c")], "doc_id long, place int, box_no long, text string")
    assert {x.doc_id: x.text for x in pipelines.region_text(r).collect()} == {1: "--- 区域 1 ---\na\n\n--- 区域 2 ---\nb", 2: "c"}
    with pytest.raises(ValueError):
        pipelines.Options(regions="maybe")


def test_stream(spark, tmp_path):
    from leafmill.streaming.files import arriving_boxes, write_pages

    b = boxes(spark, [("one", 1.0, [0.1, 0.1, 0.8, 0.03]), ("two", 1.0, [0.1, 0.5, 0.8, 0.03])]).withColumn("page_no", F.lit(1))
    b.write.parquet(str(tmp_path / "in"))
    write_pages(arriving_boxes(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().markdown == "one\n\ntwo\n"


def test_empty_inputs(spark):
    none = boxes(spark, [])
    assert layout.format_with_layout(none).count() == 0
    assert coordinates.deduplicate(none).count() == 0
    assert coordinates.merge_to_text(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_folds_against_plain_python(spark, seed):
    """Survivors of the two greedy folds, by a direct quadratic walk."""
    rng = random.Random(seed)
    rows = [("".join(rng.choice("ab") for _ in range(3)), rng.randint(0, 3) / 4, [rng.randint(0, 3) / 20, rng.randint(0, 20) / 100, 0.2, 0.03]) for _ in range(60)]
    order = sorted(range(60), key=lambda i: (rows[i][2][1], rows[i][2][0], i))
    gone: set[int] = set()
    for a, i in enumerate(order):
        if i in gone:
            continue
        for j in order[a + 1 :]:
            (t, c, b), (u, d, e) = rows[i], rows[j]
            if j in gone or e[1] - (b[1] + b[3]) > 0.02:
                continue
            wide, tall = min(b[0] + b[2], e[0] + e[2]) - max(b[0], e[0]), min(b[1] + b[3], e[1] + e[3]) - max(b[1], e[1])
            s = 1.0 if t == u else len(set(t) & set(u)) / len(set(t) | set(u))
            if wide > 0 and tall > 0 and wide * tall / min(b[2] * b[3], e[2] * e[3]) > 0.5 and s > 0.8:
                if d > c:
                    gone.add(i)
                    break
                gone.add(j)
    got = {r.box_no for r in coordinates.deduplicate(boxes(spark, rows)).collect()}
    assert got == set(range(60)) - gone


def test_measured_pictures_are_spread_over_all_cores(spark):
    """A small table of keys doesn't make one task of all the pictures."""
    assert QUERIES["j_measures"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_matched_is_what_difflib_matches():
    """Short and long texts (frequent characters begin no block from 200 on), near copies, few letters."""
    from difflib import SequenceMatcher

    from leafmill.functions.text import matched

    r = random.Random(3)
    made = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    pairs = [(made(ab, r.randrange(300)), made(ab, r.randrange(300))) for ab in ("a", "ab", "abc", "abcdefghij klmnop") for _ in range(40)]
    pairs += [(a, a[:k] + "xyz" + a[k + 2 :]) for a, _ in pairs[80:] for k in (0, 5, len(a) // 2)]
    pairs += [(a * 7, b * 9) for a, b in pairs[150:160]]
    for a, b in pairs:
        assert matched(a, b) == sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks()), (a, b)


def test_few_texts_are_python_strings_at_a_time(spark, monkeypatch):
    """Cleaning takes its batch in pieces: never more than PIECE texts are asked for at once, and all come back in order."""
    import pyarrow as pa

    texts = [None if i % 97 == 0 else f"line {i}\nline {i}\n" for i in range(3 * cleaner.PIECE + 1)]
    asked = []

    class Watched:
        def __init__(self, a):
            self.a = a

        def __len__(self):
            return len(self.a)

        def slice(self, at, n):
            asked.append(len(self.a.slice(at, n)))
            return self.a.slice(at, n)

    held = {}
    monkeypatch.setattr(cleaner.F, "arrow_udf", lambda kind: lambda f: lambda c: held.setdefault("f", f))
    cleaner.fold_lines(None)
    got = held["f"](Watched(pa.array(texts))).to_pylist()
    assert got == [None if t is None else cleaner.folded(t) for t in texts]
    assert max(asked) == cleaner.PIECE and sum(asked) == len(texts)
    assert held["f"](pa.array([], pa.string())).to_pylist() == []


def _random_boxes(spark, kind, seed):
    """Pages on a grid, pages about the tolerances, pages with equal places and with boxes without one."""
    r = random.Random(seed)
    out = []
    for doc in range(120):
        loose, unit = r.choice([20, 60, 140, 400]), 1 if kind == "long" else 0.0001
        for n in range(r.randrange(1, 40)):
            x, y = 2000 * r.randrange(4) + r.randrange(loose), 600 * r.randrange(6) + r.randrange(loose)
            x, y, w, h = (v * unit for v in (x, y, 800, 300))
            if doc % 10 == 0 and r.random() < 0.1:
                x, y, h = r.choice([(None, y, h), (x, None, h), (x, y, None)])
            out.append((None if doc == 7 else doc, n // 2 if doc % 9 == 0 else n, r.choice(["a", "b", None]), x, y, w, h))
    return spark.createDataFrame(out, f"doc_id long, box_no long, text string, x {kind}, y {kind}, w {kind}, h {kind}")


@pytest.mark.parametrize("kind", ["long", "double"])
def test_many_pages_at_once_are_as_each_page_by_itself(spark, monkeypatch, kind):
    boxes = _random_boxes(spark, kind, 5).repartition(3).cache()
    at = (150, 250) if kind == "long" else (0.015, 0.025)
    made = {
        "rows": lambda: tables.rows(boxes, at[0], top_origin=True), "columns": lambda: tables.columns(boxes, *at, top_origin=True), "low": lambda: tables.columns(boxes, *at, alignment=0.2),
        "tables": lambda: tables.tables(boxes, *at, top_origin=True), "wide": lambda: tables.tables(boxes, *at, alignment=0.2), "single": lambda: tables.tables(boxes, *at, min_rows=1, min_cols=1),
    }
    take = lambda f: sorted(map(repr, f().collect()))
    fast = {k: take(f) for k, f in made.items()}
    monkeypatch.setattr(tables, "AWAY", float("inf"))  # every page by itself
    for k, f in made.items():
        assert fast[k] and fast[k] == take(f), k


def test_clean_pages_take_the_short_way(spark, monkeypatch):
    def long_way(*_):
        raise AssertionError("a page by itself")

    monkeypatch.setattr(tables, "_row_numbers", long_way)
    boxes = spark.createDataFrame([(d, 2 * r + c, "t", 2000 * c, 600 * r, 800, 300) for d in range(5) for r in range(3) for c in range(2)], "doc_id long, box_no long, text string, x long, y long, w long, h long")
    assert tables.rows(boxes, 150, top_origin=True).filter("row_no = box_no div 2").count() == 30
    assert [(r.n_rows, r.n_cols, len(r.cells)) for r in tables.tables(boxes, 150, 250, top_origin=True).collect()] == [(3, 2, 6)] * 5


def test_overlaps_are_looked_for_only_where_one_may_be(spark):
    r = random.Random(9)
    made = lambda n: "".join(r.choice("ab") for _ in range(n))
    pairs = [(made(r.randrange(40)), made(r.randrange(40))) for _ in range(100)] + [(x + y, y + x) for x, y in [(made(200), made(n)) for n in (5, 10, 99, 100, 101)]] + [(None, "a"), ("a", None)]
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", overlap_length(F.col("a"), F.col("b")).alias("n")).collect()
    want = lambda a, b: next((n for n in range(10, min(len(a), len(b), 100) + 1) if a[-n:] == b[:n]), 0) if a is not None and b is not None else 0
    assert [x.n for x in sorted(got)] == [want(*p) for p in pairs]
    assert "contains" in str(overlap_length(F.col("a"), F.col("b"))).lower()
