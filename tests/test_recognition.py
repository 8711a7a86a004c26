"""Pictures to documents over stand-ins for a recogniser."""

from __future__ import annotations

import numpy as np
import pytest

from leafmill.operators import images, regions
from leafmill.plans import recognition
from leafmill.plans.fixtures import read_bands
from leafmill.plans.pipelines import Options

PICTURES = "doc_id long, height int, width int, nChannels int, data binary"


def banded(bands, width=8):
    return np.repeat(np.arange(1, bands + 1, dtype=np.uint8), 100)[:, None].repeat(width, 1)


def pictures(spark, *arrays):
    return spark.createDataFrame([(i, a.shape[0], a.shape[1], 1 if a.ndim == 2 else a.shape[2], (a if a.ndim == 2 else a[:, :, ::-1]).tobytes()) for i, a in enumerate(arrays)], PICTURES)


def test_adaptive_reads_slices_once(spark):
    got = {r.doc_id: r for r in recognition.adaptive(recognition.profiled(pictures(spark, banded(3), banded(55))), read_bands, preprocess=False).collect()}
    assert got[0].text == "b0\nb1\nb2" and got[0].processing_info.slice_count == 0
    assert got[1].text == "\n".join(f"b{i}" for i in range(55)) and got[1].processing_info.slice_count >= 2
    assert [b.box_no for b in got[1].boxes] == list(range(55)) and got[1].error is None


def test_adaptive_by_regions(spark):
    a = np.full((400, 600, 3), 255, np.uint8)
    a[40:160, 40:240] = (200, 0, 0)
    a[40:160, 340:560] = (0, 200, 0)
    a[240:360, 40:560] = (0, 0, 200)
    colors = {(200, 0, 0): "red", (0, 200, 0): "green", (0, 0, 200): "blue"}

    def read(p):
        return [(name, None, 0.1, 0.1, 0.8, 0.8) for c, name in colors.items() if tuple(p[p.shape[0] // 2, p.shape[1] // 2]) == c]

    got = recognition.adaptive(recognition.profiled(pictures(spark, a)), read, Options(regions="on"), preprocess=False).first()
    assert got.processing_info.region_count == 3
    assert got.text == "--- 区域 1 ---\nred\n\n--- 区域 2 ---\ngreen\n\n--- 区域 3 ---\nblue"
    assert [b.confidence for b in got.boxes] == [1.0] * 3


def test_failures_are_values_and_fall_back(spark):
    """A recogniser that fails on slices reads the picture whole in the end; one that fails always leaves its error."""

    def read(a):
        if a.shape[1] == 16 or a.shape[0] in (4000, 5000):
            raise RuntimeError("can't")
        return read_bands(a)

    got = {r.doc_id: r for r in recognition.with_fallback(pictures(spark, banded(2), banded(2, 16), banded(55)), read, preprocess=False).collect()}
    assert (got[0].way, got[0].error) == ("smart", None)
    assert got[1].way == "basic" and "can't" in got[1].error
    assert (got[2].way, got[2].error) == ("basic", None) and got[2].text == "\n".join(f"b{i}" for i in range(55))


def test_smart_tries_again_and_keeps_the_best(spark):
    good = "一句很完整的话在这里结束了。" * 90

    def read(a):
        return [(good, 1.0, 0.0, 0.5, 1.0, 0.3)] * 1 if a.shape[0] < 300 else [("x", 0.1, 0.0, 0.5, 1.0, 0.3)]

    got = {r.doc_id: r for r in recognition.smart(recognition.profiled(pictures(spark, banded(2, 300), banded(5, 300))), read, preprocess=False).collect()}
    assert (got[0].strategy, got[0].attempts) == ("simple", 1) and got[0].quality_score >= 0.6
    assert got[1].attempts == 2 and got[1].quality_score < 0.6


def test_process_inputs(spark, tmp_path):
    import io
    import zipfile

    (tmp_path / "a.png").write_bytes(b"2")
    (tmp_path / "bad.png").write_bytes(b"?")
    (tmp_path / "t.pdf").write_bytes(b"1,2")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>hello</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(z.getvalue())
    paths = [tmp_path / "a.png", tmp_path / "bad.png", tmp_path / "t.pdf", tmp_path / "d.docx", tmp_path / "x.zip", tmp_path / "gone.png", "http://h/q.png"]
    inputs = spark.createDataFrame([(i, str(p)) for i, p in enumerate(paths)], "input_idx long, path string")
    got = recognition.process_inputs(
        spark, inputs, read_bands, lambda d: banded(int(d)), get=lambda u: b"3", options=Options(output_format="text", clean=False), way="adaptive", pdf=lambda d: d.split(b","), preprocess=False,
    ).collect()
    assert [r.input_idx for r in got] == list(range(7))
    assert [r.output for r in got] == ["b0\nb1", None, "b0\n\nb0\nb1", "hello", None, None, "b0\nb1\nb2"]
    assert [bool(r.error) for r in got] == [False, True, False, False, True, True, False]


def test_find_and_arrange_boxes():
    a = np.full((200, 300), 250, np.uint8)
    a[16:96, 160:280] = 0
    a[24:88, 16:120] = 0
    a[120:184, 40:240] = 0
    a[184:192, 288:296] = 0
    found = images.find_boxes(a)
    assert (160, 16, 120, 80) in found and len(found) == 4
    assert regions.arranged(found, 300, 200) == [(16, 24, 104, 64), (160, 16, 120, 80), (40, 120, 200, 64)]
    assert regions.arranged([], 300, 200) == [(0, 0, 300, 200)]
    assert images.find_boxes(np.zeros((3, 3), np.uint8)) == []


def test_shrunk_pictures_take_all_pixels():
    rng = np.random.default_rng(0)
    for shape in ((7, 11), (8, 5, 3), (4, 4)):
        a = rng.integers(0, 256, shape).astype(np.uint8)
        got = images.shrink(a, 4)
        k = -(-max(shape[:2]) // 4)
        want = [[np.rint(a[y : y + k, x : x + k].reshape(-1, *shape[2:]).mean(axis=0)) for x in range(0, shape[1], k)] for y in range(0, shape[0], k)]
        assert np.array_equal(got, np.array(want).astype(np.uint8))


def test_pixel_operations():
    a = np.tile(np.arange(0, 200, 10, dtype=np.uint8), (20, 1))
    assert images.resize(a, 2).shape == (40, 40) and images.resize(a, 1.0).tolist() == a.tolist()
    assert images.resize(np.full((5, 7, 3), 9, np.uint8), 1.5).max() == 9
    flat = np.full((9, 9), 77, np.uint8)
    assert (images.sharpen(flat) == 77).all() and (images.raise_contrast(flat) == 77).all() and (images.rotate(flat, 0) == 77).all()
    edge = np.zeros((9, 9), np.uint8)
    edge[:, 5:] = 100
    assert images.sharpen(edge)[4, 5] > 100 and images.raise_contrast(edge).max() > 100
    lines = np.full((120, 120), 255, np.uint8)
    lines[20:100:16, 10:110] = 0
    assert abs(images.skew(images.rotate(lines, 2.0)) + 2.0) <= 0.5 and images.skew(lines) == 0.0
    assert images.rotate(np.arange(9, dtype=np.uint8).reshape(3, 3), 90).tolist() == [[2, 5, 8], [1, 4, 7], [0, 3, 6]]


@pytest.mark.parametrize(("tag", "want"), [(0x010F, True), (0x0110, True), (0x0132, False)])
def test_camera_mark(tag, want):
    for order, mark in (("little", b"II"), ("big", b"MM")):
        block = mark + (42).to_bytes(2, order) + (8).to_bytes(4, order) + (1).to_bytes(2, order) + tag.to_bytes(2, order) + bytes(10)
        body = b"Exif\0\0" + block
        data = b"\xff\xd8\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xda"
        assert images.camera_mark(data) is want
    assert not images.camera_mark(b"") and not images.camera_mark(b"\xff\xd8\xff")


def test_command_line(spark, tmp_path, capsys):
    from leafmill.__main__ import run

    (tmp_path / "in").mkdir()
    for name, data in (("a.png", b"2"), ("b.png", b"3"), ("c.png", b"?"), ("no.xyz", b"1")):
        (tmp_path / "in" / name).write_bytes(data)
    how = ["--recogniser", "tests.stand_ins:recognise", "--decoder", "tests.stand_ins:decode", "--way", "basic", "-f", "text"]
    assert run(spark, [str(tmp_path / "in"), "-o", str(tmp_path / "out"), *how]) == 1
    assert (tmp_path / "out" / "a.txt").read_text() == "b0\nb1" and (tmp_path / "out" / "b.txt").read_text() == "b0\nb1\nb2"
    assert not (tmp_path / "out" / "c.txt").exists() and "2 written, 1 failed" in capsys.readouterr().out
    assert run(spark, [str(tmp_path / "in" / "b.png"), str(tmp_path / "in" / "a.png"), *how]) == 0
    assert capsys.readouterr().out.split("\n")[0].startswith("--- [1/2] ") and True
    with pytest.raises(SystemExit):
        run(spark, how)


def test_small_parts_have_callers(spark):
    from pyspark.sql import functions as F

    from leafmill.operators import layout, quality
    from leafmill.plans import pipelines
    from leafmill.sinks import documents as sink
    from leafmill.sources.boxes import explode_tokens

    b = spark.createDataFrame([(1, 0, "T", 1.0, 0.1, 0.1, 0.3, 0.06), (1, 1, "body text", 1.0, 0.1, 0.4, 0.8, 0.03)], "doc_id long, box_no long, text string, confidence double, x double, y double, w double, h double")
    assert layout.average_height(b).first().avg_h == pytest.approx(0.045)
    assert pipelines.layout_text(b, clean=False).first().text == "### T\n\nbody text\n"
    assert pipelines.layout_text(b).first().text == "### T\n\nbody text\n"
    scored = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.9)], "doc_id long, attempt int, quality_score double")
    assert [(r.attempt, r.place) for r in quality.ranked_attempts(scored).orderBy("place").collect()] == [(1, 1), (0, 2)]
    child = "array<struct<text:string,x:double,y:double,w:double,h:double>>"
    lines = spark.createDataFrame([(1, 0, "a b", [("a", 0.0, 0.0, 0.1, 0.1), ("b", 0.2, 0.0, 0.1, 0.1)]), (1, 1, "c", [("c", 0.0, 0.5, 0.1, 0.1)])], f"doc_id long, line_no int, text string, children {child}")
    assert [(r.box_no, r.text, r.confidence) for r in explode_tokens(lines).orderBy("box_no").collect()] == [(0, "a", 1.0), (1, "b", 1.0), (2, "c", 1.0)]
    assert explode_tokens(lines, "line").select("text", "confidence").orderBy("line_no").first().text == "a b"
    page = lambda n, t: spark.createDataFrame([(1, "s", n, t, None)], "doc_id long, source string, page_no int, text string, docx_text string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert sink.all_text(sink.add_page(page(1, "one"), page(2, "two"))).first().text == "one\n\ntwo"
    grid = [("A1", 0.1, 0.1), ("A2", 0.3, 0.1), ("B1", 0.1, 0.3), ("B2", 0.3, 0.3)]
    t = spark.createDataFrame([(1, i, s, 1.0, x, y, 0.1, 0.05) for i, (s, x, y) in enumerate(grid)], b.schema)
    assert pipelines.detected_tables(t).first().markdown == "| A1 | A2 |\n| --- | --- |\n| B1 | B2 |"


def test_pages_of_a_tall_picture(spark):
    got = [(r.doc_id, r.page_no, r.text.split("\n")) for r in recognition.by_page(pictures(spark, banded(3), banded(120)), read_bands).orderBy("doc_id", "page_no").collect()]
    assert got == [(0, 1, ["b0", "b1", "b2"]), (1, 1, [f"b{i}" for i in range(100)]), (1, 2, [f"b{i}" for i in range(95, 120)])]


def test_frames_local_contrast_and_vivid_colours(spark):
    a = np.full((10, 20), 200, np.uint8)
    b = spark.createDataFrame([(0, 0.1, 0.2, 0.5, 0.4), (0, None, 0.2, 0.5, 0.4), (0, 5.0, 5.0, 1.0, 1.0)], "doc_id long, x double, y double, w double, h double")
    got = images.annotate(pictures(spark, a, a), b).orderBy("doc_id").collect()
    p = images.pixels(*got[0][1:])
    red = (p == (255, 0, 0)).all(axis=2)
    want = np.zeros((10, 20), bool)
    want[4:9, 2:13] = True
    want[5:8, 3:12] = False
    assert (red == want).all() and (images.pixels(*got[1][1:]) == 200).all()
    ramp = np.tile(np.linspace(100, 130, 64).astype(np.uint8), (64, 1))
    assert int(np.ptp(images.local_contrast(ramp, 2, 4.0))) > 60 and images.local_contrast(np.full((9, 9, 3), 8, np.uint8)).shape == (9, 9, 3)
    c = np.zeros((4, 4, 4), np.uint8) + np.array([180, 120, 120, 77], np.uint8)
    v = images.vivid(c)
    assert v[0, 0, 0] > 180 and v[0, 0, 1] < 120 and (v[:, :, 3] == 77).all() and images.vivid(c[:, :, 0]).shape == (4, 4)


def test_edges(spark):
    from pyspark.sql import functions as F

    from leafmill.functions.geometry import box, edges

    r = spark.createDataFrame([(0.1, 0.2, 0.3, 0.4)], "x double, y double, w double, h double").select(edges(box()).alias("e")).select(F.round("e.top", 9), "e.bottom").first()
    assert tuple(r) == (0.6, 0.2)


def test_pictures_are_read_once_and_by_all_cores(spark, tmp_path):
    """Each picture is measured and read once, and a small table of keys doesn't make one task of them."""
    from leafmill.plans import fixtures as fx

    made = fx.banded_pictures(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    count = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            count.add(b.num_rows)
            yield b

    pictures = recognition.profiled(made.limit(20))
    pictures = pictures.mapInArrow(counted, pictures.schema)
    assert recognition.adaptive(pictures, fx.read_bands, preprocess=False).count() == 20
    assert count.value == 20
