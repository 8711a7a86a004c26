"""Registered queries over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import geometry as geo
from leafmill.functions import paths
from leafmill.functions.text import character_similarity, ends_sentence, goes_on, is_han, line_relation, list_item_title, overlap_length, sequence_ratio, starts_paragraph
from leafmill.operators import cleaner, coordinates, images, layout, quality, regions, slicing, tables
from leafmill.plans import fixtures as fx
from leafmill.plans import pipelines, recognition
from leafmill.sinks import documents as sink
from leafmill.sources.boxes import page_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# sources


@query("""
WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN url || '/f.PDF?x=1' WHEN 2 THEN '/data/' || md5(url) || '.Pdf' WHEN 3 THEN '/data/' || md5(url) || '/.png' WHEN 4 THEN '/data/' || md5(url) || '.JPeg' ELSE url || '/p.docx#f' END AS path FROM pages)
SELECT page_id, regexp_matches(path, '(?i)^https?:') AS is_url, coalesce(list_contains(['png','jpg','jpeg','gif','bmp','tiff','tif','webp'], regexp_extract(lower(path), '[^/.][^/]*\\.([^./]+)$', 1)), false) AS is_image,
       CASE WHEN regexp_matches(path, '(?i)^https?:') THEN 'url' WHEN lower(path) LIKE '%.pdf' THEN 'pdf' WHEN lower(path) LIKE '%.docx' THEN 'docx'
            WHEN list_contains(['png','jpg','jpeg','gif','bmp','tiff','tif','webp'], regexp_extract(lower(path), '[^/.][^/]*\\.([^./]+)$', 1)) THEN 'image' ELSE 'unknown' END AS kind,
       CASE WHEN lower(regexp_extract(path, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) LIKE '%.pdf' THEN 'pdf' WHEN lower(regexp_extract(path, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) LIKE '%.docx' THEN 'docx' ELSE 'image' END AS url_type
FROM p""")
def a_input_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, url = F.col("page_id") % 6, F.col("url")
    path = (
        F.when(k == 0, url).when(k == 1, F.concat(url, F.lit("/f.PDF?x=1"))).when(k == 2, F.concat(F.lit("/data/"), F.md5("url"), F.lit(".Pdf")))
        .when(k == 3, F.concat(F.lit("/data/"), F.md5("url"), F.lit("/.png"))).when(k == 4, F.concat(F.lit("/data/"), F.md5("url"), F.lit(".JPeg"))).otherwise(F.concat(url, F.lit("/p.docx#f")))
    )
    p = fx.table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    c = F.col("path")
    kind = F.when(c.startswith("/"), "image").otherwise(paths.url_file_type(c))
    return p.select("page_id", paths.is_url(c).alias("is_url"), paths.is_image(c).alias("is_image"), paths.input_type(c).alias("kind"), kind.alias("url_type"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def a_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = fx.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("box_no"), "text")
    return page_text(turns, "conv_id")


# sinks


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    intro = F.when(F.col("conv_id") % 5 == 0, F.lit("intro"))
    return fx.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.concat(F.lit("conv/"), (F.col("conv_id") % 50).cast("string"), F.lit(".png")).alias("source"), (F.col("turn") + 1).cast("int").alias("page_no"),
        "text", intro.alias("docx_text"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("ts"),
    )


_PAGES = """
pages_ AS (
  SELECT conv_id AS doc_id, 'conv/' || (conv_id % 50)::VARCHAR || '.png' AS source, turn + 1 AS page_no, text, CASE WHEN conv_id % 5 = 0 THEN 'intro' END AS docx
  FROM conversations),
docs AS (SELECT doc_id, first(source) AS source, count(*) AS n, max(docx) AS docx, list({'page_no': page_no, 'text': text} ORDER BY page_no, text) AS pages FROM pages_ GROUP BY doc_id)"""


@query(f"""WITH {_PAGES}
SELECT doc_id, '**Source**: ' || source || chr(10) || '**Pages**: ' || n || chr(10) || '**Time**: 2024-01-02 03:04:05' || chr(10) || chr(10) || '---' || chr(10)
  || CASE WHEN n = 1 AND docx IS NULL THEN CASE WHEN pages[1].text <> '' THEN chr(10) || pages[1].text ELSE '' END
     ELSE CASE WHEN docx IS NOT NULL THEN chr(10) || '## Document Text' || chr(10) || chr(10) || docx || chr(10) ELSE '' END
       || list_aggregate(list_transform(pages, lambda p: chr(10) || CASE WHEN docx IS NULL THEN '## Page ' ELSE '## Image ' END || p.page_no || chr(10) || chr(10) || CASE WHEN p.text = '' THEN '*(No text recognized)*' ELSE p.text END || chr(10)), 'string_agg', '') END AS markdown
FROM docs""")
def b_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.markdown(_pages(spark, sf_dir))


@query(f"""WITH {_PAGES}
SELECT doc_id, array_to_string(list_concat(CASE WHEN docx IS NULL THEN [] ELSE [docx] END, list_filter(list_transform(pages, lambda p: p.text), lambda t: t <> '')), chr(10) || chr(10)) AS text FROM docs""")
def b_all_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.all_text(_pages(spark, sf_dir))


@query(f"""WITH {_PAGES}
SELECT doc_id, '{{"source":' || to_json(source) || ',"timestamp":"2024-01-02T03:04:05","total_pages":' || n || CASE WHEN docx IS NULL THEN '' ELSE ',"docx_text":"intro"' END
  || ',"pages":[' || list_aggregate(list_transform(pages, lambda p: '{{"page_num":' || p.page_no || ',"text":' || to_json(p.text) || '}}'), 'string_agg', ',') || ']}}' AS json FROM docs""")
def b_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.as_json(_pages(spark, sf_dir))


@query(f"""WITH {_PAGES}, n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM docs)
SELECT doc_id, 'out/' || regexp_extract(source, '/(.*)\\.png', 1) || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.md' AS out_path FROM n""")
def b_output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _pages(spark, sf_dir).groupBy("doc_id").agg(F.first("source").alias("source"))
    return sink.output_paths(docs, "markdown", folder="out").select("doc_id", "out_path")


# geometry and text expressions


@query(f"""WITH {fx.OCR_LINES},
r AS (SELECT doc_id, box_no, x / 10000.0::DOUBLE AS x, 0.1::DOUBLE AS y, w / 10000.0::DOUBLE AS w, h / 10000.0::DOUBLE AS h, w * h AS area, greatest(0, w - 300) * greatest(0, h - 100) AS both_, w * (h + 200) AS area2 FROM ocr_lines)
SELECT doc_id, box_no, round(x * 1000, 6) AS x1, round((1 - y) * 2000 - h * 2000, 6) AS y1, round(x * 1000 + w * 1000, 6) AS x2, round((1 - y) * 2000, 6) AS y2, round(-h * 2000, 6) AS plot_h, round(1 - y - h, 6) AS flipped,
       round(y + h / 2, 6) AS center, CASE WHEN area > 0 THEN both_::DOUBLE / area ELSE 0 END AS overlap, CASE WHEN area > 0 THEN both_::DOUBLE / (area + area2 - both_) ELSE 0 END AS iou, area > 0 AND both_ * 5 >= area * 4 AS contained
FROM r""")
def c_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares are quotients of whole numbers, which both engines round alike."""
    lines = fx.ocr_lines(spark, sf_dir)
    unit = [F.col(c).cast("double") for c in ("x", "w", "h")]
    whole = (unit[0], F.lit(1000.0), unit[1], unit[2])
    moved = (whole[0] + 300, whole[1] + 100, whole[2], whole[3] + 200)
    a = (F.col("x") / 10000, F.lit(0.1), F.col("w") / 10000, F.col("h") / 10000)
    px, plot = geo.to_pixels(a, F.lit(1000), F.lit(2000)), geo.to_plot(a, F.lit(1000), F.lit(2000))
    rounded = {**{k: px[k] for k in ("x1", "y1", "x2", "y2")}, "plot_h": plot["h"], "flipped": geo.flip_y(a[1], a[3]), "center": geo.y_center(a)}
    return lines.select("doc_id", "box_no", *[F.round(v, 6).alias(k) for k, v in rounded.items()], geo.overlap(whole, moved).alias("overlap"), geo.iou(whole, moved).alias("iou"), geo.contained(whole, moved).alias("contained"))


_NEXT_LINE = """
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
two AS (SELECT doc_id, i, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM ln)"""


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, i, a, b): each line with the one after it. Pairs are made within a text's row, without an exchange."""
    lines = F.split("text", "\n", -1)
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", lines.alias("l")).filter(F.size("l") > 1)
    pairs = F.arrays_zip(F.slice("l", F.lit(1), F.size("l") - 1).alias("a"), F.slice("l", F.lit(2), F.size("l") - 1).alias("b"))
    return docs.select("doc_id", F.posexplode(pairs).alias("i", "p")).select("doc_id", F.col("i").cast("long"), F.col("p.a"), F.col("p.b"))


@query(f"""WITH {_NEXT_LINE},
s AS (SELECT doc_id, i, a, b, trim(a) AS s, trim(b) AS t FROM two WHERE b IS NOT NULL)
SELECT doc_id, i, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN s = t THEN 1.0 WHEN contains(s, t) OR contains(t, s) THEN 0.9
  ELSE round(len(list_intersect(list_distinct(string_split(s, '')), list_distinct(string_split(t, ''))))::DOUBLE / len(list_distinct(string_split(s || t, ''))), 6) END::DOUBLE AS similarity,
  coalesce(list_filter(range(10, least(length(a), length(b), 100) + 1), lambda n: right(a, n) = left(b, n))[1], 0)::INTEGER AS overlap
FROM s""")
def g_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("doc_id", "i", F.round(character_similarity(F.col("a"), F.col("b")), 6).alias("similarity"), overlap_length(F.col("a"), F.col("b")).cast("int").alias("overlap"))


@query()
def g_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("doc_id", "i", line_relation("a", "b").alias("relation"), F.round(sequence_ratio("a", "b"), 6).alias("ratio"))


@query(f"""WITH {fx.MARKED},
two AS (SELECT doc_id, i, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM marked)
SELECT doc_id, i, regexp_matches(a, '^[一-鿿]') AS han, list_contains(['。', '！', '？', '.', '!', '?'], right(a, 1)) AS ended,
       regexp_matches(a, '^\\d+\\.') OR regexp_matches(a, '^(【|#|所以|因此|但是|然而|首先|其次|最后|总之|例如|比如)') AS opens,
       regexp_full_match(a, '\\*\\*\\d+\\.\\*\\*\\s*.+') AND length(a) < 20 AS title,
       regexp_matches(a, '(，|、|：|；|"|（|的|是|和|与|在|了|为|对|向|被|把|让|给|从|到|以|因|但|而|或|及|筛|防|密|告)$') OR regexp_matches(b, '^("|）|。|！|？|选器|御|码|诉)')
         OR (length(a) < 5 AND NOT (regexp_matches(b, '^\\d+\\.') OR regexp_matches(b, '^(【|#|所以|因此|但是|然而|首先|其次|最后|总之|例如|比如)'))) OR length(b) < 3 AS joins
FROM two WHERE b IS NOT NULL""")
def g_line_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.marked_texts(spark, sf_dir).select("doc_id", F.split("text", "\n", -1).alias("l")).filter(F.size("l") > 1)
    pairs = F.arrays_zip(F.slice("l", F.lit(1), F.size("l") - 1).alias("a"), F.slice("l", F.lit(2), F.size("l") - 1).alias("b"))
    t = docs.select("doc_id", F.posexplode(pairs).alias("i", "p")).select("doc_id", F.col("i").cast("long"), F.col("p.a"), F.col("p.b"))
    a, b = F.col("a"), F.col("b")
    return t.select("doc_id", "i", is_han(a).alias("han"), ends_sentence(a).alias("ended"), starts_paragraph(a).alias("opens"), list_item_title(a).alias("title"), goes_on(a, b).alias("joins"))


# layout

_PARAS = f"""{fx.OCR_LINES},
pn0 AS (SELECT *, avg(h) OVER (PARTITION BY doc_id) AS avg_h, y - lag(y + h) OVER w AS gap, row_number() OVER w - 1 AS pos FROM ocr_lines WINDOW w AS (PARTITION BY doc_id ORDER BY y, box_no)),
pn AS (SELECT *, sum(CASE WHEN gap > avg_h * {{spacing}} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::INTEGER AS para_no FROM pn0),
paras AS (
  SELECT doc_id, para_no, count(*)::INTEGER AS n_lines, string_agg(text, chr(10) ORDER BY pos) AS text, min_by(x, pos) AS x, min(y) AS y, min_by(w, pos) AS w, min_by(h, pos) AS h, first(avg_h) AS avg_h
  FROM pn GROUP BY doc_id, para_no),
first_lines AS (SELECT *, trim(string_split(text, chr(10))[1]) AS f FROM paras),
marked_paras AS (
  SELECT *, CASE WHEN regexp_matches(f, '^【[^】]+】$') THEN 2 WHEN regexp_matches(f, '^[一二三四五六七八九十]+[、.]\\s*.') THEN 2 WHEN regexp_matches(f, '^\\d+[.、]\\s*.') THEN 3
    WHEN h > avg_h * 1.3 THEN CASE WHEN h >= avg_h * 2.0 THEN 1 WHEN h >= avg_h * 1.6 THEN 2 ELSE 3 END
    WHEN n_lines = 1 AND length(f) < 100 AND h > avg_h * 1.1 THEN 3 ELSE 0 END AS heading_level,
    CASE WHEN list_contains(['•', '-', '*', '▪', '◦'], left(f, 1)) THEN 'unordered' WHEN regexp_matches(f, '^\\s*\\d+[.)]\\s+') THEN 'ordered' END AS list_type
  FROM first_lines)"""


@query(f"WITH {_PARAS.replace('{spacing}', '1.5')} SELECT doc_id, para_no, n_lines, text, x, y, w, h FROM paras")
def f_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.paragraphs(fx.ocr_lines(spark, sf_dir)).drop("avg_h")


@query(f"WITH {_PARAS.replace('{spacing}', '1.5')} SELECT doc_id, para_no, heading_level, heading_level > 0 AS is_heading, list_type, list_type IS NOT NULL AS is_list FROM marked_paras")
def g_headings_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.analyze(fx.ocr_lines(spark, sf_dir)).select("doc_id", "para_no", "heading_level", "is_heading", "list_type", "is_list")


@query(f"""WITH {_PARAS.replace('{spacing}', '1.5')}
SELECT doc_id, round(first(avg_h), 6) AS avg_height, count(*) AS total_paragraphs, count(*) FILTER (heading_level > 0) AS headings, count(list_type) AS lists FROM marked_paras GROUP BY doc_id""")
def e_layout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.summary(layout.analyze(fx.ocr_lines(spark, sf_dir))).withColumn("avg_height", F.round("avg_height", 6))


@query(f"""WITH {_PARAS.replace('{spacing}', '1.8')}
SELECT doc_id, string_agg(CASE WHEN heading_level > 0 THEN repeat('#', heading_level) || ' ' ELSE '' END || text, chr(10) || chr(10) ORDER BY para_no) || chr(10) AS markdown FROM marked_paras GROUP BY doc_id""")
def g_layout_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.format_with_layout(fx.ocr_lines(spark, sf_dir))


# coordinates


@query(f"""WITH {fx.OCR_LINES}, {fx.SLICES},
one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, box_no ORDER BY conf DESC, slice_index) AS k FROM slice_boxes)
SELECT doc_id, box_no, slice_index::INTEGER AS slice_index, conf::DOUBLE AS confidence, y, h, (row_number() OVER (PARTITION BY doc_id ORDER BY y, x, box_no) - 1)::INTEGER AS place FROM one WHERE k = 1""")
def d_merge_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.ocr_lines(spark, sf_dir)
    cut = fx.slices(lines)
    merged = coordinates.merge_results(fx.slice_boxes(lines, cut), cut)
    units = lambda c: F.round(F.col(c) * F.col("ph")).cast("long").alias(c)
    return merged.select("doc_id", "box_no", "slice_index", "confidence", units("y"), units("h"), "place")


@query(f"""WITH {fx.TABLE_BOXES},
l AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS line_no FROM table_boxes),
g AS (SELECT *, x - lag(x + w) OVER (PARTITION BY doc_id, line_no ORDER BY x) > 1250 AS new FROM l)
SELECT doc_id, box_no, line_no::INTEGER AS line_no, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_no ORDER BY x ROWS UNBOUNDED PRECEDING)::INTEGER AS seg_no FROM g""")
def f_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordinates.segments(fx.table_boxes(spark, sf_dir), 100, 1250).select("doc_id", "box_no", "line_no", "seg_no")


@query(f"""WITH {fx.TABLE_BOXES},
l AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS line_no FROM table_boxes),
g AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_no ORDER BY x ROWS UNBOUNDED PRECEDING) AS seg
      FROM (SELECT *, x - lag(x + w) OVER (PARTITION BY doc_id, line_no ORDER BY x) > 1250 AS new FROM l)),
s AS (SELECT doc_id, line_no, seg, string_agg(text, ' ' ORDER BY x) AS t FROM g GROUP BY ALL)
SELECT doc_id, string_agg(t, chr(10) ORDER BY line_no, seg) AS text FROM s GROUP BY doc_id""")
def g_merged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordinates.merge_to_text(fx.table_boxes(spark, sf_dir), tolerance=100, gap=1250)


@query(f"WITH {fx.TABLE_BOXES} SELECT doc_id, box_no, (row_number() OVER (PARTITION BY doc_id ORDER BY y, x, box_no) - 1)::INTEGER AS place FROM table_boxes")
def i_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordinates.reading_order(fx.table_boxes(spark, sf_dir)).select("doc_id", "box_no", "place")


# tables

_CELLS = f"""{fx.TABLE_BOXES},
rw AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS row_no FROM table_boxes),
ch AS (SELECT doc_id, x, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY x, box_no ROWS UNBOUNDED PRECEDING) AS cl FROM (SELECT doc_id, box_no, x, x - lag(x) OVER (PARTITION BY doc_id ORDER BY x, box_no) > 250 AS new FROM rw)),
cen AS (SELECT doc_id, cl, avg(x) AS center FROM ch GROUP BY doc_id, cl),
nr AS (SELECT doc_id, count(DISTINCT row_no) AS n_rows FROM rw GROUP BY doc_id),
al AS (SELECT rw.doc_id, center, count(DISTINCT row_no) AS n FROM rw JOIN cen ON rw.doc_id = cen.doc_id AND abs(x - center) <= 250 GROUP BY rw.doc_id, center),
va AS (SELECT al.doc_id, center, n_rows, row_number() OVER (PARTITION BY al.doc_id ORDER BY center) - 1 AS idx, count(*) OVER (PARTITION BY al.doc_id) AS n_cols FROM al JOIN nr ON al.doc_id = nr.doc_id WHERE n / n_rows::DOUBLE >= 0.6),
pl AS (
  SELECT rw.*, idx, n_rows, n_cols, row_number() OVER (PARTITION BY rw.doc_id, box_no ORDER BY CASE WHEN abs(x - center) <= 250 THEN 0 ELSE 1 END, CASE WHEN abs(x - center) <= 250 THEN 0 ELSE abs(x - center) END, idx) AS k
  FROM rw JOIN va ON rw.doc_id = va.doc_id WHERE n_rows >= 2 AND n_cols >= 2),
ce AS (SELECT doc_id, row_no, idx, first(n_rows) AS n_rows, first(n_cols) AS n_cols, arg_max(text, (x, box_no)) AS text, max(x) AS x, arg_max(y, (x, box_no)) AS y FROM pl WHERE k = 1 GROUP BY doc_id, row_no, idx),
gr AS (
  SELECT s.doc_id, s.row_no, s.n_cols, list(coalesce(ce.text, '') ORDER BY c) AS texts, list(CASE WHEN ce.x IS NULL THEN 'null' ELSE '[' || ce.x || ',' || ce.y || ',800,300]' END ORDER BY c) AS boxes
  FROM (SELECT doc_id, row_no, n_cols, unnest(range(n_cols)) AS c FROM (SELECT DISTINCT doc_id, row_no, n_cols FROM ce)) s LEFT JOIN ce ON s.doc_id = ce.doc_id AND s.row_no = ce.row_no AND s.c = ce.idx
  GROUP BY s.doc_id, s.row_no, s.n_cols)"""


@query(f"WITH {fx.TABLE_BOXES} SELECT doc_id, box_no, (dense_rank() OVER (PARTITION BY doc_id ORDER BY r) - 1)::INTEGER AS row_no FROM table_boxes")
def f_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.rows(fx.table_boxes(spark, sf_dir), 150, top_origin=True).select("doc_id", "box_no", "row_no")


@query(f"WITH {_CELLS} SELECT doc_id, idx::INTEGER AS col, round(center, 6) AS center, n_rows::INTEGER AS n_rows FROM va")
def f_table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.columns(fx.table_boxes(spark, sf_dir), 150, 250, top_origin=True)
    return found.select("doc_id", F.posexplode("centers").alias("col", "center"), "n_rows").withColumn("center", F.round("center", 6))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tables(fx.table_boxes(spark, sf_dir), 150, 250, top_origin=True)


@query(f'WITH {_CELLS} SELECT doc_id, row_no::INTEGER AS "row", idx::INTEGER AS col, n_rows::INTEGER AS n_rows, n_cols::INTEGER AS n_cols, text, x, y FROM ce')
def d_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cells(fx.table_boxes(spark, sf_dir), 150, 250, top_origin=True).drop("w", "h")


@query(f"""WITH {_CELLS}
SELECT doc_id, string_agg('| ' || array_to_string(texts, ' | ') || ' |' || CASE WHEN row_no = 0 THEN chr(10) || '| ' || array_to_string(list_transform(texts, lambda t: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY row_no) AS markdown FROM gr GROUP BY doc_id""")
def b_table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.to_markdown(_tables(spark, sf_dir))


@query(f"""WITH {_CELLS}
SELECT doc_id, '<table>' || chr(10) || string_agg('  <tr>' || chr(10) || array_to_string(list_transform(texts, lambda t: CASE WHEN row_no = 0 THEN '    <th>' || t || '</th>' ELSE '    <td>' || t || '</td>' END), chr(10)) || chr(10) || '  </tr>', chr(10) ORDER BY row_no) || chr(10) || '</table>' AS html
FROM gr GROUP BY doc_id""")
def b_table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.to_html(_tables(spark, sf_dir))


@query(f"""WITH {_CELLS}
SELECT doc_id, '{{"rows":' || count(*) || ',"cols":' || first(n_cols) || ',"cells":[' || string_agg('[' || array_to_string(list_transform(list_zip(texts, boxes), lambda z: '{{"text":"' || z[1] || '","bbox":' || z[2] || '}}'), ',') || ']', ',' ORDER BY row_no) || ']}}' AS json
FROM gr GROUP BY doc_id""")
def b_table_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.to_json(_tables(spark, sf_dir))


# regions


@query(f"""WITH RECURSIVE {fx.REGIONS},
ok AS (SELECT * FROM regions WHERE w * h / 1000000.0 BETWEEN 0.02 AND 0.95 AND w / h::DOUBLE BETWEEN 0.1 AND 10 AND x + w <= 1000 AND y + h <= 1000),
srt AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w * h DESC, region_index) AS k FROM ok),
walk AS (
  SELECT doc_id, 0::BIGINT AS k, []::STRUCT(i INTEGER, x BIGINT, y BIGINT, w BIGINT, h BIGINT)[] AS kept FROM srt WHERE k = 1
  UNION ALL
  SELECT s.doc_id, s.k, CASE WHEN len(list_filter(kept, lambda p:
      greatest(0, least(p.x + p.w, s.x + s.w) - greatest(p.x, s.x)) * greatest(0, least(p.y + p.h, s.y + s.h) - greatest(p.y, s.y)) >= 0.8 * s.w * s.h
      OR greatest(0, least(p.x + p.w, s.x + s.w) - greatest(p.x, s.x)) * greatest(0, least(p.y + p.h, s.y + s.h) - greatest(p.y, s.y)) * 1.5 > 0.5 * (s.w * s.h + p.w * p.h))) > 0
    THEN kept ELSE list_append(kept, {{'i': s.region_index, 'x': s.x, 'y': s.y, 'w': s.w, 'h': s.h}}) END
  FROM walk JOIN srt s ON walk.doc_id = s.doc_id AND s.k = walk.k + 1),
fin AS (SELECT doc_id, unnest(arg_max(kept, k)) AS p FROM walk GROUP BY doc_id)
SELECT doc_id, p.i AS region_index FROM fin""")
def d_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.regions(spark, sf_dir).withColumns({"width": F.lit(1000), "height": F.lit(1000)})
    return regions.suppress(regions.plausible(r)).select("doc_id", "region_index")


@query(f"""WITH {fx.REGIONS},
a AS (SELECT *, y + h / 2.0 AS c FROM regions),
b AS (SELECT *, abs(c - lag(c) OVER o) >= 0.5 * lag(h) OVER o AS new, row_number() OVER o AS k FROM a WINDOW o AS (PARTITION BY doc_id ORDER BY c, region_index)),
r AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING)::INTEGER AS row_no FROM b)
SELECT doc_id, region_index, row_no, (row_number() OVER (PARTITION BY doc_id ORDER BY row_no, x, c, region_index) - 1)::INTEGER AS place FROM r""")
def f_region_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.reading_order(fx.regions(spark, sf_dir)).select("doc_id", "region_index", "row_no", "place")


# quality

_METRICS = """
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM src),
st AS (SELECT doc_id, line, trim(line) AS s, length(line) AS n FROM ln),
pl AS (
  SELECT doc_id, count(*) FILTER (s <> '') AS line_count, count(*) FILTER (length(s) >= 5) AS long_, count(DISTINCT s) FILTER (length(s) >= 5) AS differ,
         count(*) FILTER (s <> '' AND list_contains(['。', '！', '？', '.', '!', '?'], right(s, 1))) AS ended, sum(n) FILTER (s <> '') AS tot, sum(n * n) FILTER (s <> '') AS sq
  FROM st GROUP BY doc_id),
me AS (
  SELECT src.doc_id, length(replace(replace(src.text, chr(10), ''), ' ', '')) AS char_count, coalesce(line_count, 0) AS line_count, src.conf AS avg_confidence,
         CASE WHEN long_ > 0 THEN 1 - differ / long_::DOUBLE ELSE 0 END AS duplicate_ratio,
         CASE WHEN line_count > 0 THEN ended / line_count::DOUBLE * 0.6::DOUBLE + 0.4::DOUBLE * greatest(0, 1 - (sqrt((line_count * sq - tot * tot)::DOUBLE) / line_count) / (tot / line_count::DOUBLE + 1)) ELSE 0 END AS coherence_score,
         least(10, CASE WHEN contains(src.text, chr(10) || chr(10)) THEN 3 ELSE 0 END + CASE WHEN regexp_matches(src.text, '【|】|##|\\*\\*') THEN 3 ELSE 0 END
           + CASE WHEN regexp_matches(src.text, '1\\.|2\\.|•|-') THEN 2 ELSE 0 END + CASE WHEN src.n > 20 THEN 2 ELSE 0 END) / 10::DOUBLE AS structure_score
  FROM src LEFT JOIN pl ON src.doc_id = pl.doc_id),
sc AS (SELECT *, least(char_count / 1000::DOUBLE, 1) * 0.30::DOUBLE + avg_confidence * 0.20::DOUBLE + (1 - duplicate_ratio) * 0.20::DOUBLE + coherence_score * 0.15::DOUBLE + structure_score * 0.15::DOUBLE AS quality_score FROM me)"""


@query(f"""WITH {fx.OCR_LINES},
src AS (SELECT d.doc_id, d.text, avg(l.conf / 100::DOUBLE) AS conf, count(*) AS n FROM documents d JOIN ocr_lines l ON d.doc_id = l.doc_id GROUP BY ALL), {_METRICS}
SELECT doc_id, char_count::INTEGER AS char_count, line_count::INTEGER AS line_count, round(avg_confidence, 12) AS avg_confidence, round(duplicate_ratio, 12) AS duplicate_ratio, round(coherence_score, 12) AS coherence_score,
       round(structure_score, 12) AS structure_score, round(quality_score, 12) AS quality_score FROM sc""")
def e_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fx.ocr_lines(spark, sf_dir).select("doc_id", (F.col("conf") / 100).alias("confidence"))
    got = quality.metrics(fx.table(spark, sf_dir, "documents").select("doc_id", "text"), boxes)
    return got.select("doc_id", "char_count", "line_count", *[F.round(c, 12).alias(c) for c in ("avg_confidence", "duplicate_ratio", "coherence_score", "structure_score", "quality_score")])


@query("""WITH a AS (SELECT doc_id, k AS attempt, (doc_id * 37 + k * 41) % 100 / 100::DOUBLE AS q FROM documents, range(4) AS r(k) WHERE k <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN q >= 0.6 THEN 0 ELSE 1 END, CASE WHEN q >= 0.6 THEN 0 ELSE -q END, attempt) AS k FROM a)
SELECT doc_id, attempt::INTEGER AS attempt, q AS quality_score FROM r WHERE k = 1""")
def e_best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
    return quality.best_attempt(docs.withColumn("quality_score", (F.col("doc_id") * 37 + F.col("attempt") * 41) % 100 / 100))


@query(f"""WITH att AS (
  SELECT doc_id * 2 AS doc_id, text, 0.2::DOUBLE AS conf, 5 AS n FROM documents UNION ALL SELECT doc_id * 2 + 1, text || chr(10) || chr(10) || '## more', 0.5::DOUBLE, 30 FROM documents),
src AS (SELECT * FROM att), {_METRICS},
r AS (SELECT doc_id // 2 AS doc_id, doc_id % 2 AS attempt, quality_score AS q, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY CASE WHEN quality_score >= 0.6 THEN 0 ELSE 1 END, CASE WHEN quality_score >= 0.6 THEN 0 ELSE -quality_score END, doc_id) AS k FROM sc)
SELECT doc_id, attempt::INTEGER AS attempt, CASE attempt WHEN 0 THEN 'simple' ELSE 'article' END AS strategy, round(q, 12) AS quality_score FROM r WHERE k = 1""")
def k_smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = lambda df, k, s, c, n: df.withColumns({"attempt": F.lit(k), "strategy": F.lit(s), "avg_confidence": F.lit(c), "n_boxes": F.lit(n)})
    second = docs.withColumn("text", F.concat("text", F.lit("\n\n## more")))
    got = pipelines.smart(kind(docs, 0, "simple", 0.2, 5).unionByName(kind(second, 1, "article", 0.5, 30)))
    return got.select("doc_id", "attempt", "strategy", F.round("quality_score", 12).alias("quality_score"))


@query("""SELECT p_partkey::BIGINT AS doc_id, array_to_string(list_transform(range(2 + p_partkey % 60), lambda i: 'b' || i), chr(10)) AS text, (2 + p_partkey % 60) * 100 > 4000 AS sliced, 2 + p_partkey % 60 AS n_boxes FROM part""")
def k_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = recognition.adaptive(recognition.profiled(fx.banded_pictures(spark, sf_dir)), fx.read_bands, preprocess=False)
    return got.select("doc_id", "text", (F.col("processing_info.slice_count") > 0).alias("sliced"), F.size("boxes").cast("long").alias("n_boxes"))


# cleaning


@query()
def h_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaner.clean_text(fx.marked_texts(spark, sf_dir))


@query()
def h_clean_text_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaner.clean_text(fx.marked_texts(spark, sf_dir), variant="legacy")


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH {fx.MARKED},
l4 AS (SELECT doc_id, i, CASE WHEN regexp_full_match({_STRIP.format('line')}, '【(.+)】') THEN chr(10) || '## ' || regexp_extract({_STRIP.format('line')}, '^【(.+)】$', 1) || chr(10) ELSE line END AS line FROM marked),
p4 AS (SELECT doc_id, i, line, {_STRIP.format('line')} AS s, {_STRIP.format('lag(line) OVER (PARTITION BY doc_id ORDER BY i)')} AS b FROM l4),
e5 AS (
  SELECT doc_id, i, CASE WHEN regexp_full_match(s, '\\d+\\.[^\\s\\d].*') THEN list_concat(CASE WHEN b <> '' THEN [''] ELSE [] END, ['**' || regexp_extract(s, '^(\\d+)\\.', 1) || '.** ' || regexp_replace(s, '^\\d+\\.', '')]) ELSE [line] END AS es
  FROM p4),
l5 AS (SELECT doc_id, i, unnest(es) AS line, unnest(range(len(es))) AS k FROM e5),
p6 AS (SELECT doc_id, i, k, line, {_STRIP.format('line')} AS s, coalesce({_STRIP.format('lead(line) OVER (PARTITION BY doc_id ORDER BY i, k)')}, '') AS a FROM l5),
e6 AS (SELECT doc_id, i, k, CASE WHEN list_contains(['。', '！', '？'], right(s, 1)) AND length(a) > 15 AND NOT regexp_matches(a, '^[#*\\-\\d]') THEN [line, ''] ELSE [line] END AS es FROM p6),
l6 AS (SELECT doc_id, i, k, unnest(es) AS line, unnest(range(len(es))) AS j FROM e6),
p7 AS (SELECT doc_id, i, k, j, line, {_STRIP.format('line')} = '' AS e, coalesce({_STRIP.format('lag(line) OVER (PARTITION BY doc_id ORDER BY i, k, j)')} = '', false) AS pe FROM l6)
SELECT doc_id, string_agg(line, chr(10) ORDER BY i, k, j) AS text FROM p7 WHERE NOT (e AND pe) GROUP BY doc_id""")
def h_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaner.format_only(fx.marked_texts(spark, sf_dir))


# slices


_PLAN = f"""{fx.PROFILES},
pr AS (SELECT doc_id, height, CASE WHEN height <= 4000 THEN height WHEN code THEN 4000 ELSE 5000 END AS tall, CASE WHEN height <= 4000 THEN 0 WHEN content_type = 'table' THEN 600 ELSE 400 END AS over FROM profiles)"""


@query(f"""WITH {_PLAN},
own AS (SELECT doc_id, height, tall, CASE WHEN over = 0 THEN 400 ELSE over END AS over FROM pr),
n AS (SELECT *, CASE WHEN height <= tall THEN 1 ELSE greatest(1, ceil((height - over) / (tall - over)::DOUBLE)) END::BIGINT AS n FROM own),
s AS (SELECT *, unnest(range(n)) AS k FROM n)
SELECT doc_id, k::INTEGER AS slice_index, (k * (tall - over))::INTEGER AS y_start, least(k * (tall - over) + tall, height)::INTEGER AS y_end FROM s""")
def f_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.plan(images.recommend(fx.profiles(spark, sf_dir)))


@query(f"""WITH {fx.PROFILES},
c AS (SELECT doc_id, height, unnest(range(5000, greatest(height, 5000) + 1, 4600)) AS cut FROM profiles)
SELECT doc_id, cut::INTEGER AS cut FROM c WHERE cut < height UNION ALL SELECT doc_id, height FROM profiles""")
def f_fixed_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.fixed_cuts(fx.profiles(spark, sf_dir))


def _pixel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.profiles(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(20))).alias("z"))
    y = (F.col("z") / 20).cast("int")
    return p.select("doc_id", y.alias("y"), ((y * 7 + F.col("doc_id")) % 100 < 60).alias("blank"))


@query(f"""WITH {fx.PROFILES},
px AS (SELECT doc_id, unnest(range(0, (height - 1) // 20 + 1)) AS y FROM profiles),
b AS (SELECT doc_id, y, y - row_number() OVER (PARTITION BY doc_id ORDER BY y) AS g FROM px WHERE (y * 7 + doc_id) % 100 < 60),
r AS (SELECT doc_id, min(y) AS start, max(y) + 1 AS stop FROM b GROUP BY doc_id, g)
SELECT doc_id, start::INTEGER AS start, stop::INTEGER AS stop FROM r WHERE stop - start >= 5""")
def f_blank_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.blank_runs(_pixel_rows(spark, sf_dir))


@query()
def f_safe_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = fx.profiles(spark, sf_dir).select("doc_id", (F.col("height") / 20).cast("int").alias("height"))
    return slicing.safe_cuts(slicing.blank_runs(_pixel_rows(spark, sf_dir)), pictures, 200, 20)


# pictures


_PROFILE = f"""{fx.PROFILES},
rc AS (
  SELECT *, height / width::DOUBLE > 3 AS is_long, CASE WHEN sharp > 0.7 THEN 'digital' WHEN sharp < 0.4 THEN 'photo' ELSE 'unknown' END AS source, height > 4000 AS needs_slicing FROM profiles),
rec AS (SELECT *, multi AND NOT is_long AS many, contrast < 0.5 OR noise > 0.4 OR source = 'photo' AS prep FROM rc)"""


@query(f"""WITH {_PROFILE}
SELECT doc_id, source, is_long AS is_long_screenshot, many AS has_multiple_regions, many AS recommended_region_detection, needs_slicing, prep AS needs_preprocessing,
       CASE WHEN height <= 4000 THEN height WHEN code THEN 4000 ELSE 5000 END::INTEGER AS slice_height, CASE WHEN height <= 4000 THEN 0 WHEN content_type = 'table' THEN 600 ELSE 400 END::INTEGER AS overlap,
       CASE WHEN many THEN 'regions' WHEN needs_slicing THEN 'slices' ELSE 'whole' END AS branch,
       CASE WHEN is_long THEN 'article,simple' WHEN many THEN 'multi_doc,article,simple' WHEN height > 2000 OR width > 2000 THEN 'article,simple' ELSE 'simple,article' END AS strategies
FROM rec""")
def j_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pipelines.route(quality.strategies(images.recommend(fx.profiles(spark, sf_dir))))
    return got.select(
        "doc_id", "source", "is_long_screenshot", "has_multiple_regions", "recommended_region_detection", "needs_slicing", "needs_preprocessing", "slice_height", "overlap", "branch",
        F.array_join("strategies", ",").alias("strategies"),
    )


@query(f"""WITH {_PROFILE}
SELECT doc_id, round(CASE WHEN width < 1500 THEN least(1500 / width::DOUBLE, 2) ELSE 1 END, 6) AS scale,
  CASE WHEN source = 'photo' THEN 'gamma' || CASE WHEN contrast < 0.6 THEN ',color' ELSE '' END || CASE WHEN contrast < 0.7 THEN ',contrast' ELSE '' END || CASE WHEN noise > 0.3 THEN ',denoise' ELSE '' END || ',sharpen'
       WHEN contrast < 0.5 THEN 'color,contrast_0.8,sharpen_0.3' WHEN contrast < 0.7 THEN 'contrast_0.5' ELSE '' END AS steps
FROM rec""")
def j_preprocessing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = images.preprocessing_plan(images.recommend(fx.profiles(spark, sf_dir)))
    return got.select("doc_id", F.round("scale", 6).alias("scale"), F.array_join("steps", ",").alias("steps"))


@query("""WITH c AS (SELECT l_suppkey AS key, (l_quantity * 5)::INTEGER AS value, count(*) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER u AS n0, sum(n * value) OVER u AS s0, sum(n) OVER (PARTITION BY key) AS nn, sum(n * value) OVER (PARTITION BY key) AS ss FROM c WINDOW u AS (PARTITION BY key ORDER BY value)),
v AS (SELECT key, value, CASE WHEN n0 < nn THEN (ss::DOUBLE * n0::DOUBLE - s0::DOUBLE * nn::DOUBLE) * (ss::DOUBLE * n0::DOUBLE - s0::DOUBLE * nn::DOUBLE) / (n0::DOUBLE * (nn::DOUBLE - n0::DOUBLE)) ELSE 0 END AS b FROM s)
SELECT key, threshold FROM (SELECT key, value AS threshold, row_number() OVER (PARTITION BY key ORDER BY b DESC, value) AS k FROM v) WHERE k = 1""")
def e_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = fx.table(spark, sf_dir, "lineitem")
    counts = li.groupBy(F.col("l_suppkey").alias("key"), (F.col("l_quantity") * 5).cast("int").alias("value")).agg(F.count("*").alias("n"))
    return images.otsu_of_counts(counts)


@query("""SELECT l_suppkey AS key, (l_orderkey % 200) // 50 AS "by", (l_partkey % 200) // 50 AS bx, round(avg(l_quantity), 5) AS mean, round(stddev_pop(l_quantity), 5) AS sd, round(avg(l_quantity) * (1 + 0.5 * (stddev_pop(l_quantity) / 128 - 1)), 5) AS threshold
FROM lineitem GROUP BY 1, 2, 3""")
def e_block_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = fx.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_orderkey") % 200).alias("y"), (F.col("l_partkey") % 200).alias("x"), F.col("l_quantity").alias("v"))
    return images.block_statistics(li).select("key", "by", "bx", *[F.round(c, 5).alias(c) for c in ("mean", "sd", "threshold")])


@query()
def j_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small pictures whose pixels are functions of their number."""
    n = F.sequence(F.lit(0), F.lit(60 * 40 * 3 - 1))
    byte = lambda i: F.right(F.hex((i * (F.col("doc_id") % 7 + 1) + F.col("doc_id") * 31 + (i / 120).cast("int") * 50) % 256 + 256), F.lit(2))
    data = F.unhex(F.array_join(F.transform(n, byte), ""))
    p = fx.spread(fx.table(spark, sf_dir, "supplier").select("s_suppkey")).select(F.col("s_suppkey").alias("doc_id"), F.lit(60).alias("height"), F.lit(40).alias("width"), F.lit(3).alias("nChannels"))
    got = images.profiles(p.withColumn("data", data))
    return got.select("doc_id", "content_type", "source", "has_code_blocks", "has_multiple_regions", *[F.round(c, 4).alias(c) for c in ("contrast", "noise", "edge_sharpness")])
