"""From pictures to documents over a pluggable recogniser: adaptive, smart and basic ways, their order of fallback, and the dispatch of inputs.

A recogniser is a function from a pixel array to (text, confidence, x, y, w, h) tuples, relative, origin at the bottom. It runs where
the picture is: parts are cut out within the picture's row, no pixels are exchanged. Its failure is a value in `error`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.paths import input_type, url_file_type
from leafmill.operators import cleaner, coordinates, images, layout, quality, regions, slicing, tables
from leafmill.plans.pipelines import Options, detected_tables, region_text, route
from leafmill.sinks.documents import format_pages
from leafmill.sources import files

Recogniser = Callable[[np.ndarray], list[tuple]]

_PARTS = "array<struct<part:int,x:int,y:int,w:int,h:int>>"
_FOUND = {c: (k, t) for k, t, cs in (
    ("int", pa.int32(), "part px py pw ph page_height"), ("bigint", pa.int64(), "box_no"), ("string", pa.string(), "text"), ("double", pa.float64(), "confidence x y w h"), ("string", pa.string(), "error")
) for c in cs.split()}
#: Strategies by name: regions on or off, layout analysed after or not.
WAYS = {name: (with_regions, with_layout) for name, with_regions, with_layout in quality.STRATEGIES}
#: Rows of a list of documents up to which it is broadcast.
MAX_BROADCAST_DOCS = 1_000_000


def kept(df: DataFrame) -> DataFrame:
    """df, computed once: as Parquet in the checkpoint folder if the session has one, else cached (and computed again where that is lost)."""
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        path = f"{root.rstrip('/')}/kept-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.persist()


def _slices() -> Column:
    """The parts of a tall picture, in its row."""
    step = F.col("slice_height") - F.col("overlap")
    n = slicing.count(F.col("height"), F.col("slice_height"), F.col("overlap"))
    part = lambda k: F.struct(k.alias("part"), F.lit(0).alias("x"), (k * step).alias("y"), F.col("width").alias("w"), F.least(F.col("slice_height"), F.col("height") - k * step).alias("h"))
    return F.transform(F.sequence(F.lit(0), n - 1), part).cast(_PARTS)


def profiled(pictures: DataFrame, exif: str | None = None) -> DataFrame:
    """Pictures (doc_id, height, width, nChannels, data) with their profile beside the pixels."""
    pictures = pictures.withColumn("__exif", F.coalesce(F.col(exif), F.lit(False)) if exif else F.lit(False))
    keys = ["doc_id", "height", "width", "nChannels", "data", "__exif"]
    return images.recommend(images._each(pictures, images.MEASURES, images.measure, keys), F.col("__exif")).drop("__exif")


def _recognised(planned: DataFrame, recogniser: Recogniser, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each picture: the carried columns and `found`, an array of _FOUND. A part without boxes has one entry with a null box_no, and so has one that failed, with the error."""
    kept_ = planned.select(*carried)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_.schema) + ", found array<struct<" + ",".join(f"{c}:{k}" for c, (k, _) in _FOUND.items()) + ">>"
    n = len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ends = [0]
            for height, width, channels, data, branch, scale, steps, parts in zip(*[c.to_pylist() for c in batch.columns[n:]]):
                none = (None,) * 7
                try:
                    a = images.pixels(height, width, channels, data)
                    if branch == "regions":
                        parts = [{"part": i, "x": x, "y": y, "w": w, "h": h} for i, (x, y, w, h) in enumerate(regions.arranged(images.find_boxes(a), width, height))]
                    for p in parts:
                        at = (p["part"], p["x"], p["y"], p["w"], p["h"], height)
                        crop = a[p["y"] : p["y"] + p["h"], p["x"] : p["x"] + p["w"]]
                        found = recogniser(images.prepare(crop, scale, steps))
                        rows += [(*at, i, *b, None) for i, b in enumerate(found)] or [(*at, *none, None)]
                except Exception as e:  # one picture's failure is a value, not the job's end
                    rows.append((0, 0, 0, width, height, height, *none, f"{type(e).__name__}: {e}"))
                ends.append(len(rows))
            if batch.num_rows:
                cols = zip(*rows) if rows else [()] * len(_FOUND)
                entries = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FOUND.values())], names=list(_FOUND))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], names=[*carried, "found"])

    return planned.select(*carried, *[F.col(c).alias(f"__{c}") for c in ("height", "width", "nChannels", "data", "branch", "scale", "steps", "parts")]).mapInArrow(run, ddl)


def adaptive(pictures: DataFrame, recogniser: Recogniser, options: Options | None = None, preprocess: bool = True) -> DataFrame:
    """(doc_id, text, boxes, tables, processing_info, error) for each picture of profiled().

    A picture is read whole, in overlapping slices if it is tall, or by regions, in reading order. boxes is an array of (box_no, text,
    confidence, x, y, w, h), origin at the top (pixels for regions, else relative). A picture without any box has text "". Rows of one doc_id are one page.
    """
    o = options or Options()
    plan = images.preprocessing_plan(route(pictures, o.regions), binarize=o.binarize)
    prepared = F.col("needs_preprocessing") & F.lit(preprocess)
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("width").alias("w"), F.col("height").alias("h"))).cast(_PARTS)
    plan = plan.withColumns({
        "scale": F.when(prepared, F.col("scale")).otherwise(1.0), "steps": F.when(prepared, F.col("steps")).otherwise(F.array().cast("array<string>")), "parts": F.when(F.col("branch") == "slices", _slices()).otherwise(whole),
    })
    plan = plan.withColumn(
        "info",
        F.struct("source", "content_type", F.round("contrast", 2).alias("contrast_level"), F.round("noise", 2).alias("noise_level"), "needs_preprocessing", "needs_slicing",
                 F.when(F.col("branch") == "slices", F.size("parts")).otherwise(0).alias("slice_count"), prepared.alias("preprocessing_applied")),
    )
    # pictures are measured and read once: what is told of them travels with their boxes
    read = kept(_recognised(plan, recogniser, ("doc_id", "branch", "content_type", "info")))
    info, found = read.drop("found"), read.select("doc_id", "branch", F.inline("found"))
    counts = found.groupBy("doc_id").agg(F.max("error").alias("error"), F.countDistinct("part").alias("n_parts"))
    boxes = found.filter(F.col("box_no").isNotNull() & (F.coalesce("confidence", F.lit(1.0)) >= o.threshold))
    merged = kept(coordinates.deduplicate(_on_page(boxes.filter("branch <> 'regions'")), placed=True).drop("branch"))
    apart = boxes.filter("branch = 'regions'").withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "x": F.col("x") * F.col("pw") + F.col("px"), "y": (1 - F.col("y") - F.col("h")) * F.col("ph") + F.col("py"), "w": F.col("w") * F.col("pw"), "h": F.col("h") * F.col("ph")})
    texts = coordinates.merge_to_text(merged.withColumn("box_no", F.col("place").cast("long"))).unionByName(region_text(apart.withColumn("place", F.col("part"))))
    box = F.struct("box_no", "text", "confidence", "x", "y", "w", "h")
    listed = merged.withColumn("box_no", F.col("place").cast("long")).select("doc_id", box.alias("b")).unionByName(apart.withColumn("box_no", F.col("part").cast("long") * 1_000_000 + F.col("box_no")).select("doc_id", box.alias("b")))
    out = info.join(counts, "doc_id", "left").join(texts, "doc_id", "left").join(listed.groupBy("doc_id").agg(F.array_sort(F.collect_list("b")).alias("boxes")), "doc_id", "left")
    if o.detect_tables:
        grids = detected_tables(merged.join(info.filter("content_type = 'table'").select("doc_id"), "doc_id", "left_semi"))
        out = out.join(grids.select("doc_id", F.array("markdown").alias("tables")), "doc_id", "left")
    else:
        out = out.withColumn("tables", F.lit(None).cast("array<string>"))
    region_count = F.when(F.col("branch") == "regions", F.coalesce("n_parts", F.lit(0))).otherwise(0)
    return out.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "boxes", F.coalesce("tables", F.array().cast("array<string>")).alias("tables"), F.col("info").withField("region_count", region_count).alias("processing_info"), "error")


def _on_page(boxes: DataFrame) -> DataFrame:
    """Boxes of slices, or of the whole, relative to the page with its origin at the top."""
    tall = F.col("page_height")
    return boxes.select(
        "doc_id", "branch", F.col("part").alias("slice_index"), "box_no", "text", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "x",
        ((F.col("py") + (1 - F.col("y") - F.col("h")) * F.col("ph")) / tall).alias("y"), "w", (F.col("h") * F.col("ph") / tall).alias("h"),
    )


def basic(pictures: DataFrame, recogniser: Recogniser) -> DataFrame:
    """(doc_id, text, boxes, error): each picture (doc_id, height, width, nChannels, data) read once and whole, lines in the recogniser's order."""
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("width").alias("w"), F.col("height").alias("h"))).cast(_PARTS)
    read = _recognised(pictures.withColumns({"branch": F.lit("whole"), "scale": F.lit(1.0), "steps": F.array().cast("array<string>"), "parts": whole}), recogniser).select("doc_id", F.inline("found"))
    piece = F.when(F.col("box_no").isNotNull(), F.struct("box_no", "text", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "x", (1 - F.col("y") - F.col("h")).alias("y"), "w", "h"))
    out = read.groupBy("doc_id").agg(F.array_sort(F.collect_list(piece)).alias("boxes"), F.max("error").alias("error"))
    return out.select("doc_id", F.array_join(F.transform("boxes", lambda b: b["text"]), "\n").alias("text"), "boxes", "error")


def by_page(pictures: DataFrame, recogniser: Recogniser) -> DataFrame:
    """(doc_id, page_no, text, error): tall pictures in slices of PAGE_HEIGHT, each a page from 1 on; what two slices share is read twice."""
    sized = pictures.withColumns({"slice_height": F.lit(slicing.PAGE_HEIGHT), "overlap": F.lit(slicing.PAGE_OVERLAP), "branch": F.lit("slices"), "scale": F.lit(1.0), "steps": F.array().cast("array<string>")})
    read = _recognised(sized.withColumn("parts", _slices()), recogniser).select("doc_id", F.inline("found"))
    piece = F.when(F.col("box_no").isNotNull(), F.struct("box_no", "text"))
    out = read.groupBy("doc_id", (F.col("part") + 1).alias("page_no")).agg(F.array_sort(F.collect_list(piece)).alias("b"), F.max("error").alias("error"))
    return out.select("doc_id", "page_no", F.array_join(F.transform("b", lambda b: b["text"]), "\n").alias("text"), "error")


def _those(pictures: DataFrame, docs: DataFrame) -> DataFrame:
    """The pictures of some documents; a short list of them is broadcast, so that no pixels move."""
    few = docs.limit(MAX_BROADCAST_DOCS + 1).count() <= MAX_BROADCAST_DOCS
    return pictures.join(F.broadcast(docs) if few else docs, "doc_id", "left_semi")


def smart(pictures: DataFrame, recogniser: Recogniser, options: Options | None = None, preprocess: bool = True) -> DataFrame:
    """(doc_id, text, boxes, strategy, quality_score, attempts, error) for each picture of profiled().

    Strategies are tried in the order of quality.strategies: attempt k + 1 is made only for documents of which no attempt has reached the quality threshold,
    and at most max_retries + 1 are made. The first that reaches it counts, else the best. Its text is laid out if the strategy says so, and cleaned.
    """
    o = options or Options()
    ranked = quality.strategies(pictures)
    pending, tried = ranked, None
    for k in range(o.max_retries + 1):
        now = pending.withColumn("strategy", F.get("strategies", F.lit(k))).filter("strategy is not null")
        read = []
        for with_regions in (False, True):
            mine = now.filter(F.col("strategy").isin(*[w for w, (r, _) in WAYS.items() if r == with_regions]))
            read.append(adaptive(mine, recogniser, Options(**{**o.__dict__, "regions": "on" if with_regions else "off"}), preprocess))
        made = read[0].unionByName(read[1]).join(now.select("doc_id", "strategy"), "doc_id").withColumn("attempt", F.lit(k))
        confidence = F.aggregate("boxes", F.lit(0.0), lambda s, b: s + b["confidence"]) / F.size("boxes")
        scored = quality.metrics(made.select("doc_id", "text", F.when(F.size("boxes") > 0, confidence).alias("avg_confidence"), F.when(F.col("boxes").isNull(), 0).otherwise(F.size("boxes")).alias("n_boxes"))).select("doc_id", "quality_score")
        made = kept(made.join(scored, "doc_id").drop("tables", "processing_info"))
        tried = made if tried is None else tried.unionByName(made)
        pending = _those(pending, made.filter(F.col("error").isNull() & (F.col("quality_score") < o.quality_threshold)).select("doc_id"))
    best = quality.best_attempt(tried, o.quality_threshold, o.max_retries)
    best = best.join(tried.groupBy("doc_id").agg(F.count("*").cast("int").alias("attempts")), "doc_id")
    laid = F.col("strategy").isin(*[w for w, (_, with_layout) in WAYS.items() if with_layout]) & (F.size("boxes") > 0)
    spread = best.filter(laid).select("doc_id", F.inline("boxes"))
    pages = layout.format_with_layout(spread)
    out = best.join(pages, "doc_id", "left").withColumn("text", F.coalesce("markdown", "text"))
    out = cleaner.clean_text(out) if o.clean else out
    return out.select("doc_id", "text", "boxes", "strategy", "quality_score", "attempts", "error")


def with_fallback(pictures: DataFrame, recogniser: Recogniser, options: Options | None = None, ways: tuple[str, ...] = ("smart", "adaptive", "basic"), preprocess: bool = True) -> DataFrame:
    """(doc_id, text, boxes, way, error): each picture by the first of the ways that doesn't fail on it; the last one's error if all do."""
    run = {"smart": lambda p: smart(p, recogniser, options, preprocess), "adaptive": lambda p: adaptive(p, recogniser, options, preprocess), "basic": lambda p: basic(p, recogniser)}
    pending, out = profiled(pictures), None
    for i, way in enumerate(ways):
        made = kept(run[way](pending).select("doc_id", "text", "boxes", F.lit(way).alias("way"), "error"))
        done = made if i == len(ways) - 1 else made.filter("error is null")
        out = done if out is None else out.unionByName(done)
        if i < len(ways) - 1:
            pending = _those(pending, made.filter("error is not null").select("doc_id"))
    return out


def process_inputs(
    spark: SparkSession, inputs: DataFrame, recogniser: Recogniser, decode: Callable[[bytes], np.ndarray], get: Callable[[str], bytes] | None = None,
    read: Callable[[str], bytes] | None = None, options: Options | None = None, way: str = "smart", pdf: Callable[[bytes], list[bytes]] | None = None, preprocess: bool = True, stamp: str = "1970-01-01 00:00:00",
) -> DataFrame:
    """(input_idx, path, output, error), a row for each of inputs (input_idx, path), in their order.

    Each input goes by its kind: a URL is fetched (get) and then goes by the file type in its path; a PDF gives a page for each picture that `pdf`
    makes of it; a DOCX its own text and a page for each picture in it; a picture one page. read gives a file's bytes (default: open). decode makes pixels
    (h, w) or (h, w, RGB[A]) of a picture's bytes. What can't be fetched, read, decoded or recognised, and paths of no known kind, have an `error`
    and no output. `way` is where the order smart, adaptive, basic begins. List folders with sources.files.list_files first.
    """
    o = options or Options()

    def load(path: str) -> bytes:
        if read:
            return read(path)
        with open(path, "rb") as f:
            return f.read()

    def pages_of(path: str, kind: str) -> tuple[str | None, list[bytes]]:
        if kind == "unknown":
            raise ValueError(f"unsupported input: {path}")
        if path.lower().startswith(("http:", "https:")):
            if get is None:
                raise ValueError("no way to fetch URLs was given")
            data = get(path)
        else:
            data = load(path)
        if kind == "docx":
            text, pictures = files.docx_content(data)
            return text, [d for _, d in pictures]
        if kind == "pdf":
            if pdf is None:
                raise ValueError("no way to draw PDF pages was given")
            return None, pdf(data)
        return None, [data]

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["input_idx", "path", "docx_text", "page_no", "height", "width", "nChannels", "data", "error"]
        kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int32()] * 4, pa.binary(), pa.string()]
        for batch in batches:
            for i, path, kind in zip(*[c.to_pylist() for c in batch.columns]):
                try:
                    text, pictures = pages_of(path, kind)
                    rows = []
                    for n, d in enumerate(pictures, 1):
                        a = decode(d)
                        c = 1 if a.ndim == 2 else a.shape[2]
                        back = a if a.ndim == 2 else a[:, :, [2, 1, 0, *range(3, c)]]
                        rows.append((i, path, text, n, a.shape[0], a.shape[1], c, np.ascontiguousarray(back, np.uint8).tobytes(), None))
                    rows = rows or [(i, path, text, *[None] * 5, None)]
                except Exception as e:
                    rows = [(i, path, *[None] * 6, f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    kind = input_type(F.col("path"))
    kind = F.when(kind == "url", url_file_type(F.col("path"))).otherwise(kind)
    opened = inputs.select(F.col("input_idx").cast("long"), "path", kind.alias("kind")).mapInArrow(open_, "input_idx long, path string, docx_text string, page_no int, height int, width int, nChannels int, data binary, error string")
    opened = kept(opened.withColumn("doc_id", F.monotonically_increasing_id()))
    ways = ("smart", "adaptive", "basic")
    read_ = with_fallback(opened.filter("data is not null").select("doc_id", "height", "width", "nChannels", "data"), recogniser, o, ways[ways.index(way) :], preprocess)
    pages = opened.drop("data", "height", "width", "nChannels").join(read_.select("doc_id", "text", F.col("boxes"), F.col("error").alias("failed")), "doc_id", "left")
    pages = pages.select(F.col("input_idx").alias("doc_id"), F.col("path").alias("source"), "page_no", "text", "docx_text", F.lit(stamp).cast("timestamp").alias("ts"), F.coalesce("error", "failed").alias("error"), "boxes")
    details = pages.select("doc_id", "page_no", F.inline("boxes")) if o.details else None
    errors = pages.groupBy("doc_id").agg(F.max("error").alias("error"))
    outputs = format_pages(pages.drop("boxes", "error"), o.output_format, o.metadata, details)
    out = inputs.join(errors.withColumnRenamed("doc_id", "input_idx"), "input_idx", "left").join(outputs.withColumnRenamed("doc_id", "input_idx"), "input_idx", "left")
    return out.select("input_idx", "path", F.when(F.col("error").isNull(), F.col("output")).alias("output"), "error").orderBy("input_idx")
