"""Line dedup: windows of three consecutive lines that occur before are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, table

WINDOW = 3
#: Numbers of lines to remove, and as much again for each text, up to which the list is broadcast.
MAX_BROADCAST_LINES = 4_000_000


def _lines() -> Column:
    return F.split(F.col("text"), "\n", -1)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, cut): for each text, told apart by doc_id and hash, the sorted numbers of the lines to remove.

    Windows go to a narrow scratch table. Counting and finding the first place are partial aggregates, so
    that a passage of a billion copies is no hot key; places are then joined with the keys that repeat.
    """
    split = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), F.transform(_lines(), lambda x: F.trim(x)).alias("__ld_lines"))
    split = split.filter(F.size("__ld_lines") >= window)
    keys = F.transform(F.sequence(F.lit(0), F.size("__ld_lines") - window), lambda i: _key(i, window))
    places = split.select("doc_id", "th", F.posexplode(keys).alias("at", "key")).filter("key is not null")
    places = materialize(places.select("doc_id", "th", "at", "key.a", "key.b"), "line-windows")
    place = F.struct("doc_id", "th", "at")
    first = places.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = places.join(first, ["a", "b"]).filter(~place.eqNullSafe(F.col("first")))
    covered = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + window - 1)))))
    return later.groupBy("doc_id", "th").agg(covered.alias("cut"))


def _key(i: Column, window: int) -> Column:
    joined = F.array_join(F.slice(F.col("__ld_lines"), i + 1, window), "\n")
    return F.when(F.length(joined) > window - 1, F.struct(F.xxhash64(joined).alias("a"), F.xxhash64(F.lit(1), joined).alias("b")))


def dedup_lines(docs: DataFrame, window: int = WINDOW, drop_emptied: bool = False) -> DataFrame:
    """docs with the lines of repeated windows removed; columns as they were, n_chars (if there) brought up to date.

    The first place of a window, by doc_id and then line number, stays; all later ones go, in other
    documents or the same. Lines that several windows cover are removed once. A window of blank lines
    only never counts. Texts of fewer lines than the window, null and empty texts stay as they are. A
    document of which nothing is left keeps an empty text, or goes with drop_emptied. Null doc_ids
    stand before all others. Rows with the same doc_id and text are treated alike: they count as one document. An empty table gives no rows.
    """
    cuts = repeated_windows(docs, window).select(F.col("doc_id").alias("__ld_id"), F.col("th").alias("__ld_th"), F.col("cut").alias("__ld_cut"))
    cuts = materialize(cuts, "line-cuts")
    # few and short enough lists are broadcast, and no text is moved; beyond that both sides meet by key
    if (cuts.agg(F.sum(F.size("__ld_cut") + 4)).first()[0] or 0) <= MAX_BROADCAST_LINES:
        cuts = F.broadcast(cuts)
    same = docs["doc_id"].eqNullSafe(F.col("__ld_id")) & (F.xxhash64(docs["text"]) == F.col("__ld_th"))
    joined = docs.join(cuts, same, "left").withColumn("__ld_lines", F.when(F.col("__ld_cut").isNotNull(), _lines()))
    left = F.array_except(F.sequence(F.lit(0), F.size("__ld_lines") - 1), "__ld_cut")
    joined = joined.withColumn("__ld_left", F.when(F.col("__ld_cut").isNotNull(), left))
    if drop_emptied:
        joined = joined.filter(F.col("__ld_cut").isNull() | (F.size("__ld_left") > 0))
    text = F.when(F.col("__ld_cut").isNull(), F.col("text")).otherwise(F.array_join(F.transform("__ld_left", lambda i: F.get("__ld_lines", i)), "\n"))
    joined = joined.withColumn("__ld_text", text)
    kinds = dict(docs.dtypes)
    out = {"text": F.col("__ld_text")}
    if "n_chars" in kinds:
        n = F.when(F.col("__ld_cut").isNull(), F.col("n_chars")).otherwise(F.length("__ld_text"))
        out["n_chars"] = n.cast(kinds["n_chars"])
    return joined.select(*[out[c].alias(c) if c in out else docs[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars")


def select_sql(docs: str, window: int = WINDOW, drop_emptied: bool = False) -> str:
    """doc_id, text, lang, source, n_chars after the dedup; doc_ids must be unique."""
    joined = " || chr(10) || ".join(f"coalesce(lead(trim(line), {k}) OVER w, '')" if k else "trim(line)" for k in range(window))
    left = "coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL), '')"
    return f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM {docs} WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, pos, {joined} AS key, lead(pos, {window - 1}) OVER w AS last FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS nth FROM windows WHERE last IS NOT NULL AND length(key) > {window - 1}),
cut AS (SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, range({window}) AS ks(k) WHERE nth > 1),
texts AS (
  SELECT l.doc_id, {left} AS text, count(*) - count(c.pos) AS n_left, count(c.pos) AS n_cut
  FROM lines l LEFT JOIN cut c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN t.n_cut > 0 THEN t.text ELSE d.text END AS text, d.lang, d.source,
       CASE WHEN t.n_cut > 0 THEN length(t.text) ELSE d.n_chars END AS n_chars
FROM {docs} d LEFT JOIN texts t ON d.doc_id = t.doc_id""" + (" WHERE t.n_left IS NULL OR t.n_left > 0" if drop_emptied else "")


SQL = f"SELECT doc_id, text, n_chars FROM ({select_sql('documents')})"
