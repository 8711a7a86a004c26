"""How good a recognised text is, which ways of reading a picture to try, and which attempt to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import SENTENCE_ENDS, strip

#: name, whether regions are detected first, whether the layout is analysed after.
STRATEGIES = (("article", False, True), ("multi_doc", True, True), ("simple", False, False))
THRESHOLD = 0.6
RETRIES = 2


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: strip(x) != "")


def duplicate_ratio(text: Column) -> Column:
    """Of the lines of 5 characters or more the share that repeats an earlier one."""
    long = F.filter(F.transform(_lines(text), strip), lambda x: F.length(x) >= 5)
    return F.when(F.size(long) > 0, 1 - F.size(F.array_distinct(long)) / F.size(long)).otherwise(F.lit(0.0))


def coherence(text: Column) -> Column:
    """0.6 of the share of lines that end a sentence, and 0.4 of how even their lengths are."""
    lines = _lines(text)
    n = F.size(lines)
    ended = F.size(F.filter(lines, lambda x: F.right(strip(x), F.lit(1)).isin(*SENTENCE_ENDS)))
    # lengths summed as integers: the same in any order
    total = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    squares = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x).cast("long") * F.length(x))
    spread = F.sqrt(F.greatest(F.lit(0).cast("double"), (n.cast("long") * squares - total * total).cast("double"))) / n
    even = F.greatest(F.lit(0.0), 1 - spread / (total / n + 1))
    return F.when(n > 0, ended / n * 0.6 + even * 0.4).otherwise(F.lit(0.0))


def structure(text: Column, n_boxes: Column) -> Column:
    """Signs of structure: an empty line, marks of headings, of lists, and more than 20 boxes; 1 at most."""
    has = lambda *marks: F.greatest(*[text.contains(m).cast("int") for m in marks])
    score = text.contains("\n\n").cast("int") * 3 + has("【", "】", "##", "**") * 3 + has("1.", "2.", "•", "-") * 2 + (F.coalesce(n_boxes, F.lit(0)) > 20).cast("int") * 2
    return F.least(score, F.lit(10)) / 10


def metrics(texts: DataFrame, boxes: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, char_count, line_count, avg_confidence, duplicate_ratio, coherence_score, structure_score, quality_score).

    texts: (key, text), a row each; what comes from the text is computed within its row, without an exchange. boxes: (key,
    confidence), or texts has avg_confidence and n_boxes already. A null text counts as empty.
    """
    if boxes is not None:
        per = boxes.groupBy(key).agg(F.avg("confidence").alias("avg_confidence"), F.count("*").alias("n_boxes"))
        texts = texts.join(per, key, "left")
    text = F.coalesce("text", F.lit(""))
    out = texts.select(
        key, F.length(F.translate(text, "\n ", "")).alias("char_count"), F.size(_lines(text)).alias("line_count"),
        F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"), duplicate_ratio(text).alias("duplicate_ratio"),
        coherence(text).alias("coherence_score"), structure(text, F.col("n_boxes")).alias("structure_score"),
    )
    return out.withColumn("quality_score", quality_score())


def quality_score() -> Column:
    return (
        F.least(F.col("char_count") / 1000, F.lit(1.0)) * 0.30 + F.col("avg_confidence") * 0.20 + (1 - F.col("duplicate_ratio")) * 0.20
        + F.col("coherence_score") * 0.15 + F.col("structure_score") * 0.15
    )


def strategies(profiles: DataFrame) -> DataFrame:
    """profiles with `strategies`, names in the order in which they are tried."""
    big = (F.col("height") > 2000) | (F.col("width") > 2000)
    names = lambda *x: F.array(*map(F.lit, x))
    return profiles.withColumn(
        "strategies",
        F.when(F.col("is_long_screenshot") | (~(F.col("has_multiple_regions") | F.col("recommended_region_detection")) & big), names("article", "simple"))
        .when(F.col("has_multiple_regions") | F.col("recommended_region_detection"), names("multi_doc", "article", "simple"))
        .otherwise(names("simple", "article")),
    )


def attempts(planned: DataFrame, retries: int = RETRIES) -> DataFrame:
    """A row (…, attempt, strategy) for each of the first retries + 1 strategies."""
    return planned.select("*", F.posexplode(F.slice("strategies", 1, retries + 1)).alias("attempt", "strategy"))


def best_attempt(scored: DataFrame, threshold: float = THRESHOLD, retries: int = RETRIES, key: str = "doc_id") -> DataFrame:
    """Of each document's attempts (key, attempt, quality_score, …) the first that reaches the threshold; if none does, the best, the earliest on a tie.

    A partial aggregate on structs: no sort, and hot keys are combined before the exchange.
    """
    some = scored.filter(F.col("attempt") <= retries)
    good = F.col("quality_score") >= threshold
    row = F.struct(*[F.col(c) for c in scored.columns])
    rank = F.struct(F.when(good, 1).otherwise(0).alias("good"), F.when(good, 0.0).otherwise(F.col("quality_score")).alias("s"), (-F.col("attempt")).alias("a"))
    return some.groupBy(key).agg(F.max_by(row, rank).alias("b")).select("b.*")


def ranked_attempts(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """All attempts with `place`, from 1, by score."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col("quality_score").desc(), "attempt")))
