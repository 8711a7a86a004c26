"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import count_tokens, materialize, table, unit_hash

#: Share of the mixture by source; what is left is spread evenly over the sources not named.
TARGET_SHARES = {"src0": 0.2}
#: Nested budgets, as fractions of the largest mixture that the sources can fill without repeating a document.
LEVELS = (0.1, 0.5, 1.0)
SEED = "mix-1"
#: Bits of the 60-bit hash that one round of histograms resolves, and the rounds before single hashes are summed.
ROUND_BITS = 12
ROUNDS = 2
#: Thresholds up to this many rows are broadcast; beyond it Spark joins them by source.
MAX_BROADCAST_ROWS = 100_000


def position(seed: str = SEED) -> Column:
    """Where a document stands in its source's fixed random order: equal doc_ids stand together."""
    return unit_hash(F.lit(seed), F.col("doc_id"))


def thresholds(narrow: DataFrame, shares: dict[str, float] = TARGET_SHARES, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """From (source, u, n_tokens): rows (source, level, top), where a document belongs to the level if u <= top.

    A named source's budget at level f is f * T * share, T being the largest total at which no named source and not
    the unnamed ones together run out. The unnamed sources, null among them, have equal parts of what is left of f * T; one
    that holds less is taken whole and the others share its remainder, so that no small source binds T. A source's documents are taken in the order of u as long as the running sum stays within the
    budget. Round by round, tokens are summed into 2^ROUND_BITS buckets of u; only the bucket in
    which the budget ends is looked into again; last, the single values of u within that bucket are summed.
    No step sorts documents: windows run over buckets.
    """
    named = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]) if shares else F.create_map().cast("map<string,double>")
    per = narrow.groupBy("source").agg(F.sum("n_tokens").alias("have")).filter("have > 0")
    per = per.withColumn("named", F.try_element_at(named, F.coalesce("source", F.lit(""))))
    whole = per.agg(F.coalesce(F.sum("named"), F.lit(0.0)).alias("taken"), F.count_if(F.col("named").isNull()).alias("others"))
    per = per.crossJoin(F.broadcast(whole)).withColumn(
        "weight", F.coalesce("named", F.greatest(F.lit(0.0), F.lit(1.0) - F.col("taken")) / F.col("others"))
    )
    per = materialize(per.filter("weight > 0").select("source", "have", "weight", F.col("named").isNull().alias("free")), "mix-weights")
    per = per.crossJoin(F.broadcast(_total(per, shares)))
    level = F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level")
    # A few rows a source, stored between rounds: plans would grow with each. The open budgets: documents whose u has this prefix (of `done` bits) still count against `rest`
    each = per.select("*", level)
    each = each.join(F.broadcast(_whole(each)), "level", "left")
    equal = F.col("level") * F.col("total") * F.col("weight")
    # without a short source the part is equal as it is
    part = F.when((F.col("short") > 0) & F.col("free"), F.when(F.col("have") <= F.col("longest"), F.col("have")).otherwise(F.try_divide("left", "sharing"))).otherwise(equal)
    open_ = each.select("source", "level", F.floor(part).cast("long").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    open_ = materialize(open_, "mix-open")
    done = 0
    for _ in range(ROUNDS):
        open_ = materialize(_boundary(narrow, open_, done, done + ROUND_BITS), "mix-open")
        done += ROUND_BITS
    return _boundary(narrow, open_, done, 60).select("source", "level", F.col("prefix").alias("top"))


def _total(per: DataFrame, shares: dict[str, float]) -> DataFrame:
    """One row: the largest total that each named source, and the unnamed ones together, can fill."""
    free = F.sum(F.when(F.col("free"), F.col("have"))) / F.sum(F.when(F.col("free"), F.col("weight")))
    return per.agg(F.least(F.min(F.when(~F.col("free"), F.col("have") / F.col("weight"))), free).alias("total"))


def _whole(each: DataFrame) -> DataFrame:
    """By level: how many unnamed sources are taken whole, the most that one of them has, what is left for the others and their number.
    One window over a row a source and level."""
    up = Window.partitionBy("level").orderBy("have", "source")
    free = each.filter("free").withColumns({
        "room": F.col("level") * F.col("total") * F.sum("weight").over(Window.partitionBy("level")), "n": F.count("*").over(Window.partitionBy("level")),
        "nth": F.row_number().over(up), "upto": F.sum("have").over(up.rowsBetween(Window.unboundedPreceding, 0)),
    })
    # half a token for rounding
    short = F.col("have") * (F.col("n") - F.col("nth") + 1) <= F.col("room") - (F.col("upto") - F.col("have")) + 0.5
    return free.withColumn("is_short", short).groupBy("level").agg(
        F.count_if("is_short").alias("short"), F.max(F.when(F.col("is_short"), F.col("have"))).alias("longest"),
        (F.max("room") - F.coalesce(F.sum(F.when(F.col("is_short"), F.col("have"))), F.lit(0))).alias("left"), F.count_if(~F.col("is_short")).alias("sharing"),
    )


def _boundary(narrow: DataFrame, open_: DataFrame, done: int, upto: int) -> DataFrame:
    """Refine each open budget from prefixes of `done` bits to prefixes of `upto` bits.

    At 60 bits the prefix is the largest u that fits (-1 if none); before, the bucket where the budget ends.
    """
    open_ = open_.select(F.col("source").alias("s"), "level", "rest", F.col("prefix").alias("p"))
    fine = narrow.select("source", F.shiftright("u", 60 - upto).alias("bucket"), "n_tokens")
    wanted = open_.select("s", "p").distinct()
    up = F.shiftright(F.col("bucket"), upto - done)
    hist = (
        fine.join(wanted, F.col("source").eqNullSafe(F.col("s")) & (up == F.col("p")), "left_semi")
        .groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    )
    each = hist.join(open_, F.col("source").eqNullSafe(F.col("s")) & (up == F.col("p")))
    upward = Window.partitionBy("source", "level").orderBy("bucket")
    each = each.withColumn("sum", F.sum("tokens").over(upward))
    fits = F.col("sum") <= F.col("rest")
    out = each.groupBy("source", "level").agg(
        F.max(F.when(fits, F.col("bucket"))).alias("last"), F.min(F.when(~fits, F.col("bucket"))).alias("next"),
        F.max(F.when(fits, F.col("sum"))).alias("used"), F.first("rest").alias("rest"), F.min("p").alias("p"),
    )
    if upto == 60:
        # nothing fits: the threshold lies just below the bucket that was refined
        return out.select("source", "level", F.lit(0).cast("long").alias("rest"), F.coalesce("last", F.shiftleft("p", 60 - done) - 1).alias("prefix"))
    # a source that fits whole ends in its last bucket, with what it needs there left over
    whole = F.col("next").isNull()
    tail = each.groupBy("source", "level").agg(F.max_by("tokens", "bucket").alias("tail")).select(F.col("source").alias("s"), F.col("level").alias("l"), "tail")
    out = out.join(tail, F.col("source").eqNullSafe(F.col("s")) & (F.col("level") == F.col("l")))
    return out.select(
        "source", "level",
        F.when(whole, F.col("tail")).otherwise(F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest"),
        F.when(whole, F.col("last")).otherwise(F.col("next")).alias("prefix"),
    )


def mixed(docs: DataFrame, shares: dict[str, float] = TARGET_SHARES, levels: tuple[float, ...] = LEVELS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(narrow, limits): narrow has a row (doc_id, source, u, n_tokens) per document, limits the thresholds."""
    narrow = materialize(docs.select("doc_id", "source", position(seed).alias("u"), count_tokens(F.col("text")).alias("n_tokens")), "mix-narrow")
    limits = materialize(thresholds(narrow, shares, levels), "mix-limits")
    return narrow, limits


def _small(limits: DataFrame) -> DataFrame:
    return F.broadcast(limits) if limits.count() <= MAX_BROADCAST_ROWS else limits


def mix(docs: DataFrame, shares: dict[str, float] = TARGET_SHARES, levels: tuple[float, ...] = LEVELS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, level): the documents of the mixture, each with the smallest level that has it.

    Every row of docs counts, repeated rows and rows without doc_id too; documents with the same
    doc_id stand at the same place of their source's order and go in or out together. A null source
    is a source of its own. A null or empty text has 0 tokens; such a document goes in if its place
    does. A source without tokens has no budget and gives nothing, nor does one of weight 0. An empty table gives no rows.
    """
    narrow, limits = mixed(docs, shares, levels, seed)
    small = limits.count() <= MAX_BROADCAST_ROWS
    tops = limits.select(F.col("source").alias("s"), "level", "top")
    per = tops.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("level", "top"))).alias("tops"))
    first = F.get(F.filter("tops", lambda x: F.col("u") <= x["top"]), F.lit(0))["level"]
    return (
        narrow.join(F.broadcast(per) if small else per, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "source", "n_tokens", first.alias("level")).filter(F.col("level").isNotNull())
    )


def keep_mixed(docs: DataFrame, shares: dict[str, float] = TARGET_SHARES, seed: str = SEED) -> DataFrame:
    """The rows of docs that belong to the whole mixture (level 1), unchanged."""
    _, limits = mixed(docs, shares, (1.0,), seed)
    tops = limits.select(F.col("source").alias("__mix_s"), F.col("top").alias("__mix_top"))
    return docs.join(_small(tops), F.col("source").eqNullSafe(F.col("__mix_s")) & (position(seed) <= F.col("__mix_top")), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def select_sql(docs: str, levels: tuple[float, ...] = LEVELS, shares: dict[str, float] = TARGET_SHARES, seed: str = SEED) -> str:
    """The same rows in SQL: a running sum over the whole order."""
    named = " ".join(f"WHEN '{s}' THEN {w!r}" for s, w in shares.items())
    values = ", ".join(f"({float(x)!r}::DOUBLE)" for x in levels)
    return f"""
WITH narrow AS (
  SELECT doc_id, source, ('0x' || substr(md5('{seed}|' || coalesce(cast(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS u,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+'))::BIGINT AS n_tokens
  FROM {docs}),
have AS (SELECT source, sum(n_tokens)::BIGINT AS have, (CASE source {named} END)::DOUBLE AS named FROM narrow GROUP BY source HAVING sum(n_tokens) > 0),
weights AS (
  SELECT source, have, coalesce(named, greatest(0.0::DOUBLE, 1.0::DOUBLE - (SELECT coalesce(sum(named), 0.0::DOUBLE) FROM have)) / (SELECT count(*) FROM have WHERE named IS NULL)) AS weight
  FROM have),
total AS (SELECT min(have / weight) AS total FROM weights WHERE weight > 0),
levels(level) AS (VALUES {values}),
budgets AS (SELECT source, level, floor(level * total * weight)::BIGINT AS budget FROM weights, total, levels WHERE weight > 0),
running AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY u RANGE UNBOUNDED PRECEDING) AS used FROM narrow)
SELECT r.doc_id, r.source, r.n_tokens, min(b.level) AS level
FROM running r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source AND r.used <= b.budget
GROUP BY r.doc_id, r.source, r.n_tokens"""


SQL = select_sql("documents")
