"""Cleaning of recognised text, line by line in a fixed order of steps.

Texts stay rows: no step exchanges data. Three steps look at what earlier lines have become and share one Arrow
UDF; the four after them are array expressions in the JVM.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import GOING_ON, OPEN_ENDS, OPENERS, relation, strip
from leafmill.operators.folds import hand_back

#: How many of the lines that are left a line is held against, and from which likeness on it is a copy.
LOOK_BACK, COPY = 10, 0.95
LEGACY_LOOK_BACK, LEGACY_COPY = 5, 0.8
SHORT_LINE, SHORT_TITLE = 25, 15
#: Texts that are Python strings at a time.
PIECE = 200

_TITLE = re.compile(r"\*\*\d+\.\*\*\s*(.+)")
_NUMBER = re.compile(r"\d+\.")


def drop_repeats(lines: list[str], threshold: float = COPY, look_back: int = LOOK_BACK, compat: bool = False) -> list[str]:
    """Lines without copies of, or parts of, the last few lines that are left; a line that continues one of them takes its place.

    With compat the place is reckoned as if look_back lines were there already, however few there are: an earlier
    line is overwritten, or the longer one lost.
    """
    kept = lines[:1]
    bare = [x.strip() for x in kept]
    for line in lines[1:]:
        now = line.strip()
        verdict, place = "different", -1
        if now:
            lo = max(0, len(kept) - look_back)
            for i in range(lo, len(kept)):
                before = bare[i]
                if not before:
                    continue
                verdict = relation(before, now, threshold)
                if verdict != "different":
                    place = i if not compat else len(kept) - look_back + (i - lo)
                    if verdict == "similar":
                        verdict = "longer" if len(now) > len(before) else "shorter"
                    break
        if verdict == "different":
            kept.append(line)
            bare.append(now)
        elif verdict == "longer" and place >= 0:
            kept[place], bare[place] = line, now
    return kept


def drop_repeats_by_characters(lines: list[str], threshold: float = LEGACY_COPY, look_back: int = LEGACY_LOOK_BACK) -> list[str]:
    """The other variant: a line goes if it has more than that share of characters in common with one of the last few."""

    def like(a: str, b: str) -> float:
        if not a or not b:
            return 0.0
        if a == b:
            return 1.0
        return 0.9 if a in b or b in a else len(set(a) & set(b)) / len(set(a) | set(b))

    kept = lines[:1]
    for line in lines[1:]:
        if not any(like(line.strip(), k.strip()) > threshold for k in kept[-look_back:]):
            kept.append(line)
    return kept


def _opens(text: str) -> bool:
    return bool(_NUMBER.match(text)) or text.startswith(("【", "#", *OPENERS))


def _goes_on(before: str, after: str) -> bool:
    return before.endswith(OPEN_ENDS) or after.startswith(GOING_ON) or (len(before) < 5 and not _opens(after)) or len(after) < 3


def join_fragments(lines: list[str]) -> list[str]:
    """Stripped lines, each glued to the one being gathered as long as that is unfinished; blank lines end it and stay."""
    out: list[str] = []
    held = ""
    for line in lines:
        now = line.strip()
        if held and now and _goes_on(held, now):
            held += now
            continue
        if held:
            out.append(held)
        held = now
        if not now:
            out.append(line)
    if held:
        out.append(held)
    return out


def _han(ch: str) -> bool:
    return "一" <= ch <= "鿿"


def join_broken_words(lines: list[str]) -> list[str]:
    """A long Chinese line without a full stop takes in the next non-blank one; a joined line is not looked at again."""
    out, i, n = [], 0, len(lines)
    while i < n:
        now = lines[i].strip()
        title = _TITLE.fullmatch(now)
        short_title = bool(title) and len(title.group(1)) < SHORT_TITLE
        item = now.startswith("**") and not short_title
        closed = now.startswith(("#", "◎")) or now.endswith(("】", "？", "：")) or short_title or (len(now) < SHORT_LINE and not item)
        if now and not closed and _han(now[-1]):
            j = i + 1
            while j < n and not lines[j].strip():
                j += 1
            after = lines[j].strip() if j < n else ""
            if after and _han(after[0]) and not _opens(after):
                out.append(now + after)
                i = j + 1
                continue
        out.append(lines[i])
        i += 1
    return out


def folded(text: str, variant: str = "sequence", threshold: float | None = None, compat: bool = False) -> str:
    lines = text.split("\n")
    if variant == "legacy":
        lines = drop_repeats_by_characters(lines, LEGACY_COPY if threshold is None else threshold)
    else:
        lines = drop_repeats(lines, COPY if threshold is None else threshold, compat=compat)
    lines = join_fragments(lines)
    return "\n".join(join_broken_words(lines) if len(lines) > 1 else lines)


def fold_lines(text: Column, variant: str = "sequence", threshold: float | None = None, compat: bool = False) -> Column:
    """The three order-dependent steps on whole texts, in one trip to Python. Of a batch only PIECE texts are Python strings at a time."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        made = [pa.array([], pa.string())]
        for at in range(0, len(texts), PIECE):
            made.append(pa.array([None if t is None else folded(t, variant, threshold, compat) for t in texts.slice(at, PIECE).to_pylist()], pa.string()))
        out = pa.concat_arrays(made)
        del made
        hand_back()
        return out

    return run(text)


def convert_headers(lines: Column) -> Column:
    """【title】 becomes one entry: a line end, "## title", a line end."""
    one = lambda x: F.regexp_extract(strip(x), r"(?s)^【(.+)】$", 1)
    return F.transform(lines, lambda x: F.when(one(x) != "", F.concat(F.lit("\n## "), one(x), F.lit("\n"))).otherwise(x))


def format_numbers(lines: Column) -> Column:
    """"1.x" becomes "**1.** x", after an empty line unless the entry before is blank."""
    numbered = r"(?s)^(\p{Nd}+)\.([^\s\p{Nd}].*)$"

    def entry(x: Column, i: Column) -> Column:
        s = strip(x)
        made = F.regexp_replace(s, numbered, r"**$1.** $2")
        before = F.when(i > 0, strip(F.get(lines, i - 1)) != "").otherwise(F.lit(False))
        return F.when(s.rlike(numbered), F.when(before, F.array(F.lit(""), made)).otherwise(F.array(made))).otherwise(F.array(x))

    return F.flatten(F.transform(lines, entry))


def space_paragraphs(lines: Column) -> Column:
    """An empty line after a Chinese full stop, if the next line is longer than 15 characters and no heading, list or number."""

    def entry(x: Column, i: Column) -> Column:
        after = strip(F.coalesce(F.get(lines, i + 1), F.lit("")))
        wanted = F.right(strip(x), F.lit(1)).isin("。", "！", "？") & (F.length(after) > 15) & ~after.rlike(r"^[#\-*\p{Nd}]")
        return F.when(wanted, F.array(x, F.lit(""))).otherwise(F.array(x))

    return F.flatten(F.transform(lines, entry))


def collapse_blanks(lines: Column) -> Column:
    """Of neighbouring blank entries the first."""
    return F.filter(lines, lambda x, i: (strip(x) != "") | (i == 0) | (strip(F.coalesce(F.get(lines, i - 1), F.lit("x"))) != ""))


def clean_text(texts: DataFrame, column: str = "text", variant: str = "sequence", threshold: float | None = None, compat: bool = False) -> DataFrame:
    """texts with the column cleaned: repeats dropped, fragments and broken words joined, then formatted. Null stays null, "" stays "".

    variant "legacy" drops repeats by characters in common.
    """
    return format_only(texts.withColumn(column, fold_lines(F.col(column), variant, threshold, compat)), column)


def format_only(texts: DataFrame, column: str = "text") -> DataFrame:
    """Headers, numbered lists, paragraph spacing and blank runs: one array column after another, so that no step is repeated within the next."""
    out = texts.withColumn("__lines", F.split(column, "\n", -1))
    for step in (convert_headers, format_numbers, space_paragraphs, collapse_blanks):
        out = out.withColumn("__lines", step(F.col("__lines")))
    return out.withColumn(column, F.array_join("__lines", "\n")).drop("__lines")
