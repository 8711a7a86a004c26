"""Secret scans: sliding-window Shannon entropy by character class over candidate strings."""

from __future__ import annotations

import math
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import table, text_batches

#: A candidate is a run of at least WINDOW of these characters.
ALPHABET = r"A-Za-z0-9+/=_\-"
WINDOW = 20
#: Kinds of characters, each with a mark.
MARKS = str.maketrans({c: m for m, cs in (("0", string.digits), ("A", string.ascii_uppercase), ("a", string.ascii_lowercase), ("+", "+/=_-")) for c in cs})
#: Character classes with the window entropy, in bits a character, from which on a run is a finding. A class
#: covers the runs of its characters within a candidate. Of each group of marks a run needs so many characters. Patterns
#: must take time in proportion to the text: digits before a letter are tried at their first one only.
CLASSES: tuple[tuple[str, str, float, tuple[tuple[str, int], ...]], ...] = (
    ("hex", r"(?:(?<![0-9])[0-9]++)?[a-f][0-9a-f]*|(?:(?<![0-9])[0-9]++)?[A-F][0-9A-F]*", 3.0, (("0", 1), ("Aa", 1))),
    ("alnum", r"[A-Za-z0-9]+", 3.7, (("0", 1), ("A", 1), ("a", 1))),
    ("onecase", r"(?:(?<![0-9])[0-9]++)?[a-z][0-9a-z]*|(?:(?<![0-9])[0-9]++)?[A-Z][0-9A-Z]*", 3.6, (("0", 3), ("Aa", 1))),
    ("base64", r"[A-Za-z0-9+/=_\-]+", 3.9, (("0", 1), ("A", 1), ("a", 1), ("+", 1))),
)
#: A finding is suppressed if its text, or what stands just before it, matches one of these.
ALLOWED_TEXT = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
    r"(?i).*(?:example|changeme|placeholder|your[-_]?(?:api)?[-_]?key).*",
    r"(?i)(?:0123456789abcdef|abcdefghijklmnopqrstuvwxyz).*",
)
ALLOWED_BEFORE = (r"(?i)(?:sha-?(?:1|256|384|512)|md5|commit|integrity|checksum|digest)[\"']?\s*[:=\-]?\s*[\"']?$", r"data:[a-z]+/[a-z+.\-]+;base64,$")
#: Characters before a finding that ALLOWED_BEFORE sees.
BEFORE = 40

SCHEMA = "doc_id long, start long, length long, class string, entropy double, secret string"


def window_entropy(run: str, window: int, terms: list[float]) -> float:
    """The largest entropy of any `window` consecutive characters, each step changing two counts."""
    counts: dict[str, int] = {}
    total = 0.0  # sum of c log2 c
    most = -1.0
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += terms[n + 1] - terms[n]
        if i >= window:
            old = run[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += terms[n - 1] - terms[n]
        if i >= window - 1:
            most = max(most, terms[window] - total)
    return most / window


def findings(text: str, window: int = WINDOW, classes: tuple[tuple[str, str, float, tuple[tuple[str, int], ...]], ...] = CLASSES) -> list[tuple[int, int, str, float, str]]:
    """(start, length, class, entropy, text) of each finding of one text; brute-force tests call it too."""
    return list(_scanner(window, classes, ALLOWED_TEXT, ALLOWED_BEFORE)(text))


def _scanner(window, classes, allowed_text, allowed_before):
    terms = [0.0] + [n * math.log2(n) for n in range(1, window + 2)]
    candidate = re.compile(f"[{ALPHABET}]{{{window},}}")
    compiled = [(name, re.compile(run), least, needs) for name, run, least, needs in classes]
    quiet = [re.compile(x) for x in allowed_text]
    before = [re.compile(x) for x in allowed_before]

    def scan(text: str) -> Iterator[tuple[int, int, str, float, str]]:
        for c in candidate.finditer(text):
            whole = c.group()
            allowed = None
            # findings of earlier classes by their start, and the furthest end of any up to there
            starts: list[int] = []
            ends: list[int] = []
            for name, runs, least, needs in compiled:
                own: list[tuple[int, int]] = []
                for r in runs.finditer(whole):
                    if r.end() - r.start() < window:
                        continue
                    kinds = r.group().translate(MARKS)
                    if any(sum(kinds.count(m) for m in marks) < n for marks, n in needs):
                        continue
                    lo, hi = c.start() + r.start(), c.start() + r.end()
                    k = bisect_right(starts, lo)
                    if k and ends[k - 1] >= hi:
                        continue  # an earlier, narrower class has it
                    bits = window_entropy(r.group(), window, terms)
                    if bits < least:
                        continue
                    if allowed is None:
                        allowed = any(q.fullmatch(whole) for q in quiet)
                    if allowed or any(q.fullmatch(r.group()) for q in quiet):
                        continue
                    head = text[max(0, lo - BEFORE) : lo]
                    if any(b.search(head) for b in before):
                        continue
                    own.append((lo, hi))
                    yield lo, hi - lo, name, bits, r.group()
                if own:
                    both = sorted([*zip(starts, ends), *own])
                    starts = [a for a, _ in both]
                    ends = list(accumulate((b for _, b in both), max))

    return scan


def scan_secrets(
    docs: DataFrame, window: int = WINDOW, classes: tuple[tuple[str, str, float, tuple[tuple[str, int], ...]], ...] = CLASSES,
    allowed_text: tuple[str, ...] = ALLOWED_TEXT, allowed_before: tuple[str, ...] = ALLOWED_BEFORE,
) -> DataFrame:
    """(doc_id, start, length, class, entropy, secret), a row per finding; start counts characters from 0.

    Candidates are found in the JVM; only texts that have one go to Python. Classes are tried in
    order, and a stretch that one class has found is not reported again by a later one. Entropies are
    rounded to 6 places after the comparison. Null and empty texts give no rows; null doc_ids are kept as null;
    repeated rows are each reported; texts are scanned whole whatever their length. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(window, classes, allowed_text, allowed_before)
        for batch, texts in text_batches(batches):
            rows = [(i, *f) for i, text in enumerate(texts) for f in scan(text)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.string()), pa.array([round(x, 6) for x in cols[4]], pa.float64()), pa.array(cols[5], pa.string())],
                names=["doc_id", "start", "length", "class", "entropy", "secret"],
            )

    some = docs.select(F.col("doc_id").cast("long"), "text").filter(F.col("text").rlike(f"[{ALPHABET}]{{{window}}}"))
    return some.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
