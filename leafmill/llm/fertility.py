"""Quality rules from tokeniser fertility: what public vocabularies make of a text, held against bands by language."""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, small, table, tidy

#: Folder of the public vocabularies (a parameter everywhere) and the files read from it.
TOKENIZERS = "/opt/tokenizers"
PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.tiktoken"
#: Words of the byte-level vocabulary, as its authors split text.
BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokenised words that one worker remembers, per vocabulary; beyond it the memory starts anew. It changes no result.
REMEMBERED = 400_000

#: Texts that are measured at once.
CHUNK = 500

METRICS = ("piece_chars", "byte_chars", "fallback_share", "token_entropy")
#: Band of a group: median -/+ WIDTH[metric] * max(median absolute deviation, LEAST[metric]).
#: The chance spread of a mean falls with the length of the text, so texts of few tokens get wider bands:
#: the width is multiplied by sqrt(1 + SHORT / tokens). Entropy is held as a share of its bound (see FULL), so its numbers are of that scale.
WIDTH = {"piece_chars": (6.0, 8.0), "byte_chars": (6.0, 8.0), "fallback_share": (None, 8.0), "token_entropy": (2.0, None)}
LEAST = {"piece_chars": 0.06, "byte_chars": 0.06, "fallback_share": 0.004, "token_entropy": 0.05}
SHORT = 200.0
#: Entropy is held against log2(tokens), its upper bound, below this number of tokens.
FULL = 2048.0
#: A group's spread is averaged with that of all texts, which counts as so many of the group's own; medians are the group's.
SHRINK = 50

SCHEMA = "doc_id long, grp string, th long, n_tokens long, piece_chars double, byte_chars double, fallback_share double, token_entropy double"


class Vocabularies:
    """Both tokenisers behind a memory of the words they have seen.

    A unit is a word with the space or line end before it. Encoding unit by unit is exact: no piece
    has a space mark after another character or holds a line end, and byte-level BPE merges within the
    matches of its pattern, which cross no single white-space character. Texts with two in a row go another way.
    """

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=str(Path(folder, PIECES)))
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(folder, BYTES).open("rb"))}
        self.bytes = tiktoken.Encoding("public", pat_str=BYTE_WORDS, mergeable_ranks=ranks, special_tokens={})
        self.n = self.pieces.vocab_size()
        self.fallback = np.array([self.pieces.is_byte(i) or self.pieces.is_unknown(i) for i in range(self.n)])
        self.lead = len(self.pieces.encode("\n"))
        self.slow = re.compile(r"\s\s")
        self.spaced = re.compile(r"\n[^ \n]*| +[^ \n]*")
        piece = [self.pieces.id_to_piece(i) for i in range(self.n)]
        self.piece_bytes = np.array([1 if self.pieces.is_byte(i) else len(x.replace("\u2581", " ").encode()) for i, x in enumerate(piece)])
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.token_bytes[rank] = len(token)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)  # pieces of all units, one after the other
        self.end = 0
        self.starts = np.empty(1 << 14, np.int64)
        self.pieces_in = np.empty(1 << 14, np.int32)
        self.bytes_in = np.empty(1 << 14, np.int32)

    def learn(self, keys: list[str]) -> None:
        """Tokenise new units, many in one string; where units end is found from the tokens' lengths in bytes."""
        k = len(self.known)
        while k + len(keys) > len(self.starts):
            self.starts, self.pieces_in, self.bytes_in = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.pieces_in, self.bytes_in))
        plain = [u for u in keys if u[:1] != "\x01" and "\u2581" not in u and u[:1] not in (" ", "")]
        odd = [u for u in keys if not (u[:1] != "\x01" and "\u2581" not in u and u[:1] not in (" ", ""))]
        units = [u if u[0] == "\n" else " " + u for u in plain]
        flats, counts, by_bytes = [], [], []
        for lo in range(0, len(units), 64):
            some = units[lo : lo + 64]
            ends = np.cumsum([len(u.encode()) for u in some])
            text = "".join(some)
            flat = np.array(self.pieces.encode("\n" + text)[self.lead :], np.int32)
            counts.append(np.diff(np.searchsorted(np.cumsum(self.piece_bytes[flat]), ends, "right"), prepend=0))
            flats.append(flat)
            tokens = np.array(self.bytes.encode_ordinary(text))
            by_bytes.append(np.diff(np.searchsorted(np.cumsum(self.token_bytes[tokens]), ends, "right"), prepend=0))
        for u in odd:  # a text's first unit, runs of spaces, space marks
            bare = u[1:] if u[:1] == "\x01" else u
            flat = np.array(self.pieces.encode("\n" + (bare if bare[:1] == "\n" else " " + bare))[self.lead :], np.int32)
            flats.append(flat)
            counts.append([len(flat)])
            by_bytes.append([len(self.bytes.encode_ordinary(bare if u[:1] == "\x01" or bare[:1] == "\n" else " " + bare))])
        flat, lengths = np.concatenate(flats), np.concatenate(counts).astype(np.int64)
        while self.end + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.end : self.end + len(flat)] = flat
        new = slice(k, k + len(keys))
        self.starts[new] = self.end + np.cumsum(lengths) - lengths
        self.pieces_in[new] = lengths
        self.bytes_in[new] = np.concatenate(by_bytes)
        self.end += len(flat)
        self.known.update(zip(plain + odd, range(k, k + len(keys))))

    def units(self, text: str) -> tuple[dict[str, int], int]:
        """Units with their numbers, and the byte-level tokens if those can't be had unit by unit (else -1).

        A unit's key leaves out the space in front; "\x01" marks the first word, which has none but for the piece tokeniser.
        """
        text = text.replace("\x01", "\x02")  # another control character, of as many tokens
        if self.slow.search(text) or text[0].isspace():
            found = self.spaced.findall(" " + text)
            return Counter([u[1:] if u[0] == " " else u for u in found]), len(self.bytes.encode_ordinary(text))
        words = text.replace("\n", " \n").split(" ")
        words[0] = "\x01" + words[0]
        return Counter(words), -1

    def measure(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Of each text (none empty): piece tokens, characters per piece, characters per byte-level token, fallback share, token entropy."""
        if len(self.known) > REMEMBERED:
            self.forget()
        known = self.known
        rows, times, whole, per = [], [], [], []
        for text in texts:
            counts, by_bytes = self.units(text)
            found = list(map(known.get, counts))
            if None in found:
                self.learn([u for u, x in zip(counts, found) if x is None])
                found = map(known.__getitem__, counts)
            rows.extend(found)
            times.extend(counts.values())
            per.append(len(counts))
            whole.append(by_bytes)
        at, times = np.array(rows, np.int64), np.array(times, np.int64)
        doc = np.repeat(np.arange(len(texts)), per)
        lengths = self.pieces_in[at].astype(np.int64)
        total = lambda x: np.bincount(doc, weights=x, minlength=len(texts))
        n = total(times * lengths)
        by_bytes = np.where(np.array(whole) >= 0, whole, total(times * self.bytes_in[at]))
        ends = np.cumsum(lengths)
        flat = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[at] - ends + lengths, lengths)].astype(np.int64)
        key, weight = np.repeat(doc, lengths) * self.n + flat, np.repeat(times, lengths)
        order = np.argsort(key)
        key, weight = key[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        c = np.add.reduceat(weight, first).astype(float)
        owner, ids = key[first] // self.n, key[first] % self.n
        sums = lambda x: np.bincount(owner, weights=x, minlength=len(texts))
        fallback = sums(np.where(self.fallback[ids], c, 0.0)) / n
        entropy = np.maximum(0.0, np.log2(n) - sums(c * np.log2(c)) / n)
        chars = np.fromiter(map(len, texts), np.int64, len(texts))
        return n.astype(np.int64), chars / n, chars / np.maximum(1, by_bytes), fallback, entropy


def script() -> Column:
    """The script that most letters of a text's language group are written in, for rows without a language."""
    kinds = (("han", r"\p{IsHan}"), ("kana", r"[\p{IsHiragana}\p{IsKatakana}]"), ("cyrillic", r"\p{IsCyrillic}"), ("arabic", r"\p{IsArabic}"), ("latin", r"\p{IsLatin}"))
    best = F.lit("other")
    most = F.lit(0)
    for name, letters in reversed(kinds):
        n = F.regexp_count("text", F.lit(letters))
        best = F.when(n > most, F.lit(name)).otherwise(best)
        most = F.greatest(most, n)
    return best


def measured_parts(vocabularies: Vocabularies, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SCHEMA's rows of batches of (doc_id, grp, th, text); no more than CHUNK texts are Python strings at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK):
            part = batch.slice(lo, CHUNK)
            cols = vocabularies.measure(part.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *map(pa.array, cols)], names=["doc_id", "grp", "th", "n_tokens", *METRICS])


def measure(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """SCHEMA's columns for each row with a text; grp is the language, or "script:<name>" without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from measured_parts(Vocabularies(folder), batches)

    group = F.when(F.coalesce("lang", F.lit("")) != "", F.col("lang")).otherwise(F.concat(F.lit("script:"), script()))
    some = docs.filter(F.coalesce("text", F.lit("")) != "")
    return some.select(F.col("doc_id").cast("long"), group.alias("grp"), F.xxhash64("text").alias("th"), "text").mapInArrow(tidy(run), SCHEMA)


def _values() -> dict[str, Column]:
    """What is held against the bands: the metrics, entropy as a share of what so many tokens can have."""
    out = {m: F.col(m) for m in METRICS}
    out["token_entropy"] = F.col("token_entropy") / F.log2(F.least(F.lit(FULL), F.col("n_tokens")) + 1)
    return out


def bands(measured: DataFrame) -> DataFrame:
    """A row per group (and one, grp null, for all texts) with the median and spread of each value, over all rows."""
    values = measured.select("grp", *[v.alias(m) for m, v in _values().items()])
    # exact enough at any size: the sketch's rank error is at most 1 / 10,000
    middles = [F.count("*").alias("n"), *[F.percentile_approx(m, 0.5, 10_000).alias(f"{m}_mid") for m in METRICS]]
    spreads = [F.percentile_approx(F.abs(F.col(m) - F.col(f"{m}_mid")), 0.5, 10_000).alias(f"{m}_mad") for m in METRICS]
    mid = materialize(values.groupBy("grp").agg(*middles), "fertility-middles")
    own = values.join(small(mid, MAX_BROADCAST_GROUPS), "grp").groupBy("grp").agg(*spreads)
    middle = materialize(values.agg(*middles), "fertility-middles")
    every = values.crossJoin(F.broadcast(middle)).agg(*spreads)
    return mid.join(own, "grp").unionByName(middle.withColumn("grp", F.lit(None).cast("string")).crossJoin(every))


#: Groups whose bands are broadcast; with more, Spark joins them by group.
MAX_BROADCAST_GROUPS = 10_000


def judge(measured: DataFrame, band: DataFrame) -> DataFrame:
    """measured with `reasons`, the metrics that lie outside the bands, in the order of METRICS."""
    band = materialize(band, "fertility-bands")
    all_ = band.filter("grp is null").select(*[F.col(f"{m}_{x}").alias(f"{m}_{x}_all") for m in METRICS for x in ("mid", "mad")])
    own = band.filter(F.col("grp").isNotNull()).withColumnRenamed("grp", "g").withColumnRenamed("n", "n_group")
    if own.count() <= MAX_BROADCAST_GROUPS:
        own = F.broadcast(own)
    joined = measured.join(own, F.col("grp") == F.col("g")).crossJoin(F.broadcast(all_))
    wider = F.sqrt(1 + F.lit(SHORT) / F.col("n_tokens"))
    tests = []
    for m, value in _values().items():
        mid = F.col(f"{m}_mid")
        mad = (F.col("n_group") * F.col(f"{m}_mad") + F.lit(SHRINK) * F.col(f"{m}_mad_all")) / (F.col("n_group") + F.lit(SHRINK))
        unit = F.greatest(mad, F.lit(LEAST[m])) * wider
        low, high = WIDTH[m]
        sides = ([value < mid - low * unit] if low else []) + ([value > mid + high * unit] if high else [])
        tests.append(F.when(reduce(lambda a, b: a | b, sides), F.lit(m)))
    return joined.select(*measured.columns, F.filter(F.array(*tests), lambda x: x.isNotNull()).alias("reasons"))


def quality_rules(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, grp, n_tokens, piece_chars, byte_chars, fallback_share, token_entropy, reasons, keep) for every row.

    A text is kept if each measure lies in the band of its language: the median of all texts of that
    language and a number of median absolute deviations either way. Texts without a language go by
    their main script. The fewer texts a group has, the more its deviations go by those of all texts. Null and empty texts have null measures and
    the reason "empty", and are not kept. Rows are judged one by one, repeated ones alike; doc_ids may be
    null. Texts are tokenised whole. An empty table gives no rows.
    """
    measured = materialize(measure(docs, folder), "fertility")
    judged = judge(measured, bands(measured)).drop("th").withColumn("keep", F.size("reasons") == 0)
    empty = docs.filter(F.coalesce("text", F.lit("")) == "").select(F.col("doc_id").cast("long"), F.col("lang").alias("grp"))
    empty = empty.withColumns({"n_tokens": F.lit(0).cast("long")} | {m: F.lit(None).cast("double") for m in METRICS})
    return judged.unionByName(empty.withColumns({"reasons": F.array(F.lit("empty")), "keep": F.lit(False)}))


def keep_good(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """The rows of docs that quality_rules keeps, unchanged. Rejected texts, which are few, are joined out by doc_id and hash."""
    measured = materialize(measure(docs, folder), "fertility")
    bad = judge(measured, bands(measured)).filter(F.size("reasons") > 0)
    bad = materialize(bad.select(F.col("doc_id").alias("__qr_id"), F.col("th").alias("__qr_th"), F.col("grp").alias("__qr_grp")).distinct(), "fertility-bad")
    if bad.count() <= MAX_BROADCAST_BAD:
        bad = F.broadcast(bad)
    lang = F.coalesce(docs["lang"], F.lit(""))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__qr_id")) & (F.xxhash64(docs["text"]) == F.col("__qr_th")) & ((lang == F.col("__qr_grp")) | (lang == ""))
    return docs.filter(F.coalesce("text", F.lit("")) != "").join(bad, same, "left_anti")


#: Rejected texts up to this number are broadcast; with more, Spark joins them by doc_id.
MAX_BROADCAST_BAD = 1_000_000


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
