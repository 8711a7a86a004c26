"""LM scoring by unbounded n-grams: short ones counted by hash, long ones in suffix arrays over what the corpus shares with the queries."""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import NOT_SPACE, discard, list_values, materialize, scratch_root, table, tidy

#: Stretches of up to so many tokens, 2 at least, are counted by hash; only corpus text that shares one of that length with a query goes into suffix arrays.
GRAM = 6
#: Corpus tokens whose stretches a task counts at once, and query tokens whose stretches it looks up among the counts at once.
COUNT_TOKENS, FOUND_TOKENS = 4_000_000, 1_000_000
#: Different stretches of the queries in one part, about, and partial counts that are added up at once: what a task that adds up counts holds.
PART_GRAMS, ADDED_GRAMS = 500_000, 2_000_000
#: Corpus tokens in one suffix array: what a task holds at once, whatever the size of the corpus.
SHARD_TOKENS = 2_000_000
#: Query tokens that are looked up in a shard at once; a shard is built once, whatever the number of such blocks.
PASS_TOKENS = 200_000
#: Matches are extended token by token up to this length; longer ones are found by binary search with hashed comparisons.
DEEP = 16
#: Weight, in occurrences, of the unigram distribution in the smoothed probability.
ALPHA = 1.0
#: Shards that a task works through one after the other, and query tokens whose counts it adds up over them before it passes them on; those of further ones leave shard by shard.
SHARDS_A_TASK, MERGED_TOKENS = 4, 4_000_000


def tokens(text: str | None) -> list[str]:
    """What token_hashes hashes: the words between white space, as they are."""
    return re.findall(NOT_SPACE + "+", text or "")


def token_hashes(column: str):
    return F.transform(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(f"({NOT_SPACE}+)")), lambda w: F.xxhash64(w))


class Shard:
    """A suffix array over token ids; suffixes are sorted by their first `depth` tokens at least."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, depth: int, numbers: np.ndarray | None = None):
        """numbers: what document each stretch of `lengths` hashes belongs to, from 0; without, each is one of its own."""
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        # a separator, id 0, after each document
        n = len(hashes) + len(lengths)
        self.text = np.zeros(n + 1, np.int32)
        at = np.arange(len(hashes)) + np.repeat(np.arange(len(lengths)), lengths)
        self.text[at] = ids + 1
        counts = np.bincount(ids, minlength=len(self.vocabulary))
        del ids
        self.sa = self._sort(self.text, depth, at)
        # where the suffixes of each first token begin, and their first two tokens as one number
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.pairs = self.text[self.sa].astype(np.int64) * (len(self.vocabulary) + 1) + self.text[self.sa + 1] if depth > 1 else None
        self.total = len(hashes)
        self.numbers = np.repeat((np.arange(len(lengths)) if numbers is None else numbers).astype(np.int32), lengths + 1)
        self.lengths = lengths if numbers is None else np.bincount(numbers, weights=lengths).astype(np.int64)
        self.sums: tuple[np.ndarray, np.ndarray] | None = None
        self.owners: tuple[np.ndarray, ...] | None = None

    def _owners(self) -> tuple[np.ndarray, ...]:
        """By place in the suffix array: the document; where the run of suffixes of that document begins and ends. Last, documents and places as sorted keys."""
        if self.owners is None:
            n = len(self.sa)
            doc = self.numbers[self.sa]
            change = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if n else np.zeros(0, np.int64)
            size = np.diff(np.append(change, n))
            change, size = change.astype(np.int32), size.astype(np.int32)
            self.owners = doc, np.repeat(change, size), np.repeat(change + size, size), np.sort(doc * np.int64(n + 1) + np.arange(n))
        return self.owners

    def others(self, lo: np.ndarray, hi: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        """Suffixes in each range, without those of the document `own` (-1: none)."""
        if own is None:
            return hi - lo
        *_, keys = self._owners()
        n, mine, count = len(self.sa) + 1, np.flatnonzero(own >= 0), hi - lo
        count[mine] -= np.searchsorted(keys, own[mine] * n + hi[mine]) - np.searchsorted(keys, own[mine] * n + lo[mine])
        return count

    @staticmethod
    def _sort(text: np.ndarray, depth: int, starts: np.ndarray) -> np.ndarray:
        """Prefix doubling; only groups that are still tied are sorted again. Separators start no suffix."""
        starts = starts.astype(np.int32)
        sa = starts[np.argsort(text[starts], kind="stable")]
        key = text[sa]
        change = np.concatenate([[True], key[1:] != key[:-1]])
        # a token's rank is the place of the first suffix of its group, 1 at least; separators keep 0
        group = np.maximum.accumulate(np.where(change, np.arange(len(sa), dtype=np.int32), np.int32(0)))
        rank = np.zeros(len(text), np.int32)
        rank[sa] = group + 1
        width = 1
        while width < depth:
            tied = np.flatnonzero(~(change & np.concatenate([change[1:], [True]]))) if len(sa) else sa
            if not len(tied):
                break
            at = sa[tied]
            # a suffix that meets a separator within `width` differs from no other by what follows it
            after = np.where(at + width < len(text), rank[np.minimum(at + width, len(text) - 1)], 0)
            key = group[tied].astype(np.int64) * (len(text) + 1) + after
            order = np.argsort(key)
            key, at = key[order], at[order]
            del order, after
            sa[tied] = at
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            change[tied] = change[tied] | fresh
            group[tied] = np.maximum.accumulate(np.where(fresh, tied, 0))
            rank[at] = group[tied] + 1
            width *= 2
        return sa

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of query tokens; -1 where the shard doesn't have them."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, -1)

    def narrow(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray | int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each range of suffixes that share `depth` tokens, the part whose next token is the wanted one, by binary search."""
        bounds, a = [], lo
        for more in (0, 1):  # the first suffix whose token is >= wanted, then > wanted
            a, b = a.copy(), hi.copy()
            open_ = np.flatnonzero(a < b)
            while len(open_):
                mid = (a[open_] + b[open_]) >> 1
                here = self.text[np.minimum(self.sa[mid] + (depth if isinstance(depth, int) else depth[open_]), len(self.text) - 1)]
                right = here < wanted[open_] + more
                a[open_[right]] = mid[right] + 1
                b[open_[~right]] = mid[~right]
                open_ = open_[a[open_] < b[open_]]
            bounds.append(a)
        return bounds[0], bounds[1]

    def first(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with each token."""
        return self.starts[ids - 1], self.starts[ids]

    def second(self, ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with those two tokens."""
        wanted, at = np.unique(ids * np.int64(len(self.vocabulary) + 1) + after, return_inverse=True)
        return np.searchsorted(self.pairs, wanted)[at], np.searchsorted(self.pairs, wanted, "right")[at]

    def _deep(self, ids: np.ndarray):
        """bound(starts, lengths, after): the first suffix not less than (after: greater than) those stretches of the query; lce: their common length with suffixes."""
        text, sa, n = self.text, self.sa, len(ids)
        kept = self.sums
        if kept is None or len(kept[0]) <= max(len(text), n):
            power = np.full(max(len(text), n) + 1, 0x9E3779B97F4A7C15, np.uint64)
            power[0] = 1
            power = np.cumprod(power)
        else:
            power = kept[0]

        def sums(x: np.ndarray) -> np.ndarray:
            h = (x.astype(np.int64) + 2).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum((h ^ (h >> np.uint64(32))) * power[: len(x)])])

        of_text, of_query = kept[1] if kept else sums(text), sums(ids)
        self.sums = power, of_text

        def lce(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
            lo, hi = np.zeros(len(a), np.int64), np.minimum(most, len(text) - a)
            while (lo < hi).any():
                mid = (lo + hi + 1) >> 1
                same = (of_text[a + mid] - of_text[a]) * power[b] == (of_query[b + mid] - of_query[b]) * power[a]
                lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
            return lo

        def bound(b: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
            lo, hi = np.zeros(len(b), np.int64), np.full(len(b), len(sa), np.int64)
            while (lo < hi).any():
                mid = np.minimum((lo + hi) >> 1, len(sa) - 1)
                a = sa[mid].astype(np.int64)
                k = lce(a, b, size)
                less = (a + k >= len(text)) | (text[np.minimum(a + k, len(text) - 1)] < ids[np.minimum(b + k, n - 1)])
                right = (lo < hi) & np.where(k >= size, after, less)
                lo, hi = np.where(right, mid + 1, lo), np.where(right | (lo >= hi), hi, mid)
            return lo

        return lce, bound

    def look_up(self, hashes: np.ndarray, ends: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """For each query token: the length of the longest context before it that occurs here, its occurrences,
        those that this token follows, and the token's own number.

        hashes: all queries' tokens in a row; ends: for each token, where its query ends; own: for each token, the
        document of this shard that its query is (-1: none) and whose occurrences don't count.
        """
        mine = (lambda x: None) if own is None else (lambda x: own[x])
        n, ids = len(hashes), self.ids(hashes)
        reach = np.arange(n)  # ids[s:reach[s]] is the longest stretch from s that occurs
        levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # by length: starts, range
        live = np.flatnonzero(ids > 0)
        lo = hi = live
        depth = 0
        while len(live) and depth < DEEP:
            if depth == 0:
                lo, hi = self.first(ids[live])
            elif depth == 1:
                lo, hi = self.second(ids[live], ids[live + 1])
            else:
                lo, hi = self.narrow(lo, hi, depth, ids[live + depth])
            some = self.others(lo, hi, mine(live)) > 0
            live, lo, hi = live[some], lo[some], hi[some]
            depth += 1
            levels.append((live, lo, hi))
            reach[live] = live + depth
            on = (live + depth < ends[live]) & (ids[np.minimum(live + depth, n - 1)] > 0)
            live, lo, hi = live[on], lo[on], hi[on]
        if len(live):  # these go on beyond DEEP tokens
            lce, bound = self._deep(ids)
            left = ends[live] - live
            at = bound(live, left, False)
            near = []
            for p, step in ((at - 1, 1), (at, 2)):
                if own is not None:  # past the run of suffixes of the query's own document
                    doc, *runs, _ = self._owners()
                    inside = np.clip(p, 0, len(self.sa) - 1)
                    skip = (p == inside) & (doc[inside] == own[live])
                    p = np.where(skip, runs[step - 1][inside] - (step == 1), p)
                inside = np.clip(p, 0, len(self.sa) - 1)
                common = lce(self.sa[inside].astype(np.int64), live, left)
                near.append(common if own is None else np.where(p == inside, common, 0))
            reach[live] = live + np.maximum(*near)
        unigram = np.zeros(n, np.int64)
        if levels:
            unigram[levels[0][0]] = self.others(levels[0][1], levels[0][2], mine(levels[0][0]))
        # the context of token i starts at the first s whose stretch reaches i; reach never falls within a query
        start = np.minimum(np.searchsorted(np.maximum.accumulate(reach), np.arange(n), "left"), np.arange(n))
        first = np.zeros(n, np.int64)
        begins = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]])) if n else first
        first[begins] = begins
        start = np.maximum(start, np.maximum.accumulate(first))
        length = np.arange(n) - start
        total = self.total if own is None else self.total - np.where(own >= 0, self.lengths[own], 0)
        context, follow = np.where(length > 0, 0, total), np.where(length > 0, 0, unigram)
        for d, (live, lo, hi) in enumerate(levels, 1):  # stretches of d tokens that are the context of the token after them
            i = live + d
            ok = i < ends[live]
            i, l, h, s = i[ok], lo[ok], hi[ok], live[ok]
            here = start[i] == s
            i, l, h = i[here], l[here], h[here]
            context[i] = self.others(l, h, mine(i))
            known = ids[i] > 0
            i, l, h = i[known], l[known], h[known]
            if len(i):
                a, b = self.second(ids[i - 1], ids[i]) if d == 1 else self.narrow(l, h, d, ids[i])
                follow[i] = self.others(a, b, mine(i))
        i = np.flatnonzero(length > len(levels))
        if len(i):
            l, h = bound(start[i], length[i], False), bound(start[i], length[i], True)
            context[i] = self.others(l, h, mine(i))
            known = ids[i] > 0
            i, l, h = i[known], l[known], h[known]
            a, b = self.narrow(l, h, length[i], ids[i])
            follow[i] = self.others(a, b, mine(i))
        return length, context, follow, unigram


COUNTS = "row long, part int, total long, length array<int>, context array<long>, follow array<long>, unigram array<long>"
SUMS = "row long, log_prob double, mean_match double, longest_match long"


def _added(one: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Length, context, follow and unigram counts of both: where one context is longer its counts are the sum."""
    length, context, follow, unigram = one
    length0, context0, follow0, unigram0 = other
    less, more = length < length0, length > length0
    return np.maximum(length, length0), np.where(less, 0, context) + np.where(more, 0, context0), np.where(less, 0, follow) + np.where(more, 0, follow0), unigram + unigram0


def _shards(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Token hashes, document lengths and rows, about `most` (SHARD_TOKENS) tokens at a time; a longer document is a shard of its own."""
    most = most or SHARD_TOKENS
    held, sizes, rows, n = [], [], [], 0
    for batch in batches:
        values, offsets = list_values(batch.column("tokens"))
        row = batch.column("row").to_numpy()
        lengths = np.diff(offsets)
        lo = 0
        while lo < len(lengths):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most - n, "right")) - 1)
            held.append(values[offsets[lo] : offsets[hi]])
            sizes.append(lengths[lo:hi])
            rows.append(row[lo:hi])
            n += int(offsets[hi] - offsets[lo])
            lo = hi
            if n >= 0.9 * most:
                whole = np.concatenate(held), np.concatenate(sizes), np.concatenate(rows)
                held, sizes, rows, n = [], [], [], 0
                yield whole
                del whole
    if n:
        yield np.concatenate(held), np.concatenate(sizes), np.concatenate(rows)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _row_grams(rows: np.ndarray) -> np.ndarray:
    """Documents among the stretches: as if of 0 tokens."""
    return _mixed(rows.astype(np.int64).view(np.uint64) ^ np.uint64(0xA0761D6478BD642F))


def _longer(h: np.ndarray, at: np.ndarray, d: int, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of stretches of d tokens that have one more within their document, with it."""
    on = at + d < ends[at]
    at = at[on]
    return _mixed(h[on] * np.uint64(0x9E3779B97F4A7C15) + tokens[at + d]), at


class Sieve:
    """Bits of the queries' stretches of one length, two for each, kept in a file: what isn't among them is told apart but for about 1 in 70."""

    def __init__(self, log: int, bits: np.ndarray):
        self.log, self.bits = log, bits

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - self.log)
        return (h * np.uint64(0xE7037ED1A0B428DB)) >> shift, (h * np.uint64(0x8EBC6AF09C88C6E3)) >> shift

    def add(self, h: np.ndarray) -> None:
        place = np.unique(np.concatenate(self.places(h)))
        if len(place):
            byte = place >> np.uint64(3)
            first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
            self.bits[byte[first]] |= np.bitwise_or.reduceat(np.uint8(1) << (place & np.uint64(7)).astype(np.uint8), first)

    def has(self, h: np.ndarray) -> np.ndarray:
        one, other = self.places(h)
        found = np.flatnonzero(self._bit(one))
        out = np.zeros(len(h), bool)
        out[found[self._bit(other[found])]] = True
        return out

    def _bit(self, place: np.ndarray) -> np.ndarray:
        return (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _open_sieve(folder: str, level: int, log: int) -> Sieve:
    system, path = pa.fs.FileSystem.from_uri(f"{folder}/{level}")
    if isinstance(system, pa.fs.LocalFileSystem):  # workers share its pages
        return Sieve(log, np.memmap(path, np.uint8, "r"))
    with system.open_input_file(path) as file:
        return Sieve(log, np.frombuffer(file.read(), np.uint8))


def _sieves(spark: SparkSession, files: list[str], n: int) -> tuple[str, int]:
    """Folder of sieves of the queries in the files, of n tokens, for stretches of 0 (documents) to GRAM tokens, a task for each; log2 of their bits."""
    log, most = max(10, math.ceil(math.log2(16 * max(1, n)))), GRAM
    root = scratch_root(spark)
    folder = f"{root if '://' in root else 'file://' + root}/lm-sieves-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level in batch.column(0).to_pylist():
                sieve = Sieve(log, np.zeros(1 << (log - 3), np.uint8))
                for rows, _, sizes, hashes in _blocks(files):
                    if level == 0:
                        sieve.add(_row_grams(rows))
                        continue
                    ends, tokens = np.repeat(np.cumsum(sizes), sizes), hashes.view(np.uint64)
                    h, at = tokens, np.arange(len(tokens))
                    for d in range(1, level):
                        h, at = _longer(h, at, d, tokens, ends)
                    sieve.add(h)
                system, path = pa.fs.FileSystem.from_uri(folder)
                system.create_dir(path)
                with system.open_output_stream(f"{path}/{level}") as file:
                    file.write(sieve.bits)
            yield batch

    spark.range(0, most + 1, 1, most + 1).mapInArrow(run, "id long").collect()
    return folder, log


def _pack(grams: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted hashes and the counts of each, in about 6 bytes: gaps and counts as planes of bytes of equal weight. Those of the gaps
    that are as good as random stay as they are, others are compressed."""
    gaps = np.diff(grams, prepend=np.uint64(0))
    raw = max(0, (int(np.median(gaps)).bit_length() - 1) // 8) if len(gaps) else 0
    planes, counts = (x.astype("<u8").view(np.uint8).reshape(-1, 8).T for x in (gaps, n))
    return np.array([len(gaps), raw], "<i8").tobytes() + planes[:raw].tobytes() + zlib.compress(planes[raw:].tobytes() + counts.tobytes(), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, raw = np.frombuffer(data, "<i8", 2).tolist()
    planes = np.frombuffer(data[16 : 16 + raw * size] + zlib.decompress(data[16 + raw * size :]), np.uint8).reshape(2, 8, size)
    gaps, n = (np.ascontiguousarray(x.T).view("<u8").ravel() for x in planes)
    return np.cumsum(gaps, dtype=np.uint64), n.astype(np.int64)


def _total(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and the sum of the counts of each."""
    if not any(len(g) for g, _ in counts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = np.concatenate([g for g, _ in counts])
    order = np.argsort(grams, kind="stable")  # it merges what is sorted
    grams = grams[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(np.concatenate([n for _, n in counts])[order], first)


def _count(corpus: DataFrame, sieves: tuple[str, int], parts: int) -> DataFrame:
    """(counts, total, vocabulary), a row for each of so many parts of the hashes: packed, how often each stretch that the sieves have (document,
    token or more) occurs in the corpus; of all tokens, those of the sieves or not, how many there are and how many different ones.

    Counts travel packed, sorted and by part: hashes in rows of their own would take twice the bytes."""
    most = GRAM, COUNT_TOKENS, ADDED_GRAMS

    def packs(grams: np.ndarray, n: np.ndarray, token: bool) -> pa.RecordBatch:
        """Of sorted hashes."""
        ends = np.searchsorted((grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(ends))
        data = [_pack(grams[ends[k] : ends[k + 1]], n[ends[k] : ends[k + 1]]) for k in some]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), token)), pa.array(data, pa.binary())], names=["part", "token", "counts"])

    def count(values: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
        h = _row_grams(rows)
        found = [np.unique(h[_open_sieve(sieves[0], 0, sieves[1]).has(h)], return_counts=True)]
        tokens, ends = values.view(np.uint64), np.repeat(np.cumsum(lengths), lengths)
        single = np.unique(tokens, return_counts=True)
        h, at = tokens, np.arange(len(tokens))
        for d in range(1, most[0] + 1):
            here = _open_sieve(sieves[0], d, sieves[1]).has(h)
            h, at = h[here], at[here]
            if d > 1:
                found.append(np.unique(h, return_counts=True))
            h, at = _longer(h, at, d, tokens, ends)
        return found, single

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, most[1]):
            found, single = count(*shard)
            del shard
            yield packs(*single, True)
            yield packs(*_total(found), False)
            del found, single

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one part."""
        held: tuple[list, list] = [], []
        room = most[2]
        for batch in batches:
            for token, data in zip(batch.column("token").to_pylist(), batch.column("counts")):
                held[token].append(_unpack(data.as_buffer().to_pybytes()))
                room -= len(held[token][-1][0])
                if room < 0:
                    for x in held:
                        x[:] = [_total(x)]
                    room = most[2]
        found, single = map(_total, held)
        asked = _open_sieve(sieves[0], 1, sieves[1]).has(single[0])
        data = _pack(*_total([found, (single[0][asked], single[1][asked])]))
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([int(single[1].sum())]), pa.array([len(single[0])])], names=["counts", "total", "vocabulary"])

    counted = corpus.mapInArrow(tidy(run), "part int, token boolean, counts binary")
    return counted.repartitionById(parts, "part").mapInArrow(tidy(add), "counts binary, total long, vocabulary long")


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of numbers one after the other."""
    new = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1])) if len(at) else np.zeros(0, np.int64)
    return at[new], at[np.append(new[1:], len(at)) - 1] if len(at) else at


def _cut(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.ListArray:
    """The stretches of values from begin to end (these not included)."""
    size = end - begin
    offsets = np.concatenate([[0], np.cumsum(size)])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])]))


def _shared(corpus: DataFrame, sieves: tuple[str, int]) -> DataFrame:
    """(row, tokens): the longest stretches of the corpus of which the sieves have each part of GRAM tokens."""
    most = GRAM, COUNT_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, lengths, rows in _shards(batches, most[1]):
            tokens, ends = values.view(np.uint64), np.repeat(np.cumsum(lengths), lengths)
            h, at = tokens, np.arange(len(tokens))
            for d in range(1, most[0] + 1):
                here = _open_sieve(sieves[0], d, sieves[1]).has(h)
                h, at = h[here], at[here]
                if d < most[0]:
                    h, at = _longer(h, at, d, tokens, ends)
            begin, last = _runs(at)
            doc = np.searchsorted(np.cumsum(lengths), begin, "right")
            yield pa.RecordBatch.from_arrays([pa.array(rows[doc]), _cut(values, begin, last + most[0])], names=["row", "tokens"])

    return corpus.mapInArrow(run, "row long, tokens array<long>")


def _short_matches(queries: DataFrame, found: list[str], all_tokens: int) -> DataFrame:
    """For every query with tokens a row of COUNTS, part -1, from the counts in the files `found`; where the longest context has GRAM tokens or more,
    length is GRAM, context and follow are 0 and the counts are left to further rows. Those tokens with what leads up to them are rows of their own:
    part, where they begin, and `tokens`."""
    most = GRAM, FOUND_TOKENS

    def occurrences(grams: np.ndarray) -> np.ndarray:
        """Of sorted stretches, how often each occurs."""
        out = np.zeros(len(grams), np.int64)
        for uri in found:
            system, path = pa.fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as file:
                for batch in pa.parquet.ParquetFile(file).iter_batches(batch_size=1, columns=["counts"]):
                    gram, n = _unpack(batch.column(0)[0].as_buffer().to_pybytes())
                    at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                    same = grams[at] == gram
                    out[at[same]] = n[same]
        return out

    def look_up(values: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, limits = len(values), np.cumsum(sizes)
        tokens, ends, doc = values.view(np.uint64), np.repeat(limits, sizes), np.repeat(np.arange(len(sizes)), sizes)
        firsts = limits - sizes
        h, at = tokens, np.arange(n)
        levels = []
        for d in range(1, most[0] + 1):
            levels.append((h, at))
            h, at = _longer(h, at, d, tokens, ends)
        grams, inverse = np.unique(np.concatenate([_row_grams(rows), *[h for h, _ in levels]]), return_inverse=True)
        count = occurrences(grams)
        times = count[inverse[: len(rows)]]  # how often the document itself is in the corpus
        others, lo = np.zeros((most[0] + 1, n), np.int64), len(rows)
        for d, (_, at) in enumerate(levels, 1):
            mine = inverse[lo : lo + len(at)]
            lo += len(at)
            _, again, own = np.unique(doc[at] * np.int64(len(grams)) + mine, return_inverse=True, return_counts=True)
            others[d, at] = count[mine] - own[again] * times[doc[at]]
        del grams, inverse, count, levels
        place = np.arange(n)
        reach = place + (others[1:] > 0).sum(axis=0)  # what a longer stretch's beginning is occurs with it
        start = np.maximum(np.minimum(np.searchsorted(np.maximum.accumulate(reach), place, "left"), place), firsts[doc])
        length = place - start
        total = all_tokens - times * sizes
        context = np.where(length > 0, others[length, start], total[doc])
        follow = others[np.minimum(length + 1, most[0]), start]
        context[length == most[0]] = follow[length == most[0]] = 0
        offsets = pa.array(np.concatenate([[0], limits]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (length.astype(np.int32), context, follow, others[1])]
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.full(len(rows), -1, np.int32)), pa.array(total), *lists, pa.nulls(len(rows), pa.list_(pa.int64()))], names=names)
        begin, last = _runs(np.flatnonzero(others[most[0]] > 0))
        end = np.minimum(last + most[0] + 1, ends[begin])
        kept = end - begin > most[0]  # a token follows
        begin, end = begin[kept], end[kept]
        absent = [pa.nulls(len(begin), pa.list_(t)) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64())]
        part = (begin - firsts[doc[begin]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(rows[doc[begin]]), pa.array(part), pa.array(total[doc[begin]]), *absent, _cut(values, begin, end)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, sizes, rows in _shards(batches, most[1]):
            some = sizes > 0
            yield from look_up(values, sizes[some], rows[some])

    names = ["row", "part", "total", "length", "context", "follow", "unigram", "tokens"]
    return queries.select("row", "tokens").mapInArrow(run, COUNTS + ", tokens array<long>")


def _blocks(files: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, parts, sizes and token hashes of the queries that have tokens, read from the shared folder PASS_TOKENS at a time."""
    rows, parts, arrays, n = [], [], [], 0

    def block():
        return np.array(rows, np.int64), np.array(parts, np.int32), np.array([len(a) for a in arrays], np.int64), np.concatenate(arrays)

    for uri in files:
        system, path = pa.fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            for batch in pa.parquet.ParquetFile(file).iter_batches(batch_size=256, columns=["row", "part", "tokens"]):
                values, offsets = list_values(batch.column("tokens"))
                for row, part, lo, hi in zip(batch.column("row").to_pylist(), batch.column("part").to_pylist(), offsets, offsets[1:]):
                    if lo == hi:
                        continue
                    rows.append(row)
                    parts.append(part)
                    arrays.append(values[lo:hi])
                    n += int(hi - lo)
                    if n >= PASS_TOKENS:
                        yield block()
                        rows, parts, arrays, n = [], [], [], 0
    if rows:
        yield block()


def count_matches(corpus: DataFrame, files: list[str], depth: int) -> DataFrame:
    """A row of COUNTS, with a value for each token, for every query and shard. corpus: (row, tokens); files have (row, part, tokens) of the
    queries, of depth tokens at most. A query isn't held against corpus rows of its own number."""

    def out(rows: np.ndarray, parts: np.ndarray, sizes: np.ndarray, total: np.ndarray, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64 if k else np.int32))) for k, x in enumerate(found)]
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(parts), pa.array(total), *lists], names=["row", "part", "total", "length", "context", "follow", "unigram"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for values, lengths, numbers in _shards(batches):
            known, number = np.unique(numbers, return_inverse=True)
            shard = Shard(values, lengths, depth, number)
            del values
            room = MERGED_TOKENS
            for k, (rows, parts, sizes, hashes) in enumerate(_blocks(files)):
                at = np.minimum(np.searchsorted(known, rows), len(known) - 1)
                own = np.where(known[at] == rows, at, -1)
                here = bool((own >= 0).any())
                found = shard.look_up(hashes, np.repeat(np.cumsum(sizes), sizes), np.repeat(own, sizes) if here else None)
                total = shard.total - np.where(own >= 0, shard.lengths[own], 0)
                room -= len(hashes)
                if k < len(held):
                    held[k][3:] = held[k][3] + total, _added(held[k][4], found)
                elif room >= 0:
                    held.append([rows, parts, sizes, total, tuple(x.astype(np.int32) for x in found)])
                else:
                    yield out(rows, parts, sizes, total, found)
                del found
            del shard  # before the next one is built
        for part in held:
            yield out(*part)

    return corpus.mapInArrow(run, COUNTS)


def _merge(alpha: float, vocabulary: int):
    """From rows of COUNTS, those of a query one after the other and by part, a row of SUMS for each query."""
    most = GRAM

    def finish(row: int, total: int, length: np.ndarray, context: np.ndarray, follow: np.ndarray, n: np.ndarray) -> tuple:
        u = (n + 1) / (total + vocabulary)
        return row, float(np.log((follow + alpha * u) / (context + alpha)).sum()), float(length.mean()), int(length.max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = long = None

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=["row", "log_prob", "mean_match", "longest_match"])

        for batch in batches:
            done = []
            flat = [list_values(batch.column(c)) for c in ("length", "context", "follow", "unigram")]
            offsets = flat[0][1]
            for row, part, total, lo, hi in zip(batch.column("row").to_pylist(), batch.column("part").to_pylist(), batch.column("total").to_pylist(), offsets, offsets[1:]):
                here = [x[lo:hi].astype(np.int64) for x, _ in flat]
                if part < 0:
                    if held is not None:
                        done.append(finish(*held))
                    held, long = (row, total, *here), here[0] == most
                    continue
                # a part of a query: what it has for contexts of fewer tokens is counted already
                where = part + np.flatnonzero(long[part : part + hi - lo])
                sums = _added(tuple(x[where] for x in held[2:5]) + (0,), tuple(x[where - part] for x in here[:3]) + (0,))
                for x, y in zip(held[2:5], sums):
                    x[where] = y
            if done:
                yield batch_of(done)
        if held is not None:
            yield batch_of([finish(*held)])

    return run


def score(texts: DataFrame, corpus: DataFrame | None, key: str = "item_id", alpha: float = ALPHA, queries: Column | None = None) -> DataFrame:
    """(key, n_tokens, log_prob, perplexity, mean_match, longest_match) for every row of texts (those for which `queries` is true), scored by
    corpus, or with corpus None by all other rows of texts.

    For each token the longest context before it, of any length within its text, that occurs in the
    corpus is found. With the number c of its occurrences and f of those that the token follows,
    p = (f + alpha * u) / (c + alpha), where u = (n + 1) / (N + V + 1) is
    the token's unigram probability, n of the N corpus tokens being the token and V the different tokens of the whole corpus (one more stands for all others).

    Stretches of up to GRAM tokens are counted by 64-bit hashes in one pass over the corpus, which passes on those that a sieve of the
    queries' stretches has. Tokens whose context is as long as that or longer are looked up in suffix arrays, in shards, over what the corpus shares with
    the queries: the runs of stretches of GRAM tokens that occur in both. That alone grows with the product of both tables, less what they don't share.
    Logarithms are natural; perplexity is exp(-log_prob / n_tokens).

    Null and empty texts have 0 tokens, log_prob 0 and null perplexity and matches. Rows with null or repeated keys are
    scored each. Rows with the same text and different keys are scored by each other; those with the same key as well (null among them) are one document, which isn't held against itself.
    Without a corpus u alone is left. Without texts the result is empty. Corpus rows with null or empty text add nothing; repeated rows count each time.
    """
    # a row is known by its key and text, in the corpus as among the queries
    same = F.xxhash64(F.col(key).cast("string"), "text")
    asked = texts if queries is None else texts.filter(queries)
    rows = materialize(asked.select(same.alias("row"), F.col(key).alias("key"), F.col("text")).withColumns({"tokens": token_hashes("text")}).drop("text").withColumn("n_tokens", F.size("tokens").cast("long")), "lm-queries")
    once = materialize(rows.select("row", F.lit(-1).alias("part"), "tokens", "n_tokens").dropDuplicates(["row"]), "lm-lookups")
    asked_tokens = once.agg(F.sum("n_tokens")).first()[0] or 0
    index = (texts if corpus is None else corpus).select((same if corpus is None else F.lit(None).cast("long")).alias("row"), token_hashes("text").alias("tokens"))
    # queries have hashes for numbers; the corpus of others has none of them
    index = index.withColumn("row", F.coalesce("row", F.lit(-1).cast("long")))
    spark = texts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(asked_tokens * GRAM / PART_GRAMS))
    found = materialize(_count(index, _sieves(spark, once.inputFiles(), asked_tokens), parts), "lm-found")
    total, vocabulary = found.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("vocabulary"), F.lit(0))).first()
    base = materialize(_short_matches(once, found.inputFiles(), total), "lm-short")
    discard(found)
    discard(once)
    long = materialize(base.filter("part >= 0").select("row", "part", "tokens"), "lm-long")
    counts = base.filter("part < 0").drop("tokens")
    long_tokens, depth = long.agg(F.sum(F.size("tokens")), F.max(F.size("tokens"))).first()
    if long_tokens:
        shared = materialize(_shared(index, _sieves(spark, long.inputFiles(), long_tokens)), "lm-shared")
        n = shared.agg(F.sum(F.size("tokens"))).first()[0] or 0
        tasks = max(1, math.ceil(n / (SHARD_TOKENS * SHARDS_A_TASK)), min(2 * spark.sparkContext.defaultParallelism, math.ceil(n / SHARD_TOKENS)))
        counts = counts.unionByName(count_matches(shared.coalesce(tasks), long.inputFiles(), depth))
    sums = counts.repartition("row").sortWithinPartitions("row", "part").mapInArrow(_merge(alpha, vocabulary + 1), SUMS)
    # without any corpus token the shards say nothing
    log_prob = F.coalesce("log_prob", F.col("n_tokens") * F.lit(math.log(1 / (vocabulary + 1))))
    return rows.drop("tokens").join(sums, "row", "left").select(
        F.col("key").alias(key), "n_tokens", F.round(log_prob, 6).alias("log_prob"),
        F.when(F.col("n_tokens") > 0, F.round(F.exp(-log_prob / F.col("n_tokens")), 4)).alias("perplexity"),
        F.when(F.col("n_tokens") > 0, F.round(F.coalesce("mean_match", F.lit(0.0)), 6)).alias("mean_match"),
        F.when(F.col("n_tokens") > 0, F.coalesce("longest_match", F.lit(0))).alias("longest_match"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose doc_id is divisible by 50, each scored by all other documents."""
    return score(table(spark, sf_dir, "documents"), None, key="doc_id", queries=F.col("doc_id") % 50 == 0)


def benchmark_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item, scored by all documents."""
    return score(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
