"""N-gram Jaccard join: a grouped prefix join over the sets of word n-grams of all documents."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import discard, materialize, small, table, tidy, word_hashes, words_of

#: Words in an n-gram, and the least Jaccard similarity of a pair.
N = 3
THRESHOLD = 0.55
#: log2 of the counters that order n-grams by how common they are: of fixed size, shared by n-grams of equal
#: hash bits. Any order is right; a good one keeps n-grams that many documents share out of the prefixes.
SKETCH_BITS = 22
#: Counters that travel together.
SKETCH_CHUNK = 1 << 16
#: Documents and words that are worked on at once in a task.
CHUNK_DOCS, CHUNK_WORDS = 512, 150_000
#: Prefix n-grams of one bucket, which one task joins at once.
BUCKET = 600_000
#: Pairs that a task adds up before it passes them on.
HELD = 2_000_000
#: Documents that share an n-gram and are compared at once; more of them are cut into blocks, and blocks into pairs of blocks.
RUN = 4096
#: Documents of one pack of postings, and n-grams. A pack has a row for each bucket: small ones would be mostly overhead where buckets are many.
PACK_DOCS, PACK_GRAMS = 60_000, 1_200_000
#: Bits of an n-gram that travel with its bucket.
GRAM_BITS = 24
#: Side of the square of pairs, and n-grams of the sets, of one tile that is verified at once.
TILE, TILE_GRAMS = 700, 2_000_000
#: n-grams whose bits are compared at once, and words of bits.
SLAB, GULP = 1 << 14, 1 << 19
EPS = 1e-9

_DOCS = "doc_id long, size int, gsig long, fsig long, prefix binary, parity binary"
#: Positions are kept up to this one, which makes the position filter no stricter; two bits above it say on which side of a pair of blocks a document is.
_FAR, _SIDE, _CROSS = (1 << 14) - 1, 1 << 14, 1 << 15


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def grams(values: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of each document, with repeats, and the document of each. Of fewer than n words all make one n-gram."""
    lengths = np.diff(offsets)
    counts = np.where(lengths > 0, np.maximum(lengths - n + 1, 1), 0)
    doc = np.repeat(np.arange(len(lengths)), counts)
    at = np.arange(len(doc)) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    words = values.view(np.uint64)
    h = np.zeros(len(doc), np.uint64)
    ends = offsets[1:][doc]
    for k in range(n):
        there = at + k < ends
        w = words[np.minimum(at + k, max(0, len(words) - 1))] if len(words) else h
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(there, w | np.uint64(1), np.uint64(0))
    return _mix(h), doc


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, words, offsets) of parts of a batch that has a column `words`."""
    for first in range(0, batch.num_rows, CHUNK_DOCS):
        values, offsets = words_of(batch.slice(first, CHUNK_DOCS), "words")
        lo, n = 0, len(offsets) - 1
        while lo < n:
            hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK_WORDS, "right")) - 1
            hi = min(max(hi, lo + 1), n)
            yield first + lo, first + hi, values[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def _worded(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text")).alias("words"))


def commonness(docs: DataFrame, n: int = N, bits: int = SKETCH_BITS) -> np.ndarray:
    """For each value of the first `bits` hash bits its rank by the number of n-grams in all documents, in 20 bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, _, values, offsets in _chunks(batch):
                h, _ = grams(values, offsets, n)
                at, times = np.unique(h >> np.uint64(64 - bits), return_counts=True)
                total[at.astype(np.int64)] += times.astype(np.uint32)
        size = min(SKETCH_CHUNK, 1 << bits)
        parts = [total[lo : lo + size] for lo in range(0, 1 << bits, size)]
        # counts are small: bytes of equal weight next to each other compress well
        blobs = [zlib.compress(p.view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(blobs, pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.uint64)
                sums[chunk] = sums[chunk] + c if chunk in sums else c
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], names=["chunk", "counts"])

    rows = _worded(docs).select("words").mapInArrow(tidy(count), "chunk int, counts binary").repartition("chunk").mapInArrow(tidy(add), "chunk int, counts binary").collect()
    total = np.zeros(1 << bits, np.uint64)
    for r in rows:
        c = np.frombuffer(r.counts, np.uint64)
        total[r.chunk * len(c) : (r.chunk + 1) * len(c)] = c
    rank = np.empty(1 << bits, np.uint32)
    rank[np.argsort(total, kind="stable")] = np.arange(1 << bits, dtype=np.uint32) >> np.uint32(max(0, bits - 20))
    return rank


def _ordered(values: np.ndarray, offsets: np.ndarray, n: int, rank: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each document and the document of each: rare ones first with a rank, by hash without."""
    h, doc = grams(values, offsets, n)
    if rank is None:
        order = np.lexsort((h, doc))
    else:
        common = rank[(h >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
        # CHUNK_DOCS fits 13 bits, a rank 20; the rest is hash
        order = np.argsort((doc.astype(np.uint64) << np.uint64(51)) | (common << np.uint64(31)) | (h & np.uint64((1 << 31) - 1)))
    h, doc = h[order], doc[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    return h[first], doc[first]


def _parities(h: np.ndarray, doc: np.ndarray, size: np.ndarray) -> list[bytes]:
    """For each document with n-grams a bit per hash value, how often it occurs being odd or even; 2 to 4 bits an n-gram, a power of two.

    Two of them differ in no more bits than the sets do in members; one of twice the length is folded by XOR of its halves.
    """
    some = size[size > 0]
    bits = np.maximum(64, 1 << np.ceil(np.log2(2 * some)).astype(np.int64)) if len(some) else some
    ends = np.cumsum(bits)
    of = (np.cumsum(size > 0) - 1)[doc]
    at = (ends - bits)[of] + (_mix(h ^ np.uint64(0x2545F4914F6CDD1D)).view(np.int64) & (bits[of] - 1))
    odd = np.packbits((np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8))
    return [odd[(e - b) // 8 : e // 8].tobytes() for b, e in zip(bits, ends)]


def signatures(docs: DataFrame, rank: np.ndarray, n: int = N, threshold: float = THRESHOLD, bits: int = SKETCH_BITS) -> DataFrame:
    """_DOCS: size of the set, gsig (a hash of prefix and size), fsig (of the whole set) the prefix and the parity bits, for each row with words."""
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, values, offsets in _chunks(batch):
                h, doc = _ordered(values, offsets, n, shared.value, bits)
                size = np.bincount(doc, minlength=hi - lo)
                start = np.cumsum(size) - size
                length = size - np.ceil(threshold * size - EPS).astype(np.int64) + 1
                pos = np.arange(len(h)) - start[doc]
                head = pos < length[doc]
                some = np.flatnonzero(size)
                # order of the prefix is the same for equal sets: sums are signature enough
                sums = np.add.reduceat(_mix(h ^ np.uint64(0x5851F42D4C957F2D)), start[some]) if len(some) else h
                heads = np.add.reduceat(np.where(head, _mix(h ^ np.uint64(0x14057B7EF767814F)), np.uint64(0)), start[some]) if len(some) else h
                sizes = size[some].astype(np.uint64)
                gsig, fsig = _mix(heads + sizes * np.uint64(0x9E3779B97F4A7C15)), _mix(sums + sizes)
                blobs = [h[a : a + k].tobytes() for a, k in zip(start[some], length[some])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(some)), pa.array(size[some].astype(np.int32)), pa.array(gsig.view(np.int64)), pa.array(fsig.view(np.int64)), pa.array(blobs, pa.binary()), pa.array(_parities(h, doc, size), pa.binary())],
                    names=["doc_id", "size", "gsig", "fsig", "prefix", "parity"],
                )

    return _worded(docs).mapInArrow(tidy(run), _DOCS)


_PACKED = "bucket long, h binary, times binary, pos binary, id binary, size binary"


def _planes(x: np.ndarray) -> bytes:
    """First all lowest bytes, then all next ones: high bytes are mostly zeros, which compression takes out."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack(bucket: np.ndarray, h: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """A row of _PACKED for each bucket, postings by document; doc: places in ids and size; times: each document's postings.

    Only equality within a bucket counts: GRAM_BITS of h do for its BUCKET n-grams, as two that look alike only add pairs that are compared in vain.
    """
    order = np.lexsort((doc, bucket))
    bucket, h, doc, pos = bucket[order], h[order].astype(np.uint32), doc[order], pos[order].astype(np.uint16)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rows: list[list] = [[] for _ in range(6)]
    for a, b in zip(starts, [*starts[1:], len(bucket)]):
        mine, times = np.unique(doc[a:b], return_counts=True)
        for row, x in zip(rows, (bucket[a], _planes(h[a:b]), _planes(times.astype(np.uint32)), _planes(pos[a:b]), _thin(ids[mine].view(np.uint64)), _planes(size[mine].astype(np.uint32)))):
            row.append(x)
    return pa.RecordBatch.from_arrays([pa.array(r, pa.binary() if k else pa.int64()) for k, r in enumerate(rows)], names=[c.split()[0] for c in _PACKED.split(", ")])


def _unpack(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """h, doc, pos, ids and sizes of the postings in rows of _PACKED."""
    h = np.concatenate([_from_planes(r[1], np.uint32) for r in rows])
    times = np.concatenate([_from_planes(r[2], np.uint32) for r in rows])
    pos = np.concatenate([_from_planes(r[3], np.uint16) for r in rows]).astype(np.int64)
    ids = np.concatenate([_thick(r[4]) for r in rows]).view(np.int64)
    size = np.concatenate([_from_planes(r[5], np.uint32) for r in rows]).astype(np.int64)
    return h, np.repeat(np.arange(len(ids)), times), pos, ids, size


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    now, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[0] != now and rows:
                yield rows
                rows = []
            now = row[0]
            rows.append(row)
    if rows:
        yield rows


def _postings(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Prefixes of groups (id, size, prefix) as rows of _PACKED, by buckets of n-grams."""

    def pack(ids: list, size: list, prefix: list) -> pa.RecordBatch:
        lengths = np.array([len(p) // 8 for p in prefix])
        h = np.frombuffer(b"".join(prefix), np.uint64)
        doc = np.repeat(np.arange(len(ids)), lengths)
        pos = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        # of the bits that are not the bucket's
        return _pack(bucket, _mix(h) & np.uint64((1 << GRAM_BITS) - 1), doc, np.minimum(pos, _FAR), np.array(ids, np.int64), np.array(size, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, size, prefix, held = [], [], [], 0
        for batch in batches:
            for i, z, p in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                ids.append(i)
                size.append(z)
                prefix.append(p)
                held += len(p) // 8
                if held >= PACK_GRAMS or len(ids) >= PACK_DOCS:
                    yield pack(ids, size, prefix)
                    ids, size, prefix, held = [], [], [], 0
        if held:
            yield pack(ids, size, prefix)

    return run


def _regroup(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings of the n-grams that several groups have, by the least group of each n-gram.

    Near copies have most of their n-grams from one least group: nearly all that two of them share then meets in one
    bucket, and the pair leaves it once. An n-gram of very many groups goes out by pairs of blocks of them.
    """

    def regroup(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, doc, pos, ids, size = _unpack(rows)
        order = np.argsort(h, kind="stable")
        h = h[order]
        same = h[1:] == h[:-1]
        if not same.any():
            return
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        h, at = h[shared], order[shared]
        doc, pos = doc[at], pos[at]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        lengths = np.diff(np.append(starts, len(h)))
        # n-grams of other buckets will be beside them
        h = (_mix(h.astype(np.uint64) | np.uint64(rows[0][0] << 32)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        hub = np.repeat(np.minimum.reduceat(ids[doc], starts), lengths).view(np.uint64)
        to = _mix(hub)
        long = np.repeat(lengths > RUN, lengths)
        parts = [(to[~long], h[~long], doc[~long], pos[~long])]
        for a, n in zip(starts[lengths > RUN], lengths[lengths > RUN]):
            cuts = 1 << int(math.ceil(math.log2(n / RUN)))
            mine, where = doc[a : a + n], pos[a : a + n]
            block = (_mix(ids[mine].view(np.uint64) ^ np.uint64(0x632BE59BD9B4E019)) & np.uint64(cuts - 1)).astype(np.int64)
            for i in range(cuts):
                for j in range(i, cuts):
                    here = np.flatnonzero((block == i) | (block == j))
                    tile = np.full(len(here), (cuts << 40) | (i << 20) | j, np.uint64)
                    flags = 0 if i == j else _CROSS | np.where(block[here] == j, _SIDE, 0)
                    parts.append((_mix(to[a] ^ _mix(tile)), (_mix(tile + h[a]) & np.uint64(0xFFFFFFFF)).astype(np.uint32), mine[here], where[here] | flags))
        to, h, doc, pos = (np.concatenate(x) for x in zip(*parts))
        # packs of few enough documents
        for lo in range(0, len(ids), PACK_DOCS):
            mine = (doc >= lo) & (doc < lo + PACK_DOCS)
            if mine.any():
                yield _pack((to[mine] % np.uint64(buckets)).astype(np.int64), h[mine], doc[mine], pos[mine], ids, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            yield from regroup(rows)

    return run


_PAIRS = "ga long, gb long, n int, least int, big int"


def _candidates(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """_PAIRS: pairs of groups that share n n-grams of their prefixes in a bucket and pass the length and position filters; big: the larger size.

    Similar sets pass these filters at each n-gram they share, and share `least` within their prefixes: what they
    share beyond lies after the end of the prefix that ends first, where that set has fewer than threshold * size.
    Buckets come one after the other.
    """

    def pairs(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, doc, pos, ids, size = _unpack(rows)
        # one number for each group, whichever packs it came in
        ids, first, own = np.unique(ids, return_index=True, return_inverse=True)
        size, doc = size[first], own[doc]
        order = np.lexsort((size[doc], h))
        h, doc, pos = h[order], doc[order], pos[order]
        side, cross, pos = pos & _SIDE, (pos & _CROSS) > 0, pos & _FAR
        s = size[doc]
        ends = np.searchsorted(h, h, "right")
        live = np.arange(len(h))
        found, times, held, step = [], [], 0, 1

        def add_up() -> None:
            key, at = np.unique(np.concatenate(found), return_inverse=True)
            found[:], times[:] = [key], [np.bincount(at, weights=np.concatenate(times)).astype(np.int32)]

        while True:
            live = live[live + step < ends[live]]
            # sizes rise within a run: once the partner is too large, later ones are as well
            live = live[s[live] >= threshold * s[live + step] - EPS]
            if not len(live):
                break
            a, b = live, live + step
            need = np.ceil(threshold / (1 + threshold) * (s[a] + s[b]) - EPS)
            most = 1 + np.minimum(pos[a], pos[b]) + np.minimum(s[a] - pos[a], s[b] - pos[b]) - 1
            ok = (most >= need) & (doc[a] != doc[b]) & ~(cross[a] & (side[a] == side[b]))
            x, y = doc[a[ok]], doc[b[ok]]
            found.append((np.minimum(x, y) << 32) | np.maximum(x, y))
            times.append(np.ones(len(x), np.int32))
            held += len(x)
            if held > HELD:
                add_up()
                held = len(found[0])
                if held > HELD // 2:
                    yield out(found[0], times[0], ids, size)
                    found.clear()
                    times.clear()
                    held = 0
            step += 1
        if found:
            add_up()
            yield out(found[0], times[0], ids, size)

    def out(key: np.ndarray, n: np.ndarray, ids: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        i, j = key >> 32, key & 0xFFFFFFFF
        larger = np.maximum(size[i], size[j])
        need = np.ceil(threshold / (1 + threshold) * (size[i] + size[j]) - EPS)
        least = np.maximum(1, need - np.ceil(threshold * larger - EPS) + 1)
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(n), pa.array(least.astype(np.int32)), pa.array(larger.astype(np.int32))], names=["ga", "gb", "n", "least", "big"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            yield from pairs(rows)

    return run


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(fsig, grams): the whole set of each row, its n-grams in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, values, offsets in _chunks(batch):
                h, doc = _ordered(values, offsets, n, None, 0)
                size = np.bincount(doc, minlength=hi - lo)
                start = np.cumsum(size) - size
                some = np.flatnonzero(size)
                sums = np.add.reduceat(_mix(h ^ np.uint64(0x5851F42D4C957F2D)), start[some]) if len(some) else h
                fsig = _mix(sums + size[some].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(fsig.view(np.int64)), pa.array([_thin(h[a : a + k]) for a, k in zip(start[some], size[some])], pa.binary())], names=["fsig", "grams"])

    return _worded(docs).mapInArrow(tidy(run), "fsig long, grams binary")


def _thin(h: np.ndarray) -> bytes:
    """Ascending hashes as their differences."""
    return _planes(np.diff(h, prepend=np.uint64(0)))


def _thick(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, np.uint64), dtype=np.uint64)


class _Tile:
    """Sets (node, weight, data) and then pairs (a, b) of one tile."""

    def __init__(self, key: int = 0):
        self.key = key
        self.nodes, self.weights, self.data, self.a, self.b, self.known = [], [], [], [], [], set()

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs as places of their nodes."""
        nodes = np.array(self.nodes, np.int64)
        order = np.argsort(nodes)
        i, j = (order[np.searchsorted(nodes, np.array(x, np.int64), sorter=order)] for x in (self.a, self.b))
        return i, j

    def common(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair the places, how many n-grams both have, and how many either has: rows of bits, a slab of n-grams at a time."""
        i, j = self.pairs()
        grams = [_thick(d) for d in self.data]
        size = np.array([len(g) for g in grams])
        value, of = np.unique(np.concatenate(grams), return_inverse=True)
        owner = np.repeat(np.arange(len(grams)), size)
        # an n-gram of a single set is in no intersection
        several = np.bincount(of, minlength=len(value)) > 1
        kept = several[of]
        of, owner = (np.cumsum(several) - 1)[of[kept]], owner[kept]
        order = np.argsort(of, kind="stable")
        of, owner = of[order], owner[order]
        both = np.zeros(len(i), np.int64)
        width = max(64, min(SLAB, (1 << 28) // max(1, len(grams)) // 64 * 64))
        for lo in range(0, int(several.sum()), width):
            a, b = np.searchsorted(of, [lo, lo + width])
            bits = np.zeros((len(grams), width // 8), np.uint8)
            np.bitwise_or.at(bits, (owner[a:b], (of[a:b] - lo) >> 3), (1 << ((of[a:b] - lo) & 7)).astype(np.uint8))
            words = bits.view(np.uint64)
            step = max(1, GULP // words.shape[1])
            for k in range(0, len(i), step):
                both[k : k + step] += np.bitwise_count(words[i[k : k + step]] & words[j[k : k + step]]).sum(axis=1, dtype=np.int64)
        return i, j, both, size[i] + size[j] - both


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[_Tile]:
    """From rows (tile, kind, a, b, weight, data) in the order of tile and kind, sets before pairs."""
    now, tile = None, _Tile()
    for batch in batches:
        for key, kind, a, b, weight, data in zip(*[c.to_pylist() for c in batch.columns]):
            if key != now:
                if tile.a:
                    yield tile
                now, tile = key, _Tile(key)
            if kind:
                tile.a.append(a)
                tile.b.append(b)
            elif a not in tile.known:  # rows with the same text bring the same set
                tile.known.add(a)
                tile.nodes.append(a)
                tile.weights.append(weight)
                tile.data.append(data)
    if tile.a:
        yield tile


def _verify(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b, jaccard): the pairs of each tile that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            _, _, both, union = tile.common()
            ok = both >= threshold * union - EPS
            yield pa.RecordBatch.from_arrays([pa.array(np.array(tile.a, np.int64)[ok]), pa.array(np.array(tile.b, np.int64)[ok]), pa.array(both[ok] / union[ok])], names=["a", "b", "jaccard"])

    return run


def _link(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, links, root) for each node of a tile with a pair that reaches the threshold: the weights of its partners, and the least node it is linked to over pairs of the tile.

    A row a node, not a pair: what leaves a tile of many near copies grows with them, not with their square.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            i, j, both, union = tile.common()
            ok = both >= threshold * union - EPS
            i, j = i[ok], j[ok]
            nodes, weight = np.array(tile.nodes, np.int64), np.array(tile.weights, np.int64)
            links = np.bincount(i, weights=weight[j], minlength=len(nodes)) + np.bincount(j, weights=weight[i], minlength=len(nodes))
            root = nodes.copy()
            while True:
                least = root.copy()
                np.minimum.at(least, i, root[j])
                np.minimum.at(least, j, root[i])
                if (least == root).all():
                    break
                root = least
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["node", "links", "root"])

    return run


def _rule_out(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(tile, a, b) of tiles with parity bits for data and sizes for weights: leaves out pairs whose bits differ more than similar sets can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            i, j = tile.pairs()
            size, lengths = np.array(tile.weights, np.int64), np.array([len(d) for d in tile.data])
            ok = np.zeros(len(i), bool)
            least = np.minimum(lengths[i], lengths[j])
            for length in np.unique(least):  # the longer of two is folded to the length of the shorter
                mine = np.flatnonzero(least == length)
                used, at = np.unique(np.concatenate([i[mine], j[mine]]), return_inverse=True)
                bits = np.empty((len(used), length // 8), np.uint64)
                for row, k in enumerate(used):
                    bits[row] = np.bitwise_xor.reduce(np.frombuffer(tile.data[k], np.uint64).reshape(-1, length // 8), axis=0)
                x, y = at[: len(mine)], at[len(mine) :]
                step = max(1, GULP // (length // 8))
                for k in range(0, len(mine), step):
                    m = mine[k : k + step]
                    differ = np.bitwise_count(bits[x[k : k + step]] ^ bits[y[k : k + step]]).sum(axis=1, dtype=np.int64)
                    ok[m] = differ <= (1 - threshold) / (1 + threshold) * (size[i[m]] + size[j[m]]) + EPS
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(ok.sum()), tile.key)), pa.array(np.array(tile.a, np.int64)[ok]), pa.array(np.array(tile.b, np.int64)[ok])], names=["tile", "a", "b"])

    return run


def _numbered(docs: DataFrame, n: int, threshold: float, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """signed: signatures with a number `row`; names: (row, doc_id, fsig) of it; nodes (node, gid, size, fsig, n_nodes, weight): the different
    sets, each as the least row that has it, with their group, as its least node, the group's nodes, and the doc_ids of the set."""
    signed = signatures(docs, commonness(docs, n, bits), n, threshold, bits)
    signed = materialize(signed.withColumn("row", F.monotonically_increasing_id()), "join-signatures")
    nodes = signed.groupBy("gsig", "fsig").agg(F.min("row").alias("node"), F.count_distinct("doc_id").alias("weight"), F.first("size").alias("size"))
    groups = Window.partitionBy("gsig")
    nodes = nodes.select(F.min("node").over(groups).alias("gid"), F.count("*").over(groups).alias("n_nodes"), "node", "size", "fsig", "weight")
    return signed, materialize(signed.select("row", "doc_id", "fsig"), "join-names"), materialize(nodes, "join-nodes")


def _candidate_pairs(signed: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, big): pairs of nodes that the grouped prefix join can't rule out; big: the larger size."""
    # groups: one row of each stands for all with that prefix and size
    groups = signed.select("row", "size", "prefix").join(small(nodes.filter("node = gid").select(F.col("node").alias("row"))), "row", "left_semi")
    total = signed.agg(F.sum(F.length("prefix") / 8)).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET))
    by_gram = groups.mapInArrow(tidy(_postings(buckets)), _PACKED).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    by_hub = by_gram.mapInArrow(tidy(_regroup(buckets)), _PACKED).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    # by one side only: the pairs of a group stay next to each other and compress well
    found = by_hub.mapInArrow(tidy(_candidates(threshold)), _PAIRS).repartition("ga").groupBy("ga", "gb").agg(F.sum("n").alias("n"), F.max("least").alias("least"), F.max("big").alias("big"))
    found = materialize(found.filter("n >= least").select("ga", "gb", "big"), "join-groups")
    # members of groups: the different sets that share a prefix, and all across a pair of groups; most groups are one set
    several = materialize(nodes.filter("n_nodes > 1").select("gid", "node", "size"), "join-several")
    if several.isEmpty():
        return found.select(F.col("ga").alias("a"), F.col("gb").alias("b"), "big")
    few = small(several)
    of = lambda side: few.select(F.col("gid").alias(f"g{side}"), F.col("node").alias(side))
    across = found.join(of("a"), "ga", "left").join(of("b"), "gb", "left").select(F.coalesce("a", "ga").alias("a"), F.coalesce("b", "gb").alias("b"), "big")
    within = several.select(F.col("gid").alias("ga"), F.col("node").alias("a"), F.col("size").alias("big")).join(of("b"), F.col("ga") == F.col("gb")).filter("a < b")
    # a set has one prefix and size: no pair comes twice
    return materialize(across.unionByName(within.select("a", "b", "big")), "join-candidates")


def _compared(docs: DataFrame, signed: DataFrame, names: DataFrame, nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """Rows of tiles (tile, kind, a, b, weight, data), in order, with whole sets for data, of the pairs that may be similar."""
    pairs = _candidate_pairs(signed, nodes, threshold)
    # parity bits are a fraction of the sets' size and leave few pairs, and few sets, to compare in full
    tiled, places = _tiled(pairs)
    bits_of = signed.select(F.col("row").alias("node"), F.col("size").cast("long").alias("weight"), F.col("parity").alias("data"))
    tiled = materialize(_by_tile(bits_of, tiled, places).mapInArrow(tidy(_rule_out(threshold)), "tile long, a long, b long"), "join-likely")
    places = _places(tiled)
    discard(signed)
    leads = nodes.select("node", "fsig", "weight").join(small(places.select("node")), "node", "left_semi")
    leads = materialize(leads.join(names.select(F.col("row").alias("node"), "doc_id"), "node"), "join-leads")
    some = docs.join(small(leads.select(F.col("doc_id").alias("__nj_id")).distinct()), F.col("doc_id").cast("long") == F.col("__nj_id"), "left_semi")
    sets = _sets(some.select("doc_id", "text"), n).join(small(leads), "fsig")
    return _by_tile(sets.select("node", "weight", F.col("grams").alias("data")), tiled, places)


def _tiled(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tile, a, b) and (node, tiles) of pairs (a, b, big). Sets are sent once to each tile: the pairs whose two sides have the same labels.

    A node's label is the least node within two steps, for a cluster of copies mostly the same for all.
    """
    least = lambda p: small(materialize(p.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "join-labels"))
    first = least(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    joined = lambda labels: pairs.join(labels.select("a", F.col("label").alias("la")), "a").join(labels.select(F.col("a").alias("b"), F.col("label").alias("lb")), "b")
    seen = joined(first).withColumn("m", F.least("la", "lb"))
    labels = least(seen.select("a", F.col("m").alias("b")).unionByName(seen.select(F.col("b").alias("a"), F.col("m").alias("b"))))
    tiled = joined(labels).withColumn("tile", F.xxhash64(F.least("la", "lb"), F.greatest("la", "lb"))).select("a", "b", "big", "tile")
    # a tile of many pairs, or of much text, is cut into squares
    sides = (F.approx_count_distinct("a", 0.1) + F.approx_count_distinct("b", 0.1)) * F.avg("big")
    cuts = tiled.groupBy("tile").agg(F.ceil(F.greatest(F.sqrt(F.count("*")) / TILE, sides / TILE_GRAMS)).cast("long").alias("cuts")).filter("cuts > 1")
    cuts = small(materialize(cuts, "join-cuts"))
    tiled = tiled.join(cuts, "tile", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("cuts"))
    tiled = tiled.withColumn("tile", F.when(F.col("cuts") == 1, F.col("tile")).otherwise(F.xxhash64("tile", F.least(part("a"), part("b")), F.greatest(part("a"), part("b")))))
    tiled = materialize(tiled.select("tile", "a", "b"), "join-tiles")
    return tiled, _places(tiled)


def _places(tiled: DataFrame) -> DataFrame:
    """(node, tiles) of pairs (tile, a, b)."""
    places = tiled.select("tile", F.col("a").alias("node")).unionByName(tiled.select("tile", F.col("b").alias("node"))).groupBy("node").agg(F.collect_set("tile").alias("tiles"))
    return materialize(places, "join-places")


def _by_tile(sets: DataFrame, tiled: DataFrame, places: DataFrame) -> DataFrame:
    """Sets (node, weight, data) at all their tiles and the tiles' pairs, in order."""
    sent = sets.join(small(places), "node").select(F.explode("tiles").alias("tile"), F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "weight", "data")
    rows = sent.unionByName(tiled.select("tile", F.lit(1).alias("kind"), "a", "b", F.lit(0).cast("long").alias("weight"), F.lit(None).cast("binary").alias("data")))
    return rows.repartition("tile").sortWithinPartitions("tile", "kind")


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_a, doc_b, jaccard): the pairs of different sets with at least that Jaccard similarity, each set by the least doc_id that has it; doc_a < doc_b.

    Rows as in join(). A pair of sets of one doc_id isn't listed.
    """
    signed, names, nodes = _numbered(docs, n, threshold, bits)
    pairs = _compared(docs, signed, names, nodes, n, threshold).mapInArrow(tidy(_verify(threshold)), "a long, b long, jaccard double")
    leads = names.groupBy("fsig").agg(F.min("doc_id").alias("lead")).join(nodes, "fsig").select("node", "lead")
    leads = small(materialize(leads, "join-leads"))
    named = pairs.join(leads.select(F.col("node").alias("a"), F.col("lead").alias("x")), "a").join(leads.select(F.col("node").alias("b"), F.col("lead").alias("y")), "b")
    return named.filter("x <> y").groupBy(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).agg(F.round(F.max("jaccard"), 6).alias("jaccard"))


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, class_id, links) for each doc_id: the least doc_id of its class, and the number of texts of at least that Jaccard similarity.

    A class holds the documents that are linked directly or over others. n-grams are of lower-cased runs of letters and
    digits; a text of fewer than n words is one n-gram. The join is exact (up to 64-bit hashes) whatever the order of
    n-grams: every pair of different sets that may be similar is compared, copies of a set are counted and not listed. Texts
    without a word (null, empty, marks only) have no links; rows without doc_id are left out. Rows of one doc_id with the
    same n-grams are one text; its different texts are in one class, their links are summed, links among them included. Texts are read whole. An empty
    table gives no rows.
    """
    signed, names, nodes = _numbered(docs, n, threshold, bits)
    linked = materialize(_compared(docs, signed, names, nodes, n, threshold).mapInArrow(tidy(_link(threshold)), "node long, links long, root long"), "join-linked")
    members = materialize(names.select("doc_id", "fsig").distinct().join(small(nodes.select("fsig", "node", "weight")), "fsig").select("doc_id", "node", "weight"), "join-members")
    edges = linked.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    several = materialize(members.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).filter("b < most").select("doc_id", "b"), "join-several")
    if not several.isEmpty():
        edges = edges.unionByName(members.join(small(several), "doc_id").filter("node > b").select(F.col("node").alias("a"), "b"))
    roots = small(materialize(components(edges), "join-roots"))
    links = small(materialize(linked.groupBy("node").agg(F.sum("links").alias("links")), "join-links"))
    placed = members.join(roots, "node", "left").join(links, "node", "left")
    placed = placed.select("doc_id", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    placed = materialize(placed.groupBy("doc_id").agg(F.min("root").alias("root"), F.sum("links").alias("links")), "join-placed")
    # classes of one document are not aggregated
    shared = placed.filter("links > 0")
    least = small(materialize(shared.groupBy("root").agg(F.min("doc_id").alias("class_id")), "join-classes"))
    out = placed.filter("links = 0").select("doc_id", F.col("doc_id").alias("class_id"), "links").unionByName(shared.join(least, "root").select("doc_id", "class_id", "links"))
    ids = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.join(out, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


#: Edges up to which components are found in one go on the driver (16 bytes each); beyond it in rounds in the cluster.
MAX_DRIVER_EDGES = 500_000


def _united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of the component of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def components(edges: DataFrame, on_driver: int = MAX_DRIVER_EDGES) -> DataFrame:
    """(node, root): each node of edges (a, b) with the least node of its connected component, by alternating large and small stars."""
    edges = materialize(edges.select("a", "b").distinct(), "edges")
    if edges.count() <= on_driver:
        got = edges.toArrow()
        nodes, root = _united(*(got.column(c).to_numpy().astype(np.int64) for c in ("a", "b")))
        return edges.sparkSession.createDataFrame(pa.table({"node": nodes, "root": root}), "node long, root long")
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    while True:
        near = both(edges)
        least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: larger neighbours are tied to the least node around
        large = near.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "stars")
        # small star: smaller neighbours and the node itself are tied to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        star = materialize(star, "stars")
        n, same = star.count(), star.join(edges, ["a", "b"], "left_semi").count()
        if n == same == edges.count():
            roots = star.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        edges = star


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bits: int = SKETCH_BITS) -> DataFrame:
    """The rows of docs without near copies: of each class of join() the least doc_id stays.

    Rows of the same doc_id stay or go together. Rows without doc_id and texts without a word stay.
    """
    gone = join(docs, n, threshold, bits).filter("doc_id <> class_id").select(F.col("doc_id").alias("__nj_id"))
    return docs.join(small(materialize(gone, "join-gone")), docs["doc_id"].cast("long") == F.col("__nj_id"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def pairs_sql(docs: str, n: int = N, threshold: float = THRESHOLD) -> str:
    parts = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {docs} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
grams AS (
  SELECT DISTINCT doc_id, {parts} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM words WHERE len(w) >= {n})
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND {n - 1}),
sizes AS (SELECT doc_id, count(*) AS size FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT doc_a, doc_b, round(shared / (x.size + y.size - shared)::DOUBLE, 6) AS jaccard
FROM common JOIN sizes x ON doc_a = x.doc_id JOIN sizes y ON doc_b = y.doc_id
WHERE shared >= {threshold} * (x.size + y.size - shared) - 1e-9"""


def classes_sql(docs: str, n: int = N, threshold: float = THRESHOLD) -> str:
    return f"""
WITH RECURSIVE pairs AS MATERIALIZED ({pairs_sql(docs, n, threshold)}),
edges AS MATERIALIZED (SELECT doc_a AS a, doc_b AS b FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
root AS (SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS links FROM edges GROUP BY a)
SELECT d.doc_id, coalesce(root, d.doc_id) AS class_id, coalesce(links, 0)::BIGINT AS links
FROM (SELECT DISTINCT doc_id FROM {docs} WHERE doc_id IS NOT NULL) d LEFT JOIN root ON d.doc_id = root.a LEFT JOIN links ON d.doc_id = links.a"""


SQL = classes_sql("documents")
