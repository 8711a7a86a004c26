"""The corpus operators against SQL, brute force and planted cases, and their edge cases."""

from __future__ import annotations

import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import fertility, jaccard_join, language_id, line_dedup, lm_scoring, mixing, packing, queries, quality_classifier, secrets, top_k
from leafmill.llm.common import table, tidy
from tests.oracle import compare, duck, rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang="en", source="s"):
    """texts: strings, or whole rows."""
    data = [t if isinstance(t, tuple) else (i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, DOCS)


LONG = " ".join(f"word{i % 977} and" for i in range(30_000))
ODD = [None, "", " ", "...", "one", "two words", "a\nb\nc", LONG, (None, "no id at all here", "en", "s", 3), (4, "one", None, None, None), (4, "one", None, None, None)]

OPERATORS = {
    "line dedup": line_dedup.dedup_lines, "secrets": secrets.scan_secrets, "packing": packing.pack, "quality": lambda d: quality_classifier.classify(d, None),
    "join": jaccard_join.join, "keep one": jaccard_join.keep_one, "rules": fertility.quality_rules, "keep good": fertility.keep_good, "mixing": mixing.mix, "keep mixed": mixing.keep_mixed,
    "language": lambda d: language_id.identify(d, language_id.fit(d)), "lm": lambda d: lm_scoring.score(d, d, key="doc_id"),
}
#: Names that operators use inside.
CLASHES = ("key", "at", "first", "u", "level", "rest", "prefix", "bucket", "len", "worker", "piece", "fsig", "gsig", "size", "grp", "th", "reasons", "tokens", "row", "words", "a", "b", "jaccard", "h", "t", "nth", "grade")


def test_entry_has_every_operator_and_the_pipeline():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert {x for x in entry.oracle_sql() if x.startswith("op")} == {x for x in queries.SQL if x.startswith("op")}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    n, m, off = compare(queries.QUERIES[name](spark, SF), SF, queries.SQL[name])
    assert n == m > 0 and not off, off


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_empty_tables_and_clashing_names(spark, name):
    run = OPERATORS[name]
    d = docs(spark, ODD)
    plain = run(d)
    got = rows(plain.columns, plain.collect())
    more = d.withColumns({c: F.lit(7) for c in CLASHES})
    clash = run(more)
    assert rows(plain.columns, clash.select(*plain.columns).collect()) == got
    empty = run(docs(spark, []))
    assert empty.columns == plain.columns and empty.count() == 0


# 1


def brute_dedup(texts, window=3):
    seen, out = set(), []
    for text in texts:
        if text is None:
            out.append(None)
            continue
        lines = text.split("\n")
        cut = set()
        for i in range(len(lines) - window + 1):
            key = tuple(x.strip(" ") for x in lines[i : i + window])
            if not any(key):
                continue
            if key in seen:
                cut |= set(range(i, i + window))
            seen.add(key)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in cut))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_line_dedup_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = ["\n".join(rng.choice(["a", "b", " a", "", "c"]) for _ in range(rng.randint(0, 12))) for _ in range(30)] + [None]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_dedup(texts)


def test_line_dedup_rules(spark):
    run = lambda *t, **k: [(r.doc_id, r.text, r.n_chars) for r in line_dedup.dedup_lines(docs(spark, t), **k).orderBy("doc_id").collect()]
    assert run("x\n1\n2\n3", "1\n2\n3\ny\nz") == [(0, "x\n1\n2\n3", 7), (1, "y\nz", 3)]
    assert run("1\n2\n3", "1\n2\n3", drop_emptied=True) == [(0, "1\n2\n3", 5)]
    assert run("1\n2\n3", "1\n2\n3")[1] == (1, "", 0)
    assert run("\n\n\n\n", "\n\n\n\n") == [(0, "\n\n\n\n", 4), (1, "\n\n\n\n", 4)]
    # within a document; overlapping windows merge
    assert run("1\n2\n3\n4\n-\n1\n2\n3\n4") == [(0, "1\n2\n3\n4\n-", 9)]


def test_line_dedup_of_a_text_of_many_lines(spark):
    """Time in proportion to lines, though nearly all of them are cut; and both ways to join the cuts."""
    many = "\n".join("ab"[i % 2] for i in range(60_000))
    texts = [many, "x\na\nb\na\ny"]
    d = docs(spark, texts)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(d).collect()}
    assert [got[0], got[1]] == brute_dedup(texts)
    kept, line_dedup.MAX_BROADCAST_LINES = line_dedup.MAX_BROADCAST_LINES, 0
    try:
        assert {r.doc_id: r.text for r in line_dedup.dedup_lines(d).collect()} == got
    finally:
        line_dedup.MAX_BROADCAST_LINES = kept


# 2


def brute_entropy(run, window):
    best = 0.0
    for i in range(len(run) - window + 1):
        c = Counter(run[i : i + window])
        best = max(best, -sum(n / window * math.log2(n / window) for n in c.values()))
    return best


def test_window_entropy_brute_force():
    rng = random.Random(5)
    terms = [0.0] + [n * math.log2(n) for n in range(1, 30)]
    for _ in range(200):
        run = "".join(rng.choice("abcdef0123"[: rng.randint(1, 10)]) for _ in range(rng.randint(20, 60)))
        assert secrets.window_entropy(run, 20, terms) == pytest.approx(brute_entropy(run, 20), abs=1e-9)


def test_secrets(spark):
    key = "aB3dE5fG7hJ9kL1mN2pQ4rS6"
    d = docs(spark, [f"token {key} end", f"sha256: {'0f3a9c81' * 3}7be4d2", "123e4567-e89b-12d3-a456-426614174000", "plain words only", f"{key}example", "aaaaaaaaaaaaaaaaaaaaaaaaaA1", None, ""])
    got = secrets.scan_secrets(d).collect()
    assert [(r.doc_id, r.start, r.length, r["class"], r.secret) for r in got] == [(0, 6, 24, "alnum", key)]
    far = docs(spark, ["x " * 200_000 + key])
    assert [r.start for r in secrets.scan_secrets(far).collect()] == [400_000]


def test_secrets_whole_table_brute_force(spark):
    d = table(spark, SF.replace("0.001", "0.01"), "documents")
    want = sorted((r.doc_id, *f[:3], round(f[3], 6), f[4]) for r in d.collect() for f in secrets.findings(r.text or ""))
    assert sorted(tuple(r) for r in queries.QUERIES["op2_secrets"](spark, SF.replace("0.001", "0.01")).collect()) == want and want


SECRET_CLASSES = (
    ("hex", lambda r: r.isalnum() and set(r.lower()) <= set("0123456789abcdef") and any(c.isdigit() for c in r) and (r != r.lower()) != (r != r.upper()), 3.0),
    ("alnum", lambda r: r.isalnum() and any(c.isdigit() for c in r) and r != r.lower() and r != r.upper(), 3.7),
    ("onecase", lambda r: r.isalnum() and sum(c.isdigit() for c in r) >= 3 and (r != r.lower()) != (r != r.upper()), 3.6),
)


def whole_run_secrets(text):
    """Written apart from secrets.py: (start, class, text) of runs that stand between other characters, by plain tests and brute-force entropy."""
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9+/=_\-])[A-Za-z0-9]{20,}(?![A-Za-z0-9+/=_\-])", text):
        head = text[max(0, m.start() - 40) : m.start()].lower()
        if re.search(r"(sha-?(1|256|384|512)|md5|commit|integrity|checksum|digest)[\"']?\s*[:=\-]?\s*[\"']?$", head) or "base64," in head[-8:]:
            continue
        if any(x in m.group().lower() for x in ("example", "changeme", "placeholder", "apikey")) or m.group().lower().startswith(("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz")):
            continue
        for name, fits, least in SECRET_CLASSES:
            if fits(m.group()) and brute_entropy(m.group(), 20) >= least:
                out.append((m.start(), name, m.group()))
                break
    return out


def test_secrets_of_one_case_and_upper_hex(spark):
    hexes = ["9233A8EC41D07B56F3E2" + "0C8B7A6D5E4F39281706", "92A3B8EC41D07B56F3E2", "9233a8ec41d07b56f3e2"]
    keys = ["AKIA" + "Q7ZX3MTB5KWP9RLD", "k3j9x2m7q5w8z4t6p1v0b", "7KQ2MZX4TPW9BRL5HJ3V"]
    plain = ["internationalizations", "THEQUICKBROWNFOXJUMPS", "12345678901234567890123", "aaaaaaaaaaaaaaaaaaaaa123", "sha1: 9233A8EC41D07B56F3E20C8B"]
    got = {r.doc_id: (r.start, r["class"], r.secret) for r in secrets.scan_secrets(docs(spark, [f"at {x} end" for x in hexes + keys + plain])).collect()}
    assert got == {i: (3, "hex" if i < len(hexes) else "onecase", x) for i, x in enumerate(hexes + keys)}


def test_secrets_whole_runs_by_an_independent_scan(spark):
    sf = SF.replace("0.001", "0.1")
    want = sorted((r.doc_id, *f) for r in table(spark, sf, "documents").collect() for f in whole_run_secrets(r.text or ""))
    alone = lambda t, a, n: not re.match(r"[A-Za-z0-9+/=_\-]", t[a - 1 : a] or " ") and not re.match(r"[A-Za-z0-9+/=_\-]", t[a + n : a + n + 1] or " ")
    found = queries.QUERIES["op2_secrets"](spark, sf).filter("class <> 'base64'").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    got = sorted((r.doc_id, r.start, r["class"], r.secret) for r in found.collect() if alone(r.text, r.start, r.length))
    assert got == want and any(name == "hex" and run != run.lower() for _, _, name, run in want)


# 3


def test_packing_is_lossless_and_fits(spark):
    d = table(spark, SF, "documents")
    packed = packing.pack(d, workers=3).collect()
    per_bin, pieces = defaultdict(list), defaultdict(list)
    for r in packed:
        per_bin[r.worker, r.size_class, r.bin].append(r)
        pieces[r.doc_id].append((r.first_token, r.n_tokens))
    assert all(sum(r.n_tokens for r in b) <= packing.CAPACITY and len(b) <= b[0].size_class for b in per_bin.values())
    assert all(sorted(r.slot for r in b) == list(range(len(b))) for b in per_bin.values())
    for r in d.collect():
        n = len(re.findall(r"[^ \t\n\r\f\x0b]+", r.text or ""))
        at = 0
        for first, k in sorted(pieces.get(r.doc_id, [])):
            assert first == at
            at += k
        assert at == n
    partly = Counter((w, c) for (w, c, _), b in per_bin.items() if len(b) < c)
    assert max(partly.values(), default=0) <= 1


# 4


def test_quality_classifier_held_out(spark):
    d, labels = table(spark, SF.replace("0.001", "0.1"), "documents"), table(spark, SF.replace("0.001", "0.1"), "labels")
    even = labels.filter(F.xxhash64("doc_id") % 2 == 0)
    model = quality_classifier.fit(d, even)
    assert (np.diff(model.theta) > 0).all()
    rest = labels.filter(F.xxhash64("doc_id") % 2 != 0).select("doc_id", quality_classifier.grade().alias("g")).filter("g is not null")
    got = quality_classifier.classify(d, model).join(rest, "doc_id").collect()
    good, bad = [r for r in got if r.g == 2], [r for r in got if r.g < 2]
    assert np.mean([r.keep for r in good]) > 0.9
    assert np.mean([not r.keep for r in bad]) > 0.8


def test_ordinal_gradient_direction():
    """One feature that rises with the grade: expected grades rise, probabilities sum to 1."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 600)
    ids, values, ends = np.zeros(600, np.int64) + 5, (y + rng.normal(0, 0.3, 600)).astype(np.float32), np.arange(601)
    m = quality_classifier.train(ids, values, ends, y)
    p = m.probabilities(m.latent(np.array([5, 5, 5]), np.array([0.0, 1.0, 2.0]), np.arange(4)))
    assert np.allclose(p.sum(1), 1) and (np.diff(p @ np.arange(3)) > 0).all() and p[2].argmax() == 2 and p[0].argmax() == 0


# 5


def gram_sets(texts, n=3):
    out = {}
    for i, t in texts:
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        if w:
            out[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}
    return out


def classes(pairs, nodes):
    root = {x: x for x in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in nodes}


def brute_pairs(sets):
    out = {}
    for a in sets:
        for b in sets:
            if a < b and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= jaccard_join.THRESHOLD - 1e-9:
                out[a, b] = round(j, 6)
    return out


@pytest.mark.parametrize(("bits", "run", "tile"), [(4, 4096, 700), (22, 4, 2)])
def test_join_brute_force(spark, monkeypatch, bits, run, tile):
    monkeypatch.setattr(jaccard_join, "RUN", run)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "SLAB", 64 if tile == 2 else 1 << 14)
    rng = random.Random(1)
    base = [[rng.choice("abcdefgh") * 2 for _ in range(rng.randint(1, 40))] for _ in range(12)]
    texts = []
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice("abcdefgh")
        texts.append(" ".join(w))
    sets = gram_sets(enumerate(texts))
    want = brute_pairs(sets)
    root = classes(want, range(len(texts)))
    links = Counter(x for p in want for x in p)
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard_join.join(docs(spark, texts), bits=bits).collect()}
    assert got == {i: (root[i], links[i]) for i in range(len(texts))}
    # pairs of different sets, each by its least document
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    some = {p: j for p, j in want.items() if set(p) <= set(first.values())}
    found = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard_join.similar_pairs(docs(spark, texts), bits=bits).collect()}
    assert found == pytest.approx(some)


def test_join_of_a_large_cluster(spark, monkeypatch):
    """Hundreds of near copies and copies of one text: every link counts, and n-grams of many documents are cut into blocks."""
    monkeypatch.setattr(jaccard_join, "RUN", 16)
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    texts = []
    for i in range(260):
        w = list(base)
        for _ in range(0 if i % 5 == 0 else rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"y{rng.randrange(10**6)}" for _ in range(50)) for _ in range(20)]
    want = brute_pairs(gram_sets(enumerate(texts)))
    root, links = classes(want, range(len(texts))), Counter(x for p in want for x in p)
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard_join.join(docs(spark, texts)).collect()}
    assert got == {i: (root[i], links[i]) for i in range(len(texts))}
    assert all(got[i] == (i, 0) for i in range(260, 280))


def test_join_of_several_texts_of_one_id(spark):
    d = docs(spark, [(1, "a b c d", "en", "s", 7), (1, "e f g h", "en", "s", 7), (2, "a b c d", "en", "s", 7), (3, "e f g h", "en", "s", 7), (3, "e f g h", "en", "s", 7), (4, "z", "en", "s", 1)])
    assert {r.doc_id: (r.class_id, r.links) for r in jaccard_join.join(d).collect()} == {1: (1, 2), 2: (1, 1), 3: (1, 1), 4: (4, 0)}


def test_keep_one_takes_the_least_of_each_class(spark):
    texts = [r.text for r in table(spark, SF, "documents").orderBy("doc_id").collect()]
    d = docs(spark, texts)
    root = classes(brute_pairs(gram_sets(enumerate(texts))), range(len(texts)))
    assert sorted(r.doc_id for r in jaccard_join.keep_one(d).collect()) == [i for i in range(len(texts)) if root[i] == i]


def test_parities_never_rule_out_similar_sets():
    rng = np.random.default_rng(3)
    for _ in range(100):
        h = np.unique(rng.integers(0, 2**63, rng.integers(3, 400)).astype(np.uint64))
        a, b = h[: int(len(h) * 0.9)], h[int(len(h) * 0.1) :]
        (x,), (y,) = (jaccard_join._parities(s, np.zeros(len(s), np.int64), np.array([len(s)])) for s in (a, b))
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_sets_travel_without_loss():
    rng = np.random.default_rng(1)
    for n in (1, 2, 300):
        h = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (jaccard_join._thick(jaccard_join._thin(h)) == h).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    for limit in (0, 1000):
        got = jaccard_join.components(spark.createDataFrame(edges, "a long, b long"), limit)
        assert {r.node: r.root for r in got.collect()} == root
    assert jaccard_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 6


def test_fertility_against_the_tokenisers(spark):
    import base64

    import sentencepiece
    import tiktoken

    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{fertility.TOKENIZERS}/{fertility.PIECES}")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{fertility.TOKENIZERS}/{fertility.BYTES}", "rb"))}
    by_bytes = tiktoken.Encoding("own", pat_str=fertility.BYTE_WORDS, mergeable_ranks=ranks, special_tokens={})
    texts = [r.text for r in table(spark, SF, "documents").collect() if r.text] + ["héllo  wörld\n\nx", " lead", "日本語のテキスト", "a\tb \n c", "▁mark", "\x01x y", "emoji 😀 😀"]
    n, piece_chars, byte_chars, fallback, entropy = fertility.Vocabularies(fertility.TOKENIZERS).measure(texts)
    lead = len(pieces.encode("\n"))
    for i, t in enumerate(texts):
        ids = pieces.encode("\n " + t if t[0] != "\n" else "\n" + t)[lead:]
        c = np.array(list(Counter(ids).values())) / len(ids)
        assert n[i] == len(ids), t[:80]
        assert byte_chars[i] == pytest.approx(len(t) / len(by_bytes.encode_ordinary(t))), t[:80]
        assert entropy[i] == pytest.approx(-(c * np.log2(c)).sum(), abs=1e-9), t[:80]


def test_fertility_keeps_clean_and_drops_junk(spark):
    d = table(spark, SF.replace("0.001", "0.01"), "documents")
    rng = random.Random(0)
    junk = [(10**6 + i, "".join(chr(rng.randrange(0x2500, 0x2600)) for _ in range(400)), "en", "s", 400) for i in range(5)]
    judged = fertility.quality_rules(d.unionByName(spark.createDataFrame(junk, d.schema))).collect()
    assert all(not r.keep for r in judged if r.doc_id >= 10**6)
    assert np.mean([r.keep for r in judged if r.doc_id < 10**6]) > 0.9
    kept = {r.doc_id for r in fertility.keep_good(d).collect()}
    assert kept == {r.doc_id for r in fertility.quality_rules(d).collect() if r.keep}


def test_fertility_drops_repetitive_text(spark):
    d = table(spark, SF.replace("0.001", "0.01"), "documents")
    rng = random.Random(0)
    few = [f"{w}" for w in "Reanwh tolim sard venk oulo prat mese lind".split()]
    texts = ["house " * 300, " ".join(rng.choice(few) for _ in range(1500)), "again and again " * 60, "same " * 12]
    planted = [(10**6 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    judged = {r.doc_id: r for r in fertility.quality_rules(d.unionByName(spark.createDataFrame(planted, d.schema))).collect()}
    assert all("token_entropy" in judged[10**6 + i].reasons for i in range(len(texts)))
    labels = table(spark, SF.replace("0.001", "0.01"), "labels").collect()
    by = lambda q: [judged[r.doc_id] for r in labels if r.quality == q and r.toxic != 1 and r.doc_id in judged]
    assert np.mean(["token_entropy" in r.reasons for r in by(1)]) < 0.01
    assert np.mean(["token_entropy" in r.reasons for r in by(0)]) > 0.3


@pytest.mark.parametrize("n", [10, 49, 50, 120])
def test_fertility_small_groups_keep_their_median(spark, n):
    """A group that tokenises unlike the majority isn't rejected as a whole, however small; its outlier is."""
    d = table(spark, SF, "documents").limit(150)
    rng = random.Random(3)
    thai = ["".join(chr(rng.randrange(0x0E01, 0x0E2F)) if rng.random() > 0.15 else " " for _ in range(400)).strip() for _ in range(n)]
    added = [(10**6 + i, t, "th", "s", len(t)) for i, t in enumerate(thai)] + [(10**6 + n, "gold " * 200, "th", "s", 1000)]
    judged = {r.doc_id: r for r in fertility.quality_rules(d.unionByName(spark.createDataFrame(added, d.schema))).collect()}
    assert np.mean([judged[10**6 + i].keep for i in range(n)]) > 0.9
    assert not judged[10**6 + n].keep


def test_fertility_holds_few_texts_at_a_time():
    class Counting:
        def measure(self, texts):
            self.most = max(getattr(self, "most", 0), len(texts))
            n = np.array(list(map(len, texts)))
            return n, *[n.astype(float)] * 4

    n, v = 5000, Counting()
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["en"] * n), pa.array(range(n)), pa.array([f"{i} " * 800 for i in range(n)])], names=["doc_id", "grp", "th", "text"])
    tracemalloc.start()
    try:
        rows_out = [r for part in fertility.measured_parts(v, iter([batch])) for r in part.column(0).to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 18 MB of texts, of which a chunk at most is held as strings
    assert rows_out == list(range(n)) and v.most <= fertility.CHUNK and peak < 6e6


def test_workers_hand_freed_memory_back():
    def resident():
        return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    def run(batches):
        held = [bytearray(b"x" * 50_000) for _ in range(6000)]
        pins.append(held[-1])  # what is at the heap's end keeps the rest from being returned
        held.clear()
        yield from batches

    pins: list = []
    before = resident()
    assert list(tidy(run)(iter([1, 2]))) == [1, 2] and pins
    assert resident() - before < 150


# 7


def test_mixing_matches_targets_and_nests(spark):
    rng = random.Random(4)
    d = spark.createDataFrame([(i, "w " * rng.randint(1, 30), "en", rng.choice(["src0", "x", "y"]), 1) for i in range(600)], DOCS)
    got = mixing.mix(d).collect()
    for level in mixing.LEVELS:
        tokens = Counter()
        for r in got:
            if r.level <= level:
                tokens[r.source] += r.n_tokens
        total = sum(tokens.values())
        assert tokens["src0"] / total == pytest.approx(0.2, abs=0.05) and tokens["x"] / total == pytest.approx(0.4, abs=0.05)
    kept = sorted(r.doc_id for r in mixing.keep_mixed(d).collect())
    assert kept == sorted(r.doc_id for r in got)


def test_mixing_small_unnamed_sources_do_not_bind_the_total(spark):
    rng = random.Random(4)
    many = [(i, "w " * rng.randint(1, 30), "en", rng.choice(["src0", "x", "y", "z"]), 1) for i in range(600)]
    tiny = [(1000, "w " * 10, "en", None, 1), (1001, "w " * 7, "en", "tail", 1)]
    have = Counter()
    for r in many:
        have[r[3]] += len(r[1]) // 2
    got = mixing.mix(spark.createDataFrame(many + tiny, DOCS)).collect()
    by = Counter()
    for r in got:
        by[r.source] += r.n_tokens
    total = min(have["src0"] / 0.2, (sum(have.values()) - have["src0"] + 17) / 0.8)
    assert by[None] == 10 and by["tail"] == 7
    assert sum(by.values()) == pytest.approx(total, abs=31 * 6) and sum(by.values()) <= total
    assert by["src0"] == pytest.approx(0.2 * total, abs=31)
    # the short sources' remainder goes to the others
    first = Counter()
    for r in got:
        if r.level == 0.1:
            first[r.source] += r.n_tokens
    assert all(first[s] == pytest.approx((0.08 * total - 17) / 3, abs=31) for s in "xyz")


# 8


def brute_kernel(a, b):
    def grams(t):
        x = t.lower().encode()
        return {x[i : i + n] for n in language_id.LENGTHS for i in range(len(x) - n + 1)}

    x, y = grams(a), grams(b)
    return len(x & y) / math.sqrt(len(x) * len(y))


def test_kernel_brute_force():
    texts = ["the cat sat on the mat", "der Hund läuft schnell", "a", "le chat est là"]
    x = language_id.presence(texts)
    got = language_id.kernel(x, x)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert got[i, j] == pytest.approx(brute_kernel(a, b), abs=0.03)  # features are hashed


def test_language_held_out(spark):
    d = table(spark, SF.replace("0.001", "0.01"), "documents").filter("length(text) > 100")
    model = language_id.fit(d.filter(F.xxhash64("doc_id") % 2 == 0))
    got = language_id.identify(d.filter(F.xxhash64("doc_id") % 2 != 0), model).collect()
    assert np.mean([r.agrees for r in got]) > 0.9


# 9


def test_top_k_edges(spark):
    rng = np.random.default_rng(0)
    v = [(int(i), [float(x) for x in rng.normal(size=5)]) for i in range(150)]
    v += [(150, v[3][1]), (151, v[3][1]), (152, [0.0] * 5), (153, None), (None, [1.0] * 5), (154, [1.0, 2.0]), (155, [float("nan")] * 5), (3, v[3][1])]
    got = top_k.nearest(spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumns({"block": F.lit(1), "rank": F.lit(2)}), k=7, block=32).collect()
    good = {i: np.array(x) for i, x in v if i is not None and x is not None and len(x) == 5 and not np.isnan(x).any()}
    unit = {i: x / (np.linalg.norm(x) or 1) for i, x in good.items()}
    for i in good:
        order = sorted((-round(float(unit[i] @ unit[j]) * 1e6), j) for j in good if j != i)[:7]
        mine = sorted((r.rank, r.neighbor_id) for r in got if r.query_id == i)
        assert [j for _, j in mine] == [j for _, j in order], i
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert top_k.nearest(none).count() == 0


def test_top_k_odd_length_loses_only_itself(spark):
    v = [(i, [float(i), 1.0]) for i in range(4)] + [(9, [1.0, 2.0, 3.0])]
    got = top_k.nearest(spark.createDataFrame(v, "vec_id long, embedding array<double>"), k=2).collect()
    assert {r.query_id for r in got} == {0, 1, 2, 3} and len(got) == 8 and 9 not in {r.neighbor_id for r in got}


def test_top_k_of_chosen_queries(spark):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(int(i), [float(x) for x in rng.normal(size=4)]) for i in range(200)], "vec_id long, embedding array<double>")
    every = sorted(tuple(r) for r in top_k.nearest(v, k=5, block=32).collect() if r.query_id % 50 == 0)
    assert sorted(tuple(r) for r in top_k.nearest(v, k=5, block=32, queries=F.col("vec_id") % 50 == 0).collect()) == every and len(every) == 20
    assert top_k.nearest(v, queries=F.col("vec_id") < 0).count() == 0


# 10


def test_lm_brute_force(spark):
    rng = random.Random(0)
    corpus = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(40)] + [None, ""]
    texts = [" ".join(rng.choice("abcdz") for _ in range(rng.randint(0, 12))) for _ in range(20)] + [None]
    tokens = [lm_scoring.tokens(t) for t in corpus]
    total, vocabulary = sum(map(len, tokens)), len({x for t in tokens for x in t})

    def count(gram):
        k = len(gram)
        return sum(t[i : i + k] == gram for t in tokens for i in range(len(t) - k + 1))

    def starts(gram):  # occurrences of a context; the empty one occurs before every token
        return count(gram) if gram else total

    for shard in (7, 2_000_000):
        lm_scoring.SHARD_TOKENS, kept = shard, lm_scoring.SHARD_TOKENS
        deep, lm_scoring.DEEP = lm_scoring.DEEP, 2 if shard == 7 else 16
        try:
            got = {r.doc_id: r for r in lm_scoring.score(docs(spark, texts), docs(spark, corpus), key="doc_id").collect()}
        finally:
            lm_scoring.SHARD_TOKENS, lm_scoring.DEEP = kept, deep
        for i, t in enumerate(texts):
            w, log_prob, lengths = lm_scoring.tokens(t), 0.0, []
            for k, x in enumerate(w):
                s = next(s for s in range(k + 1) if s == k or count(w[s:k]))
                u = (count([x]) + 1) / (total + vocabulary + 1)
                log_prob += math.log((count(w[s : k + 1]) + lm_scoring.ALPHA * u) / (starts(w[s:k]) + lm_scoring.ALPHA))
                lengths.append(k - s)
            assert got[i].n_tokens == len(w) and got[i].log_prob == pytest.approx(log_prob, abs=1e-5), (shard, i, t)
            if w:
                assert got[i].mean_match == pytest.approx(sum(lengths) / len(w), abs=1e-6) and got[i].longest_match == max(lengths)


def test_long_matches():
    """Stretches far beyond the step-by-step depth: the same counts as with steps all the way."""
    rng = np.random.default_rng(0)
    text = rng.integers(0, 3, 4000)
    lengths = np.array([1500, 1500, 1000])
    query = np.concatenate([text[100:900], [7], text[300:1400], rng.integers(0, 3, 300), text[1400:1600], text[100:900]])
    ends = np.repeat(np.cumsum([1901, 500, 800]), [1901, 500, 800])
    shard = lm_scoring.Shard(text, lengths, 3000)
    found = []
    for deep in (4, 10_000):
        lm_scoring.DEEP, kept = deep, lm_scoring.DEEP
        try:
            found.append(shard.look_up(query, ends))
        finally:
            lm_scoring.DEEP = kept
    assert all((a == b).all() for a, b in zip(*found)) and found[0][0].max() > 700


@pytest.mark.parametrize(("shard", "block", "deep"), [(7, 5, 2), (60, 11, 3), (2_000_000, 500_000, 16)])
def test_lm_scores_each_document_by_the_others(spark, shard, block, deep):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(20)] + [None, "", "q r s t q r s t q r s t u", "only here"]
    texts += [texts[3], "x " + " ".join("abcdabcdab") + " y", "z " + " ".join("abcdabcdab")]
    tokens = [lm_scoring.tokens(t) for t in texts]
    vocabulary = len({x for t in tokens for x in t})
    kept = lm_scoring.SHARD_TOKENS, lm_scoring.PASS_TOKENS, lm_scoring.DEEP
    lm_scoring.SHARD_TOKENS, lm_scoring.PASS_TOKENS, lm_scoring.DEEP = shard, block, deep
    try:
        got = {r.doc_id: r for r in lm_scoring.score(docs(spark, texts).coalesce(1), None, key="doc_id").collect()}
    finally:
        lm_scoring.SHARD_TOKENS, lm_scoring.PASS_TOKENS, lm_scoring.DEEP = kept
    assert len(got) == len(texts)
    for i, w in enumerate(tokens):
        rest = [t for j, t in enumerate(tokens) if j != i]
        total = sum(map(len, rest))

        def count(gram):
            return sum(t[a : a + len(gram)] == gram for t in rest for a in range(len(t) - len(gram) + 1)) if gram else total

        log_prob, lengths = 0.0, []
        for k, x in enumerate(w):
            s = next(s for s in range(k + 1) if s == k or count(w[s:k]))
            u = (count([x]) + 1) / (total + vocabulary + 1)
            log_prob += math.log((count(w[s : k + 1]) + lm_scoring.ALPHA * u) / (count(w[s:k]) + lm_scoring.ALPHA))
            lengths.append(k - s)
        assert got[i].n_tokens == len(w) and got[i].log_prob == pytest.approx(log_prob, abs=1e-5), (i, w)
        if w:
            assert got[i].mean_match == pytest.approx(sum(lengths) / len(w), abs=1e-6) and got[i].longest_match == max(lengths)


def test_lm_rows_of_one_key_and_text_are_one_document(spark):
    d = docs(spark, [(1, "a b c a b", "en", "s", 9), (1, "a b c a b", "en", "s", 9), (2, "a b c a b", "en", "s", 9), (None, "x y", "en", "s", 3), (None, "x y", "en", "s", 3)])
    got = lm_scoring.score(d, None, key="doc_id").collect()
    assert sorted((r.doc_id or 0, r.longest_match) for r in got) == [(0, 0), (0, 0), (1, 4), (1, 4), (2, 4)]
    one = lm_scoring.score(d, None, key="doc_id", queries=F.col("doc_id") == 2).collect()
    assert [(r.doc_id, r.n_tokens, r.log_prob) for r in one] == [(r.doc_id, r.n_tokens, r.log_prob) for r in got if r.doc_id == 2]


def test_lm_counts_are_added_up_within_a_task_or_after_it(spark, monkeypatch):
    d = table(spark, SF, "documents")
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 9000)
    monkeypatch.setattr(lm_scoring, "PASS_TOKENS", 700)
    got = []
    for room in (0, 1500, 10**9):
        monkeypatch.setattr(lm_scoring, "MERGED_TOKENS", room)
        got.append(rows(["a"], [[tuple(r)] for r in lm_scoring.score(d, None, key="doc_id", queries=F.col("doc_id") % 10 == 0).collect()]))
    assert got[0] == got[1] == got[2] and len(got[0]) == d.filter("doc_id % 10 = 0").count()


def test_lm_query_scores_every_fiftieth_document_by_all(spark):
    d = table(spark, SF, "documents")
    got = queries.QUERIES["op10_lm_scoring"](spark, SF).collect()
    want = {r.doc_id: len(lm_scoring.tokens(r.text)) for r in d.collect() if r.doc_id % 50 == 0}
    assert {r.doc_id: r.n_tokens for r in got} == want


def test_lm_suffix_arrays_hold_only_what_is_shared_with_queries(spark, monkeypatch):
    rng = random.Random(5)
    copied = " ".join(f"c{i}" for i in range(30))
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(100)) for _ in range(60)]
    texts[7] += " " + copied + " end"
    texts[50] += " " + copied + " tail"
    d, kept, held = docs(spark, texts), lm_scoring.count_matches, []

    def counting(corpus, *rest):
        held.append(corpus.agg(F.sum(F.size("tokens"))).first()[0])
        return kept(corpus, *rest)

    monkeypatch.setattr(lm_scoring, "count_matches", counting)
    got = {r.doc_id: r for r in lm_scoring.score(d, None, key="doc_id", queries=F.col("doc_id") % 50 == 0).collect()}
    assert got[50].longest_match == 30 and held[0] < 100  # of 6,062 tokens


def test_lm_scores_are_the_same_wherever_suffix_arrays_begin(spark, monkeypatch):
    d, got = table(spark, SF, "documents"), []
    for gram in (2, 9):
        monkeypatch.setattr(lm_scoring, "GRAM", gram)
        got.append(rows(["a"], [[tuple(r)] for r in lm_scoring.score(d, None, key="doc_id", queries=F.col("doc_id") % 10 == 0).collect()]))
    assert got[0] == got[1] and len(got[0]) == d.filter("doc_id % 10 = 0").count()


def test_lm_counts_travel_and_stay_packed(spark, monkeypatch):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(20000)}" for _ in range(400)) for _ in range(200)]
    asked = [lm_scoring.tokens(t) for t in texts[::2]]
    # what has to be counted: all different tokens, documents, and the queries' stretches; each is in the corpus
    counted = len({x for t in texts for x in t.split()} | {tuple(w[i : i + d]) for w in asked for d in range(2, lm_scoring.GRAM + 1) for i in range(len(w) - d + 1)}) + len(asked)
    store, gateway, kept, disk = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway, lm_scoring.materialize, {}

    def shuffled():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    def watched(df, tag):
        before = shuffled()
        out = kept(df, tag)
        disk[tag] = shuffled() - before, sum(Path(f.removeprefix("file://")).stat().st_size for f in out.inputFiles())
        return out

    monkeypatch.setattr(lm_scoring, "materialize", watched)
    got = lm_scoring.score(docs(spark, texts).coalesce(1), None, key="doc_id", queries=F.col("doc_id") % 2 == 0).collect()
    assert len(got) == len(asked)
    moved, stay = (sum(disk[tag][k] for tag in disk if tag in ("lm-counted", "lm-found")) for k in (0, 1))
    assert 4 * counted < moved < 9 * counted and stay < 9 * counted, (moved, stay, counted)


@pytest.mark.parametrize(("tokens_at_once", "added"), [(3, 1), (50, 40), (4_000_000, 2_000_000)])
def test_lm_counts_are_whole_however_they_are_packed(spark, monkeypatch, tokens_at_once, added):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(40)] + [None, "", "a b c d"]
    d = docs(spark, texts)
    want = {r.doc_id: r for r in lm_scoring.score(d, None, key="doc_id").collect()}
    for name, value in (("COUNT_TOKENS", tokens_at_once), ("ADDED_GRAMS", added), ("PART_GRAMS", 20)):
        monkeypatch.setattr(lm_scoring, name, value)
    assert {r.doc_id: r for r in lm_scoring.score(d, None, key="doc_id").collect()} == want
    h = np.sort(np.unique(np.random.default_rng(0).integers(0, 2**64, 500, np.uint64)))
    for grams in (h[:0], h[:1], h, np.array([0, 2**64 - 1], np.uint64)):
        n = np.arange(len(grams)) * 2**33 + 1
        assert [x.tolist() for x in lm_scoring._unpack(lm_scoring._pack(grams, n))] == [grams.tolist(), n.tolist()]


# pipeline


def test_pipeline_stages_one_by_one(spark):
    import corpus_pipeline

    d = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert 0 < len(ids) <= d.count()
        d = spark.createDataFrame(out.collect(), d.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, d, SF)
    assert {r.doc_id for r in packed.collect()} <= {r.doc_id for r in d.collect()}


def test_pipeline_against_sql_after_the_first_stage(spark, tmp_path):
    """SQL for all stages but the tokenisers', chained over what that stage keeps."""
    import corpus_pipeline

    good = fertility.keep_good(table(spark, SF, "documents"))
    good.write.parquet(str(tmp_path / "good"))
    deduped = line_dedup.select_sql("good", drop_emptied=True)
    names, pairs = duck(SF, f"WITH RECURSIVE deduped AS ({deduped}) SELECT * FROM ({jaccard_join.pairs_sql('deduped')})", {"good": str(tmp_path / "good")})
    root: dict[int, int] = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b, _ in (tuple(p[names.index(c)] for c in ("doc_a", "doc_b", "jaccard")) for p in pairs):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    gone = [i for i in root if find(i) != i]
    kept = f"SELECT * FROM ({deduped}) WHERE doc_id NOT IN ({', '.join(map(str, gone)) or -1})"
    mixed = f"SELECT * FROM kept WHERE doc_id IN (SELECT doc_id FROM ({mixing.select_sql('kept', (1.0,))}))"
    sql = f"WITH kept AS MATERIALIZED ({kept}), mixed AS MATERIALIZED ({mixed}) SELECT * FROM ({packing.select_sql('mixed')})"
    got = corpus_pipeline.run(spark, SF)
    n, m, off = compare(got, SF, sql, {"good": str(tmp_path / "good")})
    assert n == m > 0 and not off, off


def test_pipeline_stages_take_odd_rows_and_empty_tables(spark):
    import corpus_pipeline

    words = " ".join(r.text for r in table(spark, SF, "documents").filter("lang = 'en'").limit(3).collect())
    d = docs(spark, [*ODD, words, words, (None, words, None, None, None)]).withColumn("extra", F.lit(7))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, SF)
        rows_ = out.collect()
        assert stage(spark, docs(spark, []), SF).count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == d.columns, name
            before = Counter(r.doc_id for r in d.collect())
            assert all(n <= before[i] for i, n in Counter(r.doc_id for r in rows_).items()), name
