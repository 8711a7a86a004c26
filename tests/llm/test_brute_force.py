"""Versions of the operators without SQL that are written apart from them, and bounds that repeated rows must not break."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from leafmill.llm import fertility, language_id, quality_classifier, queries, secrets
from leafmill.llm.common import table

SF1, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# secrets

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALL = set(DIGITS + LOWER + UPPER + "+/=_-")


def one_case_runs(s, lower, upper):
    """Stretches of digits and letters of one case: leading digits go with the letter after them, others with the one before."""
    i = 0
    while i < len(s):
        start = i
        while i < len(s) and s[i] in DIGITS:
            i += 1
        case = lower if i < len(s) and s[i] in lower else upper if i < len(s) and s[i] in upper else None
        if case is None:
            i += i == start or i < len(s)
            continue
        while i < len(s) and (s[i] in DIGITS or s[i] in case):
            i += 1
        yield start, i


def plain_runs(s, inside):
    i = 0
    while i < len(s):
        j = i
        while j < len(s) and s[j] in inside:
            j += 1
        if j > i:
            yield i, j
        i = max(j, i + 1)


RULES = (
    ("hex", lambda s: one_case_runs(s, "abcdef", "ABCDEF"), 3.0, lambda r: any(c in DIGITS for c in r)),
    ("alnum", lambda s: plain_runs(s, DIGITS + LOWER + UPPER), 3.7, lambda r: all(any(c in k for c in r) for k in (DIGITS, LOWER, UPPER))),
    ("onecase", lambda s: one_case_runs(s, LOWER, UPPER), 3.6, lambda r: sum(c in DIGITS for c in r) >= 3),
    ("base64", lambda s: plain_runs(s, ALL), 3.9, lambda r: all(any(c in k for c in r) for k in (DIGITS, LOWER, UPPER, "+/=_-"))),
)


def allowed(run):
    low = run.lower()
    parts = run.split("-")
    uuid = [len(p) for p in parts] == [8, 4, 4, 4, 12] and set(low) <= set("0123456789abcdef-")
    return uuid or any(x in low for x in ("example", "changeme", "placeholder")) or bool(re.search("your[-_]?(api)?[-_]?key", low)) or low.startswith(("0123456789abcdef", LOWER))


def entropy(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values())


def plain_secrets(text, window=20):
    for a, b in plain_runs(text, ALL):
        whole, found = text[a:b], []
        if len(whole) < window:
            continue
        for name, runs, least, enough in RULES:
            for x, y in list(runs(whole)):
                run = whole[x:y]
                if y - x < window or not enough(run) or any(p <= x and y <= q for p, q in found):
                    continue
                bits = max(entropy(run[i : i + window]) for i in range(len(run) - window + 1))
                head = text[max(0, a + x - 40) : a + x].lower()
                named = re.search(r"(sha-?(1|256|384|512)|md5|commit|integrity|checksum|digest)[\"']?\s*[:=\-]?\s*[\"']?$", head) or re.search(r"data:[a-z]+/[a-z+.\-]+;base64,$", head)
                if bits < least - 1e-12 or allowed(run) or allowed(whole) or named:
                    continue
                found.append((x, y))
                yield a + x, y - x, name, round(bits, 6), run


def test_secrets_of_the_whole_table_by_an_independent_scan(spark):
    want = sorted((r.doc_id, *f) for r in table(spark, SF2, "documents").collect() for f in plain_secrets(r.text or ""))
    got = sorted(tuple(r) for r in queries.QUERIES["op2_secrets"](spark, SF2).collect())
    assert [(*w[:4], w[5]) for w in want] == [(*g[:4], g[5]) for g in got] and want
    assert [w[4] for w in want] == pytest.approx([g[4] for g in got], abs=2e-6)


def test_secrets_of_random_strings():
    rng = random.Random(7)
    for _ in range(400):
        text = "".join(rng.choice(rng.choice(["0123456789abcdef", "ABCDEF0123", "abcXYZ019", "+/_-a1B", " ", "1"])) for _ in range(rng.randint(0, 160)))
        text += "".join(rng.choice("0123456789abcdefABCDEFxyz+") for _ in range(60))
        assert [(s, n, c, t) for s, n, c, _, t in sorted(secrets.findings(text))] == [(s, n, c, t) for s, n, c, _, t in sorted(plain_secrets(text))], text


@pytest.mark.parametrize("kind", ["1", "a", "aB1", "0123456789abcdef", LOWER + UPPER + DIGITS + "+/", "ab1 "])
def test_secrets_take_time_in_proportion(kind):
    rng = random.Random(0)
    text = "".join(rng.choice(kind) for _ in range(1_000_000)) if kind != "aB1" else "aB1" * 333_333
    start = time.time()
    secrets.findings(text)
    assert time.time() - start < 60


# quality classifier


def loss(w, theta, x, y):
    """Mean negative log-likelihood of a cumulative-link model, and the penalty."""
    cum = 1 / (1 + np.exp(-(theta[None, :] - (x @ w)[:, None])))
    cum = np.hstack([np.zeros((len(y), 1)), cum, np.ones((len(y), 1))])
    p = cum[np.arange(len(y)), y + 1] - cum[np.arange(len(y)), y]
    return -np.log(np.maximum(p, 1e-12)).mean() + quality_classifier.L2 / 2 * (w**2).sum()


def test_ordinal_fit_reaches_the_least_loss():
    """Against plain descent with numeric gradients."""
    rng = np.random.default_rng(3)
    n, k = 500, 4
    x = rng.normal(size=(n, k))
    y = np.digitize(x @ np.array([1.5, -1.0, 0.5, 0.0]) + rng.logistic(size=n), [-1.0, 1.0])
    model = quality_classifier.train(np.tile(np.arange(k), n), x.astype(np.float32).ravel(), np.arange(0, n * k + 1, k), y)
    v = np.array([0.0] * k + [-1.0, math.log(2.0)])
    f = lambda v: loss(v[:k], np.array([v[k], v[k] + math.exp(v[k + 1])]), x, y)
    for _ in range(800):
        g = np.array([(f(v + e) - f(v - e)) / 2e-5 for e in np.eye(k + 2) * 1e-5])
        v -= 0.8 * g
    mine = loss(model.weights[:k].astype(float), model.theta, x, y)
    assert mine < f(v) + 0.003
    assert model.weights[:k] == pytest.approx(v[:k], abs=0.15) and model.theta == pytest.approx([v[k], v[k] + math.exp(v[k + 1])], abs=0.15)


def test_quality_scores_of_the_whole_table_one_by_one(spark):
    d, labels = table(spark, SF1, "documents"), table(spark, SF1, "labels")
    model = quality_classifier.fit(d, labels)
    got = {r.doc_id: r for r in quality_classifier.classify(d, model).collect()}
    for r in d.collect():
        if not r.text:
            assert got[r.doc_id].tail_probability is None
            continue
        counts = Counter(r.text.split())
        one = quality_classifier.Features()
        bare, shapes = set(), Counter()
        for w, c in counts.items():
            a, b = one.of(w)
            bare.add(a)
            shapes[b] += c
        z = sum(float(model.weights[i]) * quality_classifier.WORD for i in bare) + sum(float(model.weights[i]) * quality_classifier.SHAPE * c / sum(counts.values()) for i, c in shapes.items())
        below = [1 / (1 + math.exp(min(30, max(-30, z - t)))) for t in model.theta]
        assert got[r.doc_id].tail_probability == pytest.approx(1 - below[1], abs=1e-4)
        assert got[r.doc_id].expected_grade == pytest.approx((1 - below[0]) + (1 - below[1]), abs=1e-4)


def test_quality_sample_keeps_its_bound(spark):
    d = spark.createDataFrame([(1, f"text number {i % 7}", "en", "s", 1) for i in range(1000)] + [(2, "other words", "en", "s", 1), (3, "third one", "en", "s", 1)], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    ids, values, ends, y = quality_classifier.sample(d, labels, rows=2)
    assert len(y) == 2
    again = quality_classifier.sample(d.orderBy(d.text.desc()), labels, rows=2)
    assert all((a == b).all() for a, b in zip((ids, values, ends, y), again))
    assert len(quality_classifier.sample(d, labels, rows=10)[3]) == 3


# fertility


def test_fertility_pieces_and_fallback(spark):
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{fertility.TOKENIZERS}/{fertility.PIECES}")
    texts = [r.text for r in table(spark, SF1, "documents").collect() if r.text] + ["日本語のテキスト 😀 😀 ꙮ", "plain"]
    n, piece_chars, _, fallback, _ = fertility.Vocabularies(fertility.TOKENIZERS).measure(texts)
    lead = len(pieces.encode("\n"))
    for i, t in enumerate(texts):
        ids = pieces.encode("\n " + t if t[0] != "\n" else "\n" + t)[lead:]
        assert piece_chars[i] == pytest.approx(len(t) / len(ids))
        assert fallback[i] == pytest.approx(sum(pieces.is_byte(x) for x in ids) / len(ids))
    assert fallback[-2] > 0 and fallback[-1] == 0


def test_fertility_reasons_of_the_whole_table(spark):
    """Medians, deviations and bands in plain Python from the measures."""
    rows = [r for r in queries.QUERIES["op6_fertility"](spark, SF2).collect() if r.reasons != ["empty"]]
    value = lambda r, m: r[m] / math.log2(min(fertility.FULL, r.n_tokens) + 1) if m == "token_entropy" else r[m]
    middle = lambda v: sorted(v)[math.ceil(len(v) / 2) - 1]
    groups = defaultdict(list)
    for r in rows:
        groups[r.grp].append(r)
    spread = {}
    for name, some in [*groups.items(), (None, rows)]:
        for m in fertility.METRICS:
            mid = middle([value(r, m) for r in some])
            spread[name, m] = mid, middle([abs(value(r, m) - mid) for r in some])
    off = 0
    for r in rows:
        want = []
        for m in fertility.METRICS:
            mid, own = spread[r.grp, m]
            n = len(groups[r.grp])
            unit = max((n * own + fertility.SHRINK * spread[None, m][1]) / (n + fertility.SHRINK), fertility.LEAST[m]) * math.sqrt(1 + fertility.SHORT / r.n_tokens)
            low, high = fertility.WIDTH[m]
            if (low and value(r, m) < mid - low * unit) or (high and value(r, m) > mid + high * unit):
                want.append(m)
        off += list(r.reasons) != want
    assert off == 0 and any(r.reasons for r in rows)


# language


def test_language_ridge_by_another_way(spark):
    d = table(spark, SF2, "documents").filter("text <> ''").limit(120).collect()
    x, y = language_id.presence([r.text for r in d]), np.array([r.lang for r in d])
    marks = x[:24]
    model = language_id.Model(x, y, marks)
    k = language_id.kernel(marks, marks).astype(float)
    u, s, _ = np.linalg.svd(k)
    some = s > 1e-6 * s.max()
    feature = lambda z: np.hstack([language_id.kernel(z, marks).astype(float) @ (u[:, some] / np.sqrt(s[some])) @ u[:, some].T, np.ones((len(z), 1))])
    phi = feature(x)
    target = np.where(y[:, None] == np.unique(y)[None, :], 1.0, -1.0)
    penalty = np.diag([language_id.RIDGE * len(phi)] * (phi.shape[1] - 1) + [0.0])
    # least squares on the stacked system instead of normal equations
    beta = np.linalg.lstsq(np.vstack([phi, np.sqrt(penalty)]), np.vstack([target, np.zeros((phi.shape[1], target.shape[1]))]), rcond=None)[0]
    texts = [r.text for r in table(spark, SF1, "documents").collect() if r.text]
    assert model.scores(texts) == pytest.approx(feature(language_id.presence(texts)) @ beta, abs=5e-3)
    best = model.classes[model.scores(texts).argmax(1)]
    judged = [r for r in language_id.identify(table(spark, SF1, "documents"), model).collect() if r.predicted]
    assert [r.predicted for r in judged] == list(best)


def test_language_sample_keeps_its_bounds(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(language_id, "Model", lambda x, y, marks: seen.update(n=Counter(y.tolist()), marks=len(marks)))
    texts = [(1, "the same text again", "en", "s", 1)] * 1000 + [(i, f"text {i} of many", "en", "s", 1) for i in range(60)] + [(1, "the same text again", "fr", "s", 1)] * 50 + [(5, "x", f"l{i}", "s", 1) for i in range(9)]
    language_id.fit(spark.createDataFrame(texts, DOCS), per_language=20, landmarks=3, languages=2)
    assert seen["n"] == {"en": 20, "fr": 1} and seen["marks"] == 4
