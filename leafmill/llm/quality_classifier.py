"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import table, text_batches

BITS = 18
#: Bound of the training sample: labelled documents, chosen by a hash of doc_id; texts are read whole.
TRAIN_ROWS = 20_000
EPOCHS = 40
RATE = 0.05
L2 = 1e-3
SEED = 40
#: Features of fewer training texts than this get no weight: those that one text alone has would only be learnt by heart.
MIN_TEXTS = 5
GRADES = 3
#: A document is selected if P(grade >= TAIL_GRADE) is at least TAIL.
TAIL_GRADE = 2
TAIL = 0.7
#: Words that one worker remembers with their features; beyond it the memory starts anew.
REMEMBERED = 1_000_000
CHUNK = 500


def grade() -> Column:
    """The ratings as grades: 0 toxic, 1 of low quality, 2 good. Null if neither rating says which."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)


class Features:
    """Hashed features of a text's words between white space: the lower-cased letters, and the shape (case and marks around)."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}
        self.letters = re.compile(r"[^\W\d_]+")

    def of(self, word: str) -> tuple[int, int]:
        bare = "".join(self.letters.findall(word))
        if bare.isupper() and len(bare) > 1:
            case = "A"
        elif bare[:1].isupper():
            case = "Aa"
        else:
            case = "a" if bare else "0"
        marks = "".join(sorted({c for c in word if not c.isalnum()}))
        return _hash("w" + bare.lower()), _hash("s" + case + marks + str(min(len(bare), 12) // 4))

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature ids, values and offsets. A text's words count by presence, its shapes by their share of its words."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, ids, values, ends = self.known, [], [], []
        for text in texts:
            words = text.split()
            counts: dict[str, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            shapes: dict[int, int] = {}
            bare = set()
            for w, c in counts.items():
                pair = known.get(w)
                if pair is None:
                    pair = known[w] = self.of(w)
                bare.add(pair[0])
                shapes[pair[1]] = shapes.get(pair[1], 0) + c
            ids += bare
            ids += shapes
            values += [WORD] * len(bare)
            values += [SHAPE * c / len(words) for c in shapes.values()]
            ends.append(len(ids))
        return np.array(ids, np.int64), np.array(values, np.float32), np.array([0, *ends], np.int64)


#: Scale of the two kinds of features.
WORD, SHAPE = 2.0, 32.0


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """P(grade <= k) = sigmoid(theta_k - w.x), theta_0 < theta_1 < ...: one set of weights for all grades."""

    def __init__(self, weights: np.ndarray, theta: np.ndarray):
        self.weights, self.theta = weights, theta

    def latent(self, ids: np.ndarray, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0.0], np.cumsum(self.weights[ids].astype(np.float64) * values)])
        return running[ends[1:]] - running[ends[:-1]]

    def probabilities(self, latent: np.ndarray) -> np.ndarray:
        below = np.hstack([np.zeros((len(latent), 1)), sigmoid(self.theta[None, :] - latent[:, None]), np.ones((len(latent), 1))])
        return np.diff(below, axis=1)


def train(ids: np.ndarray, values: np.ndarray, ends: np.ndarray, y: np.ndarray, grades: int = GRADES, seed: int = SEED) -> Model:
    """Maximum likelihood by Adam over mini-batches, with L2; thresholds as a first value and log steps, so that they stay in order."""
    rng = np.random.default_rng(seed)
    n = len(y)
    common = np.bincount(ids, minlength=1 << BITS)[ids] >= min(MIN_TEXTS, n)
    ids, values, ends = ids[common], values[common], np.concatenate([[0], np.cumsum(common)])[ends]
    used, ids = np.unique(ids, return_inverse=True)
    w = np.zeros(len(used))
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros(len(w) + len(raw)), np.zeros(len(w) + len(raw))
    size, step = max(64, min(1024, n // 20)), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        rate = RATE * (1 - epoch / EPOCHS) + 1e-3
        for lo in range(0, n, size):
            batch = order[lo : lo + size]
            a, b = ends[batch], ends[batch + 1]
            at = np.arange((b - a).sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a)
            owner = np.repeat(np.arange(len(batch)), b - a)
            latent = np.bincount(owner, weights=w[ids[at]] * values[at], minlength=len(batch))
            theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
            padded = np.concatenate([[-np.inf], theta, [np.inf]])
            hi, lo_ = sigmoid(padded[y[batch] + 1] - latent), sigmoid(padded[y[batch]] - latent)
            hi, lo_ = np.where(y[batch] == grades - 1, 1.0, hi), np.where(y[batch] == 0, 0.0, lo_)
            p = np.maximum(hi - lo_, 1e-9)
            dh, dl = hi * (1 - hi) / p, lo_ * (1 - lo_) / p
            g_latent = (dh - dl) / len(batch)  # of the negative log-likelihood
            g_w = np.bincount(ids[at], weights=g_latent[owner] * values[at], minlength=len(w)) + L2 * w
            g_theta = np.zeros(grades - 1)
            np.add.at(g_theta, np.minimum(y[batch], grades - 2), np.where(y[batch] < grades - 1, -dh, 0.0) / len(batch))
            np.add.at(g_theta, np.maximum(y[batch] - 1, 0), np.where(y[batch] > 0, dl, 0.0) / len(batch))
            tail = np.cumsum(g_theta[::-1])[::-1]
            g = np.concatenate([g_w, tail[:1], tail[1:] * np.exp(raw[1:])])
            step += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w -= move[: len(w)]
            raw -= move[len(w) :]
    full = np.zeros(1 << BITS, np.float32)
    full[used] = w
    return Model(full, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])))


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """ids, values, offsets and grades of the training rows. Texts are hashed in the cluster; the driver gets feature ids.

    Rated rows without a text, and ratings without a document, are left out. A doc_id rated more than once counts with its lowest grade,
    one of several texts with that of the least hash: no more than `rows` in all, in the order of doc_id.
    """
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade().alias("grade")).filter("grade is not null and doc_id is not null")
    rated = rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = rated.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
    some = docs.select(F.col("doc_id").cast("long"), "text").filter(F.coalesce("text", F.lit("")) != "").join(F.broadcast(chosen), "doc_id")  # at most `rows` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                ids, values, ends = features.rows(part.column(1).to_pylist())
                cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), cut(ids.astype(np.int32)), cut(values)], names=["doc_id", "grade", "th", "ids", "values"])

    rows_ = some.select("doc_id", "text", "grade", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, grade int, th long, ids binary, values binary")
    one = rows_.groupBy("doc_id").agg(F.min(F.struct("th", "grade", "ids", "values")).alias("r"))
    got = one.select("doc_id", "r.grade", "r.ids", "r.values").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return None
    blobs = got.column("ids").to_pylist()
    ids = np.frombuffer(b"".join(blobs), np.int32).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in blobs])])
    return ids, np.frombuffer(b"".join(got.column("values").to_pylist()), np.float32), ends, got.column("grade").to_numpy().astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    got = sample(docs, labels, rows)
    return train(*got) if got is not None else None


def classify(docs: DataFrame, model: Model | None, tail_grade: int = TAIL_GRADE, tail: float = TAIL) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, keep) for every row of docs.

    tail_probability is P(grade >= tail_grade), keep whether it is at least `tail`. Null and empty texts (and
    all rows if nothing was rated: model None) have null scores and are not kept. Rows are judged one by one, whole
    texts: null and repeated doc_ids make no difference. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = shared.value, Features()
        for batch, texts in text_batches(batches):
            for lo in range(0, len(texts), CHUNK):
                part = texts[lo : lo + CHUNK]
                none = pa.array(np.array([not t for t in part] if model is not None else [True] * len(part)), pa.bool_()).to_numpy(zero_copy_only=False)
                if model is None:
                    expected = above = np.zeros(len(part))
                else:
                    p = model.probabilities(model.latent(*features.rows([t or "" for t in part])))
                    expected, above = p @ np.arange(p.shape[1]), p[:, tail_grade:].sum(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, CHUNK), pa.array(expected.round(6), mask=none), pa.array(above.round(6), mask=none), pa.array((above >= tail) & ~none)],
                    names=["doc_id", "expected_grade", "tail_probability", "keep"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, keep boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
