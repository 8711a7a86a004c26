"""Language identification by blended-spectrum string kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, table

#: n-grams of bytes of the lower-cased text, of all these lengths at once, hashed into FEATURES presence bits.
LENGTHS = (1, 2, 3)
FEATURES = 1 << 14
#: Bound of the training sample: labelled texts of each language; the first of them are the landmarks.
PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 32
#: Bound of the languages that are told apart.
LANGUAGES = 200
RIDGE = 1e-2
#: Texts scored in one matrix product, and the bytes that are hashed at once.
BATCH = 256
SEED = 20


def presence(texts: list[str]) -> np.ndarray:
    """A row per text: 1.0 where the text has an n-gram of that hash. Texts are read whole; n-grams never cross texts."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    flat = out.reshape(-1)
    coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    lo = 0
    while lo < len(coded):
        hi, size = lo, 0
        while hi < len(coded) and (hi == lo or size + len(coded[hi]) <= 1 << 20):
            size += len(coded[hi])
            hi += 1
        data = np.frombuffer(b"".join(coded[lo:hi]), np.uint8)
        sizes = np.array([len(c) for c in coded[lo:hi]])
        base = np.repeat(np.arange(lo, hi, dtype=np.int64) * FEATURES, sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes from here to the text's end
        code = data.astype(np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            if n > 1:
                code = (code[:-1] << np.uint32(8)) | data[n - 1 :] if len(code) > 1 else code[:0]
            if n not in LENGTHS or not len(code):
                continue
            # multiplicative hash of the code and its length
            bit = ((code * np.uint32(2654435761) + np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) >> np.uint32(18)).astype(np.int64)
            whole = left[: len(code)] >= n
            flat[(base[: len(code)] + bit)[whole]] = 1.0
        lo = hi
    return out


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Common n-grams over the geometric mean of both numbers; 0 for texts without any."""
    common = x @ landmarks.T
    return common / np.sqrt(np.maximum(1.0, np.outer(x.sum(1), landmarks.sum(1))))


class Model:
    """One-versus-rest kernel ridge regression in the span of the landmarks."""

    def __init__(self, x: np.ndarray, y: np.ndarray, landmarks: np.ndarray, ridge: float = RIDGE):
        self.landmarks = landmarks
        self.classes = np.unique(y)
        k = kernel(landmarks, landmarks).astype(np.float64)
        values, vectors = np.linalg.eigh(k)
        kept = values > 1e-6 * values.max()
        root = vectors[:, kept] / np.sqrt(values[kept])  # Nyström: phi(x) = k(x, landmarks) @ root
        phi = kernel(x, landmarks).astype(np.float64) @ root
        phi1 = np.hstack([phi, np.ones((len(phi), 1))])
        target = np.where(y[:, None] == self.classes[None, :], 1.0, -1.0)
        gram = phi1.T @ phi1
        gram[np.arange(len(gram) - 1), np.arange(len(gram) - 1)] += ridge * len(phi)
        beta = np.linalg.solve(gram, phi1.T @ target)
        self.weights = (root @ beta[:-1]).astype(np.float32)
        self.bias = beta[-1].astype(np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        return kernel(presence(texts), self.landmarks) @ self.weights + self.bias


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE, seed: int = SEED, languages: int = LANGUAGES) -> Model | None:
    """Fit on at most per_language whole texts of each of the `languages` commonest languages, chosen by a hash of doc_id and text.

    Rows of equal language, doc_id and text count once.
    """
    labelled = docs.filter((F.coalesce("text", F.lit("")) != "") & (F.coalesce("lang", F.lit("")) != ""))
    labelled = labelled.select("lang", "text", F.xxhash64(F.lit(seed), "doc_id").alias("h"), F.xxhash64("text").alias("t"))
    common = labelled.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(languages).select("lang")
    # one small row for each text goes to its language; only the first of each task do
    order = Window.partitionBy("lang").orderBy("h", "t")
    keys = labelled.select("lang", "h", "t").join(F.broadcast(common), "lang").withColumn("nth", F.dense_rank().over(order)).filter(F.col("nth") <= per_language).distinct()
    keys = materialize(keys, "language-keys")  # at most languages * per_language rows
    chosen = labelled.join(F.broadcast(keys), ["lang", "h", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                bits = np.packbits(presence(part.column(1).to_pylist()).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b.tobytes() for b in bits], pa.binary()), part.column(2)], names=["lang", "bits", "nth"])

    bits = chosen.select("lang", "text", "nth").mapInArrow(run, "lang string, bits binary, nth int")
    rows = bits.groupBy("lang", "nth").agg(F.first("bits").alias("bits")).collect()
    rows.sort(key=lambda r: (r.lang, r.nth))
    if not rows:
        return None
    x = np.unpackbits(np.frombuffer(b"".join(r.bits for r in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
    y = np.array([r.lang for r in rows])
    return Model(x, y, x[np.array([r.nth for r in rows]) <= landmarks])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang, predicted, score, margin, agrees, keep) for every row of docs.

    Texts are read whole. predicted has the highest of the one-versus-rest scores (the first in
    alphabetical order on a tie), margin is its lead over the second, agrees tells whether lang says the same, keep
    whether the row's language is certain or as labelled (margin >= MARGIN, or agrees). Null and empty texts have null predicted, score, margin
    and agrees, and are not kept; without a labelled text (model None) so have all rows. A null lang
    has null agrees. Rows are judged one by one: null or repeated doc_ids make no difference. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                texts = part.column(2).to_pylist()
                some = [i for i, t in enumerate(texts) if t]
                predicted, score, margin = [None] * len(texts), [None] * len(texts), [None] * len(texts)
                if model is not None and some:
                    s = model.scores([texts[i] for i in some])
                    best = s.argmax(1)
                    top = np.sort(s, axis=1)
                    lead = top[:, -1] - top[:, -2] if s.shape[1] > 1 else top[:, -1]
                    for i, b, v, m in zip(some, best, top[:, -1], lead):
                        predicted[i], score[i], margin[i] = str(model.classes[b]), round(float(v), 4), round(float(m), 4)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(predicted, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())],
                    names=["doc_id", "lang", "predicted", "score", "margin"],
                )

    out = docs.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(run, "doc_id long, lang string, predicted string, score double, margin double")
    agrees = F.col("predicted") == F.col("lang")
    return out.withColumn("agrees", agrees).withColumn("keep", F.coalesce((F.col("margin") >= MARGIN) | agrees, F.lit(False)))


#: Lead of the best score over the second from which on a prediction counts without a matching label.
MARGIN = 0.2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
