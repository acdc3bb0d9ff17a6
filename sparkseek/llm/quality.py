"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

1. Random indexing. Words (runs of letters and digits, or of marks; case kept) are hashed to BUCKETS. Every bucket has a
   fixed sparse index vector of +-1; a word's vector is the sum of the index vectors of the words up to WINDOW places
   away, over all occurrences in all documents. The sums are integers, so they depend on no order of work.
2. Pooling. A document is the mean and the spread of its words' vectors (centred, of length 1), the mean likeness of
   neighbouring words' vectors one and LAGS places apart, and the logarithm of its number of words.
3. Network. tanh layer, logistic output, trained with Adam on at most `max_train` labelled rows (those with the smallest
   hash of their id; the bound is a parameter, so training fits the driver). A temperature is then chosen on a part of
   these rows that the training left out.

The vectors (BUCKETS x DIMS) and the network have fixed sizes, whatever the corpus; only they are sent to all tasks.
Labels, language, source and id are no inputs of a score.

Edge cases: null and empty texts pool to zeros and are scored; without labelled rows of both kinds every score is the
share of label 1 (0.5 without any); a null id is never a training row and counts as not held out; labels that contradict
each other for one id count as the larger; repeated rows get equal scores. Only id, text and labels are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import WORDS_AND_MARKS, Words, accumulate, slices, strings

BUCKETS, DIMS, NONZERO, WINDOW = 1 << 14, 32, 4, 2
HIDDEN, EPOCHS, RATE, DECAY = 24, 300, 0.02, 1e-4
MAX_TRAIN = 20_000
LAGS = 2
FEATURES = 2 * DIMS + 1 + LAGS
THRESHOLD = 0.3
FOLDS = 5


def index_vectors(seed: int = 5) -> np.ndarray:
    """BUCKETS + 1 sparse vectors; the last is zero and stands for no word."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((BUCKETS + 1, DIMS), np.int8)
    for i in range(BUCKETS):
        out[i, rng.choice(DIMS, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def _buckets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words = Words(*strings(batch.column(batch.schema.get_field_index("text"))), lower=False, kinds=WORDS_AND_MARKS)
    return (words.hash >> np.uint64(64 - 14)).astype(np.int32), words.first


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIMS: the vectors of all buckets, centred and of length 1 (zero where no word fell)."""
    index = index_vectors()

    def add(matrix: np.ndarray, batch: pa.RecordBatch) -> None:
        bucket, first = _buckets(batch)
        if not len(bucket):
            return
        n = len(first) - 1
        # WINDOW places without a word after every document keep documents apart
        at = np.arange(len(bucket)) + WINDOW * (1 + np.repeat(np.arange(n), np.diff(first)))
        line = np.full(len(bucket) + WINDOW * (n + 1), BUCKETS, np.int32)
        line[at] = bucket
        near = sum(index[line[at + d]].astype(np.int8) for d in range(-WINDOW, WINDOW + 1) if d)
        order = np.argsort(bucket.astype(np.uint16), kind="stable")
        ordered = bucket[order]
        begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        matrix[ordered[begin], :DIMS] += np.add.reduceat(near[order], begin, axis=0, dtype=np.int64)
        matrix[ordered[begin], DIMS] += np.diff(np.append(begin, len(ordered)))

    sums = accumulate(docs, add, BUCKETS, DIMS + 1)
    count = sums[:, DIMS:].astype(float)
    seen = count[:, 0] > 0
    vectors = np.zeros((BUCKETS, DIMS))
    if seen.any():
        mean = sums[seen, :DIMS].sum(0) / count.sum()
        vectors[seen] = sums[seen, :DIMS] / count[seen] - mean
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors /= np.where(size > 0, size, 1)
    return vectors.astype(np.float32)


def pooled(batch: pa.RecordBatch, vectors: np.ndarray) -> np.ndarray:
    """A row of FEATURES features for each document."""
    bucket, first = _buckets(batch)
    n = np.diff(first)
    out = np.zeros((len(n), FEATURES))
    full = np.flatnonzero(n)
    if len(full):
        v = vectors[bucket]
        begin = first[:-1][full]
        mean = np.add.reduceat(v, begin, axis=0, dtype=np.float64) / n[full, None]
        square = np.add.reduceat(v * v, begin, axis=0, dtype=np.float64) / n[full, None]
        out[full, :DIMS], out[full, DIMS: 2 * DIMS] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
        for lag in range(1, LAGS + 1):
            near = np.zeros(len(v))
            near[:-lag] = np.einsum("ij,ij->i", v[:-lag], v[lag:])
            ends = first[1:][full]
            for back in range(1, lag + 1):  # the words of the next document don't count
                near[np.maximum(ends - back, begin)] = 0
            out[full, 2 * DIMS + lag] = np.add.reduceat(near, begin) / n[full]
    out[:, 2 * DIMS] = np.log1p(n)
    return out


@dataclass
class Network:
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
    """Adam on all rows but every fifth, which choose the temperature."""
    n_in = x.shape[1]
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~held])) < 2:
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Network(np.zeros(n_in), np.ones(n_in), np.zeros((n_in, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    rng = np.random.Generator(np.random.PCG64(seed))
    a, b = x[~held], y[~held].astype(float)
    shift, scale = a.mean(0), a.std(0) + 1e-6
    a = (a - shift) / scale
    p = [rng.normal(0, n_in**-0.5, (n_in, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for step in range(1, EPOCHS + 1):
        h = np.tanh(a @ p[0] + p[1])
        err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -500, 500))) - b) / len(b)
        back = err[:, None] * p[2] * (1 - h * h)
        grads = [a.T @ back + DECAY * p[0], back.sum(0), h.T @ err + DECAY * p[2], np.array([err.sum()])]
        for q, g, m_, v_ in zip(p, grads, m, v):
            m_ += 0.1 * (g - m_)
            v_ += 0.001 * (g * g - v_)
            q -= RATE * (m_ / (1 - 0.9**step)) / (np.sqrt(v_ / (1 - 0.999**step)) + 1e-8)
    net = Network(shift, scale, p[0], p[1], p[2], float(p[3][0]))
    if held.any():
        z, t = net.logits(x[held]), y[held]
        loss = lambda k: float(np.logaddexp(0, np.where(t == 1, -z, z) / k).mean())
        net.temperature = float(min(np.geomspace(0.25, 8, 101), key=loss))
    return net


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, Network]:
    """docs: doc_id, text. labels: doc_id, quality."""
    vectors = word_vectors(docs)
    known = labels.where("doc_id is not null and quality is not null").where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # at most max_train rows, so small enough to broadcast
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = pooled(batch, vectors).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    one = rows.mapInArrow(features, "doc_id long, quality int, x binary").groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("row"))  # ids may repeat
    got = sorted((r["doc_id"], r["row"]["quality"], bytes(r["row"]["x"])) for r in one.collect())
    if len(got) > max_train:
        raise RuntimeError("more training rows than max_train")
    x = np.frombuffer(b"".join(r[2] for r in got), "<f4").reshape(len(got), FEATURES).astype(float)
    return vectors, train(x, np.array([r[1] for r in got], int))


def score(docs: DataFrame, vectors: np.ndarray, net: Network, column: str = "score") -> DataFrame:
    """The rows of docs (with a column text) and their score in a column of the given name."""
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*docs.schema.fields]).add(column, DoubleType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = net.score(pooled(batch, vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, column])

    return docs.mapInArrow(work, schema)


def classify(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("quality"))
    scored = score(docs, *fit(docs, known, max_train))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
