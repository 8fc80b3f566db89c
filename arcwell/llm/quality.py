"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated by temperature.

Words are lower-cased and hashed into `buckets`; a word in capitals and a word that
repeats the one before also yield a marker, as do other characters one by one.
Every bucket has a fixed sparse ternary index vector.  A bucket's context vector is
the sum of the index vectors of its neighbours up to `window` away over the whole
corpus: each task adds up its documents in one table of integers, and the tables
are summed by bucket (buckets x tasks rows, whatever the corpus).  The vectors are
centred and scaled to length 1.

A document is the mean of its words' vectors with a few shares of its markers.  A
network of one hidden layer is trained by numpy on at most `sample` labelled
documents, those with the smallest hash of doc_id; their features, not texts, come
to the driver.  A part of them is kept out of the training and sets the
temperature that divides the network's logit.  Scoring is a narrow pass.

Labels are read only where crc32(doc_id as text) mod `folds` is not 0; neither
labels nor lang, source or doc_id are inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_|\n")
_CACHE = 100_000


@dataclass(frozen=True)
class Space:
    """Shape of the word space; index vectors follow from the seed alone."""

    buckets: int = 4096
    dims: int = 48
    nonzero: int = 4
    window: int = 2
    seed: int = 7
    caps: int = 0
    again: int = 1
    _found: dict = field(default_factory=dict, compare=False, repr=False)

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and signs of the ternary index vectors, buckets x nonzero each."""
        rng = np.random.default_rng(self.seed)
        return rng.integers(0, self.dims, (self.buckets, self.nonzero)), rng.choice([-1, 1], (self.buckets, self.nonzero))

    def tokens(self, text: str | None) -> np.ndarray:
        """Bucket numbers of a text's words and markers in order."""
        words = _WORD.findall(text or "")
        if not words:
            return np.zeros(0, np.int64)
        cache = self._found
        if len(cache) > _CACHE:
            cache.clear()
        codes = np.fromiter([cache[w] if w in cache else cache.setdefault(w, self._code(w)) for w in words], np.int64, len(words))
        bucket, caps = codes >> 1, codes & 1 == 1
        rows = np.full((len(words), 3), -1)
        rows[1:, 0] = np.where((bucket[1:] == bucket[:-1]), self.again, -1)
        rows[:, 1] = np.where(caps, self.caps, -1)
        rows[:, 2] = bucket
        flat = rows.ravel()
        return flat[flat >= 0]

    def _code(self, word: str) -> int:
        bucket = 2 + zlib.crc32(word.lower().encode()) % (self.buckets - 2)
        return bucket << 1 | (len(word) > 1 and word.isupper())


def _contexts(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    """One table of sums for the task: a row for each bucket met."""
    at, sign = space.index()
    sums = np.zeros((space.buckets, space.dims), np.int64)
    met = np.zeros(space.buckets, bool)

    def add(tokens: np.ndarray) -> None:
        met[tokens] = True
        for step in range(1, space.window + 1):
            left, right = tokens[:-step], tokens[step:]
            for word, near in ((left, right), (right, left)):
                cells = (word[:, None] * space.dims + at[near]).ravel()
                sums.ravel()[:] += np.bincount(cells, weights=sign[near].ravel(), minlength=sums.size).astype(np.int64)

    held, n = [], 0
    # windows don't reach over documents: gaps of `window` between them go to a bucket of no use, the last one
    gap = np.full(space.window, space.buckets - 1)
    for batch in batches:
        for text in batch.column(0):
            tokens = space.tokens(text.as_py())
            if len(tokens):
                held += [tokens, gap]
                n += len(tokens)
            if n > 1 << 17:
                add(np.concatenate(held))
                held, n = [], 0
    if held:
        add(np.concatenate(held))
    met[space.buckets - 1] = False
    rows = np.nonzero(met)[0]
    if len(rows):
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *(pa.array(sums[rows, k]) for k in range(space.dims))], ["bucket", *(f"d{k}" for k in range(space.dims))])


def word_vectors(docs: DataFrame, space: Space) -> np.ndarray:
    """buckets x dims context vectors over all texts, centred, of length 1 or 0."""
    names = [f"d{k}" for k in range(space.dims)]
    parts = docs.select("text").mapInArrow(lambda b: _contexts(b, space), "bucket int, " + ", ".join(f"{n} long" for n in names))
    table = parts.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    found = np.zeros((space.buckets, space.dims))
    if len(table):
        found[table["bucket"].to_numpy()] = table[names].to_numpy(float)
        found /= np.linalg.norm(found, axis=1, keepdims=True) + 1e-12
        found[table["bucket"].to_numpy()] -= found[table["bucket"].to_numpy()].mean(axis=0)
        found /= np.linalg.norm(found, axis=1, keepdims=True) + 1e-12
    return found


def pooled(text: str | None, space: Space, vectors: np.ndarray) -> np.ndarray:
    """A document's features: mean vector, shares of the two markers, of different words, and its length's logarithm."""
    tokens = space.tokens(text)
    n = len(tokens)
    counts = np.bincount(tokens, minlength=space.buckets)
    some = np.nonzero(counts)[0]
    share = counts[some] / max(n, 1)
    mean = share @ vectors[some]
    return np.concatenate([mean, [counts[space.caps] / max(n, 1), counts[space.again] / max(n, 1), len(some) / max(n, 1), np.log1p(n) / 10]])


@dataclass
class Network:
    """Input standardised, tanh hidden layer, logistic output with a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 150, rate: float = 3e-3, decay: float = 1e-3, seed: int = 11) -> Network:
    """Adam on the log loss over mini-batches; every fifth row sets the temperature only.

    Without rows of both labels the network is constant at their smoothed share.
    """
    d = x.shape[1]
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    aside = np.arange(len(y)) % 5 == 4
    if len(set(y[aside].tolist())) < 2:
        aside[:] = False
    xt, yt = x[~aside], y[~aside]
    net = Network(xt.mean(0), xt.std(0) + 1e-6, rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z = (xt - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    moment, square, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(yt))
        for at in range(0, len(order), 128):
            zb, yb = z[order[at : at + 128]], yt[order[at : at + 128]]
            h = np.tanh(zb @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            out = (p - yb) / len(yb)
            back = np.outer(out, params[2]) * (1 - h * h)
            grads = [zb.T @ back + decay * params[0], back.sum(0), h.T @ out + decay * params[2], np.array([out.sum()])]
            t += 1
            for k, g in enumerate(grads):
                moment[k] += 0.1 * (g - moment[k])
                square[k] += 0.001 * (g * g - square[k])
                params[k] -= rate * (moment[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if aside.any():
        logit, label = net.logit(x[aside]), y[aside]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
        loss = [np.logaddexp(0, np.where(label == 1, -logit, logit) / k).mean() for k in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def in_fold(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves 0; a null id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, space: Space | None = None, sample: int = 20_000, folds: int = 5) -> tuple[Space, np.ndarray, Network]:
    """Word vectors from all docs and a network from at most `sample` labelled rows outside fold 0.

    Labels that are null don't count; of several labels of one doc_id the smallest does.
    """
    space = space or Space()
    vectors = word_vectors(docs, space)
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), folds)).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [pooled(t.as_py(), space, vectors).tolist() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["id", "quality", "x"])

    # at most `sample` ids of 12 bytes: a proven bound
    picked = docs.select(F.col("doc_id").alias("_doc"), "text").join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select(F.col("_id").cast("long"), F.col("_quality").cast("int"), "text")
    rows = picked.mapInArrow(run, "id long, quality int, x array<double>").orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, space.dims + 4)
    return space, vectors, train(x, rows["quality"].to_numpy(float))


def score(docs: DataFrame, model: tuple[Space, np.ndarray, Network], column: str = "score") -> DataFrame:
    """docs with the probability of label 1; null texts are scored as empty ones."""
    space, vectors, net = model
    vectors = vectors.astype(np.float32)

    @F.pandas_udf("double")
    def run(texts):
        import pandas as pd

        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(net.probability(np.stack([pooled(t, space, vectors) for t in texts])))

    return docs.withColumn(column, run(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted, 1 if score >= threshold, else 0."""
    return score(docs, fit(docs, labels)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return classify(rows, labels).select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", "predicted")
