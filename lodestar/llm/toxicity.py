"""Toxicity by a convolutional text classifier trained in numpy.

Lower-cased words are hashed to embeddings (the sum of a word's own and those of its first four and five letters, so
that inflected forms share what they mean); filters over one, two and three words in a row, rectified and max-pooled
over the whole text, feed a logistic output. The first embedding coordinate starts as a word's log odds of
toxic against other training texts, drawn to the overall odds where the word is rare; everything is then trained by Adam. A part of the training texts
calibrates the output (Platt scaling) and gives a threshold for each language. Max pooling over parts of a text and
then over the parts is max pooling over the text, so texts of any length are scored whole in bounded memory.

Fitting uses at most SAMPLE labelled texts (the doc_ids of the least hashes), the one bound here; scoring covers all rows.

Edge cases: a null doc_id is held out; a null or empty text gets the score of pooled zeros; equal texts have equal
scores; without toxic or without other training texts the score is their smoothed share; labels with a null are left
out; a doc_id with several labels has the greatest, one with several texts is fitted on the least of them; label rows
without a document are ignored; extra columns are ignored in rated() and stay as they are in clean(), where a null
language has the threshold of texts without one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common

SAMPLE = 4000
BUCKETS, DIM, WIDTHS = 1 << 15, 12, ((1, 16), (2, 8), (3, 8))
EPOCHS, BATCH, RATE, WORD_RATE, PRIOR = 6, 64, 0.01, 0.001, 10.0
LEAST_STEPS = 240
CUT = 0.7
PART = 100_000  # words scored at a time
WORD = re.compile(r"[^\W_]+")


class Hasher:
    """Rows of three buckets for each word of a text: of the word, its first four and its first five letters."""

    def __init__(self, buckets: int):
        self.buckets, self.known, self.rows = buckets, {}, np.zeros((1024, 3), np.int32)

    def __call__(self, text: str) -> np.ndarray:
        words, known = WORD.findall(text.lower()), self.known
        if len(known) > 150_000:
            known.clear()
        for w in words:
            if w not in known:
                k = known[w] = len(known)
                if k >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[k] = [zlib.crc32(x.encode()) % self.buckets for x in (w, "4" + w[:4], "5" + w[:5])]
        return self.rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]


@dataclass
class Classifier:
    embedding: np.ndarray
    filters: list[np.ndarray]  # each: width * DIM x filters
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter (at least 0) and where it starts (-1: nowhere above 0)."""
        best, at, e = [], [], self.embedding[ids].sum(axis=1)
        for (width, n), w, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            if len(ids) < width:
                best.append(np.zeros(n, np.float32))
                at.append(np.full(n, -1))
                continue
            m = len(ids) - width + 1
            r = sum(e[i : i + m] @ w[i * DIM : (i + 1) * DIM] for i in range(width)) + b
            k = r.argmax(axis=0)
            top = r[k, np.arange(n)]
            best.append(np.maximum(top, 0))
            at.append(np.where(top > 0, k, -1))
        return np.concatenate(best), np.concatenate(at)

    def features(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) <= PART:
            return self.pooled(ids)[0]
        over = max(w for w, _ in WIDTHS) - 1
        return np.max([self.pooled(ids[i : i + PART + over])[0] for i in range(0, len(ids), PART)], axis=0)

    def logit(self, ids: np.ndarray) -> float:
        return float(self.features(ids) @ self.out + self.bias)

    def score(self, ids: np.ndarray) -> float:
        a, b = self.scale
        return float(1 / (1 + np.exp(-np.clip(a * self.logit(ids) + b, -30, 30))))


def fit(texts: list[str], labels: list[int], langs: list[str | None], seed: int = 7) -> Classifier:
    rng = np.random.default_rng(seed)
    hasher = Hasher(BUCKETS)
    y = np.array(labels, np.float32)
    docs = [hasher(t) for t in texts]
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    filters = [rng.normal(0, 0.1, (w * DIM, n)).astype(np.float32) for w, n in WIDTHS]
    biases = [np.zeros(n, np.float32) for _, n in WIDTHS]
    n_filters = sum(n for _, n in WIDTHS)
    share = float((y.sum() + 0.5) / (len(y) + 1))
    model = Classifier(embedding, filters, biases, np.zeros(n_filters, np.float32), float(np.log(share / (1 - share))))
    if y.sum() < 4 or (1 - y).sum() < 4:
        return model
    order = rng.permutation(len(docs))
    held, train = order[: len(docs) // 4], order[len(docs) // 4 :]
    seen = np.zeros((2, BUCKETS))
    for i in train:
        seen[int(y[i]), np.unique(docs[i])] += 1
    odds = (seen[1] + PRIOR * share) / (seen[0] + PRIOR * (1 - share))  # rare words stay near the overall odds
    embedding[:, 0] = np.clip(np.log(odds * (1 - share) / share), -4, 4) / 2
    for k, (w, _) in enumerate(WIDTHS):
        for i in range(w):
            filters[k][i * DIM, :4] = 1.0 / w
        biases[k][:4] = -np.linspace(0.2, 1.5, 4)
    model.out[:] = rng.normal(0, 0.1, n_filters)
    for start in np.cumsum([0, *[n for _, n in WIDTHS]])[:-1]:
        model.out[start : start + 4] = 0.3
    params = [embedding, *filters, *biases, model.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    bias_m = bias_v = 0.0
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    step = 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // (len(train) // BATCH + 1)))):
        for at in range(0, len(train), BATCH):
            grads = [np.zeros_like(p) for p in params[1:]]
            touched: list[tuple[np.ndarray, np.ndarray]] = []
            g_bias, batch = 0.0, rng.permutation(train)[:BATCH] if at == 0 else train[at : at + BATCH]
            for i in batch:
                ids = docs[i]
                f, where = model.pooled(ids)
                p = 1 / (1 + np.exp(-np.clip(f @ model.out + model.bias, -30, 30)))
                d = float((p - y[i]) * weight[i] / len(batch))
                grads[-1] += d * f
                g_bias += d
                back, c = d * model.out, 0
                for k, (w, n) in enumerate(WIDTHS):
                    own = np.flatnonzero(where[c : c + n] >= 0)
                    if len(own):
                        spots = ids[where[c + own][:, None] + np.arange(w)]  # filters x words x 3
                        g = back[c + own]
                        grads[len(WIDTHS) + k][own] += g
                        grads[k][:, own] += (embedding[spots].sum(axis=2).reshape(len(own), -1) * g[:, None]).T
                        touched.append((spots.ravel(), np.repeat((filters[k][:, own].T * g[:, None]).reshape(-1, DIM), 3, axis=0)))
                    c += n
            step += 1
            rows, inverse = np.unique(np.concatenate([t[0] for t in touched]) if touched else np.zeros(0, np.int32), return_inverse=True)
            if touched:
                g_rows = np.zeros((len(rows), DIM), np.float32)
                np.add.at(g_rows, inverse, np.concatenate([t[1] for t in touched]))
                first[0][rows] = 0.9 * first[0][rows] + 0.1 * g_rows
                second[0][rows] = 0.999 * second[0][rows] + 0.001 * g_rows**2
                embedding[rows] -= WORD_RATE * first[0][rows] / (np.sqrt(second[0][rows]) + 1e-4)
            for p_, g_, m_, v_ in zip(params[1:], grads, first[1:], second[1:], strict=True):
                m_ += 0.1 * (g_ - m_)
                v_ += 0.001 * (g_**2 - v_)
                p_ -= RATE * (m_ / (1 - 0.9**step)) / (np.sqrt(v_ / (1 - 0.999**step)) + 1e-6)
            bias_m += 0.1 * (g_bias - bias_m)
            bias_v += 0.001 * (g_bias**2 - bias_v)
            model.bias -= RATE * bias_m / (1 - 0.9**step) / (np.sqrt(bias_v / (1 - 0.999**step)) + 1e-6)
        train = rng.permutation(train)
    z = np.array([model.logit(docs[i]) for i in held])
    model.scale = platt(z, y[held])
    scores = 1 / (1 + np.exp(-np.clip(model.scale[0] * z + model.scale[1], -30, 30)))
    for lang in {langs[i] for i in held}:
        own = np.array([langs[i] == lang for i in held])
        model.thresholds[lang] = threshold(scores[own], y[held][own])
    return model


def platt(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic fit by Newton's method, with smoothed targets."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, c = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(h, x.T @ (p - t))
        c -= np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    return float(max(c[0], 1e-3)), float(c[1])


def threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The best F1 between 0.3 and 0.9 (CUT unless both labels occur), in the middle of the best range."""
    if not 0 < y.sum() < len(y):
        return CUT
    grid = np.linspace(0.3, 0.9, 61)
    f1 = [2 * ((scores >= c) & (y == 1)).sum() / max(1, (scores >= c).sum() + y.sum()) for c in grid]
    best = grid[np.flatnonzero(np.array(f1) == max(f1))]
    return float(np.round(best[np.abs(best - CUT).argmin()], 4))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on at most sample labelled rows whose crc32(doc_id as text) mod 3 is not 1."""
    marks = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).dropna().where(F.crc32(F.col("label_id").cast("string")) % 3 != 1)
    picked = marks.groupBy("label_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    own = common.texts(docs, F.col("lang").cast("string").alias("lang")).join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))  # sample rows
    one = own.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r"), F.min("toxic").alias("toxic"))
    rows = one.select("r.text", "toxic", "r.lang", "doc_id").orderBy("doc_id").toPandas()
    return fit(rows["text"].tolist(), rows["toxic"].tolist(), rows["lang"].tolist())


def scored(docs: DataFrame, model: Classifier, *more: str) -> DataFrame:
    """doc_id, score and the columns in more; only the text is read for the score."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x DIM floats, whatever the input
    own = docs.select("doc_id", "text", *more)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, hasher = shared.value, Hasher(BUCKETS)
        for b in batches:
            yield b.assign(score=[m.score(hasher(t)) if isinstance(t, str) else m.score(np.zeros((0, 3), np.int32)) for t in b["text"]]).drop(columns=["text"])

    fields = [f for f in own.schema.fields if f.name != "text"]
    from pyspark.sql.types import DoubleType, StructField, StructType

    return own.mapInPandas(common.lean(rows), StructType([*fields, StructField("score", DoubleType())]))


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return out.select("doc_id", F.coalesce(common.crc_mod("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns as they are, whose score is under their language's threshold (CUT where none is)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    model = train(docs, labels)
    shared = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, hasher = shared.value, Hasher(BUCKETS)
        for b in batches:
            s = np.array([m.score(hasher(t)) if isinstance(t, str) else m.score(np.zeros((0, 3), np.int32)) for t in b["text"]])
            cut = np.array([m.thresholds.get(x, CUT) for x in b["lang"]])
            yield b[s < cut]

    return docs.mapInPandas(common.lean(rows), docs.schema)
