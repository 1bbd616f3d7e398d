"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other, and each model sees the chances of the earlier
categories beside the words. A model trained on chances that its predecessors gave for their own
training rows would trust them too much, so those are out-of-fold predictions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, whole_text

#: Labelled documents that the models are fitted on at most, folds, hashed features and those kept.
TRAIN_ROWS, FOLDS, SPACE, KEPT = 8000, 4, 1 << 20, 3000
#: Least documents with a feature, passes, step and penalty.
LEAST_DOCS, PASSES, STEP, PENALTY = 4, 150, 0.5, 2e-4
_CACHE = 300_000
_PARTS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def word_ids(word: bytes) -> tuple[int, ...]:
    """Hashed features of a word: itself and, if it is longer, its first 5 and 7 bytes."""
    own = [zlib.crc32(word)]
    own += [zlib.crc32(word[:k], k) for k in (5, 7) if len(word) > k]
    return tuple(h % SPACE for h in own)


def distinct_words(text: bytes) -> set[bytes]:
    return set(text.lower().translate(_PARTS).split())


@dataclass
class Link:
    """One category's model: weights of the features and of the earlier categories."""

    name: str
    weights: np.ndarray
    earlier: np.ndarray
    bias: float
    threshold: float


def _chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Rows:
    """Which rows have which features; features of fewer than ``LEAST_DOCS`` rows are left out."""

    def __init__(self, ids: Sequence[np.ndarray]):
        self.n = len(ids)
        own = [np.unique(x) for x in ids]
        row = np.repeat(np.arange(self.n), [len(x) for x in own])
        flat = np.concatenate(own) if own else np.zeros(0, np.int64)
        common = np.bincount(flat, minlength=SPACE) >= LEAST_DOCS
        self.names = np.flatnonzero(common)
        self.row, self.col = row[common[flat]], np.searchsorted(self.names, flat[common[flat]])

    def choose(self, y: np.ndarray, most: int, train: np.ndarray) -> np.ndarray:
        """Columns whose presence tells most about the label in the rows marked in ``train``, by the
        score of a two-by-two table."""
        part = train[self.row]
        df = np.bincount(self.col[part], minlength=len(self.names)).astype(float)
        pos = np.bincount(self.col[part], y[self.row[part]], minlength=len(self.names))
        n, rate = train.sum(), y[train].mean()
        score = (pos - df * rate) ** 2 / np.maximum(df * rate * (1 - rate) * (1 - df / n), 1e-9)
        score[df < LEAST_DOCS] = 0
        best = np.argsort(-score, kind="stable")[:most]
        return np.sort(best[score[best] > 6])


def _fit(rows: _Rows, extra: np.ndarray, y: np.ndarray, train: np.ndarray):
    """Weights by column, weights of the extra columns, and the bias, from the rows marked in ``train``."""
    columns = rows.choose(y, KEPT, train)
    place = np.full(len(rows.names) + 1, -1)
    place[columns] = np.arange(len(columns))
    own = train[rows.row] & (place[rows.col] >= 0)
    r, c = (np.cumsum(train) - 1)[rows.row[own]], place[rows.col[own]]
    goal, more, n = y[train], extra[train], int(train.sum())
    w, v = np.zeros(len(columns)), np.zeros(extra.shape[1])
    bias = float(np.log((goal.mean() + 1e-6) / (1 - goal.mean() + 1e-6)))
    seen_w, seen_v, seen_b = np.full(len(w), 1e-8), np.full(len(v), 1e-8), 1e-8
    for _ in range(PASSES):
        error = (_chance(np.bincount(r, w[c], n) + more @ v + bias) - goal) / n
        g_w, g_v, g_b = np.bincount(c, error[r], len(w)) + PENALTY * w, more.T @ error + PENALTY * v, error.sum()
        seen_w, seen_v, seen_b = seen_w + g_w**2, seen_v + g_v**2, seen_b + g_b**2
        w, v, bias = w - STEP * g_w / np.sqrt(seen_w), v - STEP * g_v / np.sqrt(seen_v), bias - STEP * g_b / np.sqrt(seen_b)
    full = np.zeros(len(rows.names))
    full[columns] = w
    return full, v, bias


def fit_chain(ids: Sequence[np.ndarray], labels: Sequence[tuple[str, np.ndarray]]) -> list[Link]:
    """Models of the categories in order from rows of feature ids and their 0/1 labels; each
    threshold is where the out-of-fold predictions score best (F1)."""
    rows = _Rows(ids)
    fold = np.arange(rows.n) % FOLDS
    extra = np.zeros((rows.n, 0))
    chain = []
    for name, y in labels:
        y = y.astype(float)
        if rows.n == 0 or y.min() == y.max():
            rate = float(y.mean()) if rows.n else 0.0
            chain.append(Link(name, np.zeros(SPACE, np.float32), np.zeros(extra.shape[1]), float(np.log((rate + 1e-6) / (1 - rate + 1e-6))), 0.5))
            extra = np.column_stack([extra, np.full(rows.n, rate)])
            continue
        out = np.zeros(rows.n)
        for k in range(FOLDS):
            w, v, b = _fit(rows, extra, y, fold != k)
            out[fold == k] = _chance(np.bincount(rows.row, w[rows.col], rows.n) + extra @ v + b)[fold == k]
        order = np.argsort(-out, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, rows.n + 1) + y.sum())
        f1[:-1][out[order][:-1] == out[order][1:]] = 0  # no cut between equal chances
        best = int(f1.argmax())
        threshold = float((out[order][best] + (out[order][best + 1] if best + 1 < rows.n else 0.0)) / 2)
        w, v, b = _fit(rows, extra, y, np.ones(rows.n, bool))
        weights = np.zeros(SPACE, np.float32)
        weights[rows.names] = w
        chain.append(Link(name, weights, v, b, threshold))
        extra = np.column_stack([extra, out])
    return chain


class _Words(dict):
    """The weights of a word in each model, None where all are zero."""

    def __init__(self, chain: Sequence[Link]):
        super().__init__()
        self.weights = np.stack([link.weights for link in chain], 1)

    def __missing__(self, word: bytes):
        if len(self) >= _CACHE:
            self.clear()
        own = self.weights[list(word_ids(word))].sum(0)
        value = self[word] = tuple(own.tolist()) if own.any() else None
        return value


def predict(chain: Sequence[Link], texts: Sequence[bytes], words: _Words | None = None) -> np.ndarray:
    """(texts, categories): each category's chance, given the earlier ones'."""
    words = words if words is not None else _Words(chain)
    sums = np.zeros((len(texts), len(chain)))
    for n, text in enumerate(texts):
        found = list(filter(None, map(words.__getitem__, distinct_words(text))))
        if found:
            sums[n] = np.sum(found, axis=0)
    out = np.zeros_like(sums)
    for k, link in enumerate(chain):
        out[:, k] = _chance(sums[:, k] + out[:, :k] @ link.earlier + link.bias)
    return out


def training_rows(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, Column]], most: int = TRAIN_ROWS):
    """Feature ids and labels of up to ``most`` labelled documents, those of the smallest hash of
    their id, with their whole texts; rows with a null label or text are left out. Rows that repeat id and
    text are one, of an id with very many texts those of the smallest hashes are taken, and no more
    than ``most`` rows are ever featurised or brought to the driver."""
    names = [f"y{k}" for k in range(len(categories))]
    marked = labels.select("doc_id", *(c.cast("int").alias(y) for y, (_, c) in zip(names, categories))).na.drop()
    chosen = marked.groupBy("doc_id").agg(*(F.max(y).alias(y) for y in names)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    same = F.xxhash64("text").alias("h")
    keys = own.select("doc_id", same).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(most)
    rows = own.withColumn("h", same).join(F.broadcast(keys), ["doc_id", "h"]).groupBy("doc_id", "h", *names).agg(F.first(F.col("text").cast("binary")).alias("data"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [sorted(i for w in distinct_words(t.as_py()) for i in word_ids(w)) for t in batch["data"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([np.array(x, "<i4").tobytes() for x in ids], pa.binary()), *(batch[y] for y in names)], ["doc_id", "ids", *names])

    got = rows.mapInArrow(featurise, "doc_id long, ids binary, " + ", ".join(f"{y} int" for y in names)).collect()
    got.sort(key=lambda r: (r["doc_id"], r["ids"]))
    return [np.frombuffer(r["ids"], "<i4").astype(np.int64) for r in got], [(name, np.array([r[y] for r in got])) for y, (name, _) in zip(names, categories)]


def classify(docs: DataFrame, chain: Sequence[Link]) -> DataFrame:
    """doc_id, then a chance and a decision for each category, of every whole text.

    A null or empty text has no words: its chances are the models' own. Rows stand each for
    itself, repeated and null ids too; an empty table gives none. A very long text counts by its
    distinct words. A chance of just the threshold decides for the category. Only doc_id and text
    are read, so further columns cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(list(chain))
    names = ["doc_id", *(x for link in chain for x in (f"{link.name}_score", link.name))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                chances = predict(shared.value, part["data"].to_pylist(), words)
                columns = [x for k, link in enumerate(shared.value) for x in (pa.array(chances[:, k]), pa.array(chances[:, k] >= link.threshold))]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], names)

    rows = spread(docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().cast("binary").alias("data")))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{link.name}_score double, {link.name} boolean" for link in chain))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The chain low_quality, toxic learned from ``labels`` and applied to all documents."""
    categories = [("low_quality", 1 - F.col("quality")), ("toxic", F.col("toxic"))]
    return classify(docs, fit_chain(*training_rows(docs, labels, categories)))


def op8_chain_toxicity(spark, sf_dir: str) -> DataFrame:
    """``toxicity`` of all ``documents`` with the ``labels``; ``classify`` states every case."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
