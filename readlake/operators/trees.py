"""Forests of regression trees that are grown over tables, level by level.

A feature is cut into at most ``BINS`` bins, and rows of equal bins are one row with their number, and the sum
and sum of squares of their labels: no split can part them. That table is all that is kept, a byte a feature.
A level of all trees is one pass over it: tasks add up the weight and label sum by node, feature and bin,
these sums meet by tree, and the best split of each node comes to the driver. Which node a row is in and how
often a tree has drawn it are worked out again in each pass, so nothing is held for a row and a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.scratch import saved

#: Bins of a feature, quantiles that they are made from, and how exact these are.
BINS, QUANTILES, EXACT = 32, 128, 2000
#: Rows that a task works on at once, rows of the table in a piece and for a task, and nodes that one pass looks for splits of.
CHUNK, PIECE, TASK, NODES = 1 << 18, 1_000_000, 8_000_000, 1 << 16
#: Up to this many equal rows their draws follow the Poisson law by a table, beyond by the normal one.
TABLED = 50


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that look random for each of these (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(h: np.ndarray, *numbers: int) -> np.ndarray:
    """Numbers in (0, 1) by hash and numbers."""
    salt = np.zeros(1, np.uint64)
    for n in numbers:
        salt = _mixed(salt ^ np.uint64(n % (1 << 64)))
    return ((_mixed(h ^ salt) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _law() -> tuple[np.ndarray, np.ndarray]:
    """Chances of at most 0, 1, ... for each mean up to ``TABLED``, plus the mean, one after the other, and where each begins."""
    parts, starts = [], [0, 0]
    for n in range(1, TABLED + 1):
        most = int(n + 12 * math.sqrt(n) + 12)
        k = np.arange(most)
        logs = k * math.log(n) - n - np.array([math.lgamma(i + 1) for i in k])
        parts.append(n + np.minimum(np.cumsum(np.exp(logs)), 1 - 1e-12))
        starts.append(starts[-1] + most)
    return np.concatenate(parts), np.array(starts[:-1])


_CHANCES, _STARTS = _law()
_ONE = _CHANCES[: _STARTS[2]] - 1


def drawn(h: np.ndarray, n: np.ndarray, mean: np.ndarray, spread: np.ndarray, seed: int, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """What a tree draws of rows that stand for ``n`` equal ones each: how many (Poisson, as each is drawn with mean
    1) and the sum of their labels, which vary by ``spread`` (the variance) around ``mean``."""
    u = _uniform(h, seed, tree)
    count = np.searchsorted(_ONE, u, side="left").astype(np.float64)
    more = np.flatnonzero(n > 1)
    small = np.minimum(n[more], TABLED).astype(np.int64)
    count[more] = np.searchsorted(_CHANCES, small + u[more], side="left") - _STARTS[small]
    normal = lambda at, k: np.sqrt(-2 * np.log(_uniform(h[at], seed, tree, k))) * np.cos(2 * np.pi * _uniform(h[at], seed, tree, k + 1))
    many = more[n[more] > TABLED]
    if len(many):
        count[many] = np.maximum(0, np.round(n[many] + np.sqrt(n[many]) * normal(many, 1)))
    total = count * mean
    wide = np.flatnonzero((spread > 0) & (count > 0))
    if len(wide):
        total[wide] += np.sqrt(count[wide] * spread[wide]) * normal(wide, 3)
    return count, total


def binned(values: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of each value, a row for each row: how many cuts are below it."""
    out = np.empty((len(values[0]), len(cuts)), np.uint8)
    for k, (x, cut) in enumerate(zip(values, cuts)):
        out[:, k] = np.searchsorted(cut, x, side="left")
    return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of bins, and which of them each row is."""
    keys = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1]))).ravel()
    found, place = np.unique(keys, return_inverse=True)
    return found.view(np.uint8).reshape(-1, x.shape[1]), place


def _bytes(keys: pa.Array, width: int) -> np.ndarray:
    """Rows of bins of a column of them."""
    first = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset]
    return np.frombuffer(keys.buffers()[2], np.uint8)[first : first + len(keys) * width].reshape(-1, width)


def cuts_of(rows: DataFrame, columns: Sequence[str]) -> tuple[list[np.ndarray], int]:
    """Where the features are cut, by their quantiles over all rows, and the number of rows. A value that very
    many rows have is one cut, so the others keep theirs."""
    at = F.array(*(F.lit((k + 1) / (QUANTILES + 1)) for k in range(QUANTILES)))
    found = rows.agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(F.col(c).cast("double"), at, F.lit(EXACT)).alias(f"q{k}") for k, c in enumerate(columns)), *(F.max(F.col(c).cast("double")).alias(f"m{k}") for k, c in enumerate(columns))).first()
    out = []
    for k in range(len(columns)):
        own = np.unique(np.array(found[f"q{k}"] or [], np.float64))
        own = own[own < (found[f"m{k}"] if len(own) else 0)]  # nothing is above the largest value
        if len(own) > BINS - 1:
            own = own[np.round(np.linspace(0, len(own) - 1, BINS - 1)).astype(int)]
        out.append(own)
    return out, found["n"]


def table_of(rows: DataFrame, columns: Sequence[str], sums: Sequence[str], cuts: Sequence[np.ndarray], n: int) -> DataFrame:
    """The saved table of a learner: key (the bins), h (its hash) and the ``sums`` of the rows of those bins. Rows
    are added up where they lie first."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            x = binned([chunk.column(c).to_numpy() for c in columns], cuts)
            found, place = _distinct(x)
            own = [np.bincount(place, chunk.column(c).to_numpy(), len(found)) for c in sums]
            ends = np.arange(len(found) + 1, dtype=np.int32) * x.shape[1]
            key = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(found.tobytes())])
            yield pa.RecordBatch.from_arrays([key, *(pa.array(v) for v in own)], ["key", *sums])

    pieces = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // PIECE))
    made = rows.select(*(F.col(c).cast("double").alias(c) for c in (*columns, *sums))).mapInArrow(added, ", ".join(["key binary", *(f"`{c}` double" for c in sums)]))
    met = made.repartition(pieces, "key").groupBy("key").agg(*(F.sum(c).alias(c) for c in sums))
    return saved(met.select("key", F.xxhash64("key").alias("h"), *sums))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they have ``CHUNK`` rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


@dataclass
class Forest:
    """Grown trees in flat arrays: a leaf is its own left child and has a bin that nothing is above. ``groups`` trees
    after one another make a prediction each, ``prediction`` if there is one, or else ``_bag_0`` and so on."""

    columns: tuple[str, ...]
    cuts: list
    root: np.ndarray
    left: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    depth: int
    importances: np.ndarray
    groups: int = 1
    only: int | None = None

    def predicted(self, x: np.ndarray) -> np.ndarray:
        """Predictions of rows of bins, a column a group."""
        flat, at = x.ravel(), np.arange(len(x)) * x.shape[1]
        each = len(self.root) // self.groups
        wanted = range(self.groups) if self.only is None else [self.only]
        out = np.zeros((len(x), len(wanted)))
        for k, group in enumerate(wanted):
            for t in range(group * each, (group + 1) * each):
                out[:, k] += self.value[_walked(flat, at, self.root[t], self.depth, self.left, self.feature, self.bin)]
        return out / each

    def _rows(self, values: pd.DataFrame) -> np.ndarray:
        found, place = _distinct(binned([values[c].to_numpy(np.float64) for c in values.columns], self.cuts))
        return self.predicted(found)[place]

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with ``prediction``, the mean of all trees, or of those of the ``only`` group."""
        return rows.withColumn("prediction", F.pandas_udf(lambda v: pd.Series(self._rows(v).mean(axis=1)), "double")(self._features()))

    def each(self, rows: DataFrame) -> DataFrame:
        """The rows with the prediction of each group, all made at once."""
        names = [f"_bag_{k}" for k in range(self.groups)]
        made = F.pandas_udf(lambda v: pd.DataFrame(self._rows(v), columns=names), ", ".join(f"{c} double" for c in names))
        return rows.withColumn("_bags", made(self._features())).select(*rows.columns, "_bags.*")

    def _features(self):
        return F.struct(*(F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(self.columns)))


def _walked(flat: np.ndarray, at: np.ndarray, root: int, steps: int, left: np.ndarray, feature: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The nodes of rows after so many steps down a tree; ``at`` is where a row's bins begin."""
    node = np.full(len(at), root, np.int32)
    for _ in range(steps):
        node = left[node] + (flat[at + feature[node]] > limit[node])
    return node


def grown(rows: DataFrame, columns: Sequence[str], sums: Sequence[str], *, trees: int, depth: int, min_leaf: float = 1, seed: int = 42, groups: int = 0) -> Forest:
    """A forest whose nodes see a root's share of the features. ``sums`` are columns to add up: the number of rows,
    the label and its square, of which each tree draws its own; or with ``groups``, for each of these how often it has
    the row and that times the label, whose trees differ by the features that they see. Every leaf has a weight
    of ``min_leaf`` at least."""
    cuts, n = cuts_of(rows, columns)
    if not n:
        raise ValueError("no rows to learn from")
    table = table_of(rows, columns, sums, cuts, n)
    width, seen = len(columns), max(1, math.ceil(math.sqrt(len(columns))))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK))
    each = trees // groups if groups else trees
    root = np.arange(trees, dtype=np.int32)
    left, feature, limit = root.copy(), np.zeros(trees, np.int16), np.full(trees, 255, np.uint8)
    value, importances = np.zeros(trees), np.zeros((trees, width))
    open_ = {t: [t] for t in range(trees)}  # nodes to split by tree
    choice = np.random.default_rng(seed)

    for level in range(depth):
        units = [(t, nodes[k : k + NODES]) for t, nodes in open_.items() for k in range(0, len(nodes), NODES)]
        jobs: list[list] = []
        for unit in units:
            if not jobs or sum(len(u[1]) for u in jobs[-1]) + len(unit[1]) > NODES:
                jobs.append([])
            jobs[-1].append(unit)
        open_ = {}
        news: list[tuple] = []
        for job in jobs:
            candidates = {k: choice.random((len(nodes), width)).argsort(axis=1)[:, :seen].astype(np.int16) for k, (_, nodes) in enumerate(job)}
            found = _splits(table, sums, job, candidates, level, (root, left, feature, limit), each if groups else 0, seed, tasks, min_leaf, width)
            for k, (t, nodes) in enumerate(job):
                for node, best in zip(nodes, found.get(k, ())):
                    news.append((t, node, best))
        size = len(left)
        kids = [(t, node, best) for t, node, best in news if best[2] > 0]
        if level == 0:
            for _, node, best in news:
                value[node] = (best[4] + best[6]) / (best[3] + best[5]) if best[3] + best[5] else 0.0
        left = np.concatenate([left, np.arange(size, size + 2 * len(kids), dtype=np.int32)])
        feature, limit = np.concatenate([feature, np.zeros(2 * len(kids), np.int16)]), np.concatenate([limit, np.full(2 * len(kids), 255, np.uint8)])
        value = np.concatenate([value, np.zeros(2 * len(kids))])
        for i, (t, node, best) in enumerate(kids):
            a = size + 2 * i
            left[node], feature[node], limit[node] = a, int(best[0]), int(best[1])
            value[a], value[a + 1] = best[4] / best[3], best[6] / best[5]
            importances[t, int(best[0])] += best[2]
            open_.setdefault(t, []).extend((a, a + 1))
        if not open_:
            break
    total = importances.sum(axis=1, keepdims=True)
    share = np.divide(importances, total, out=np.zeros_like(importances), where=total > 0).sum(axis=0)
    return Forest(tuple(columns), cuts, root, left, feature, limit, value, depth, share / share.sum() if share.sum() else share, groups or 1)


def _splits(table: DataFrame, sums: Sequence[str], job: list, candidates: dict, level: int, trees: tuple, each: int, seed: int, tasks: int, min_leaf: float, width: int) -> dict[int, np.ndarray]:
    """The best split of each node of a job's units: feature, bin, gain, and weight and sum of its left and right."""
    root, left, feature, limit = trees
    seen = candidates[0].shape[1]
    units = [(t, np.array(nodes, np.int64)) for t, nodes in job]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2, len(nodes) * seen * BINS)) for _, nodes in units]
        slot = np.full(len(left), -1, np.int64)
        for chunk in _chunks(batches):
            x = _bytes(chunk.column("key").chunk(0), width)
            flat, h = x.ravel(), chunk.column("h").to_numpy().astype(np.int64).view(np.uint64)
            values = [chunk.column(c).to_numpy() for c in sums]
            if not each:
                mean = values[1] / values[0]
                spread = np.maximum(0, values[2] / values[0] - mean * mean)
                spread[(values[0] < 2) | (spread <= 1e-12 * mean * mean)] = 0
            last, own = None, None
            for k, (t, nodes) in enumerate(units):
                if own is None or last != (t // each if each else t):
                    last = t // each if each else t
                    own = (values[2 * last], values[2 * last + 1]) if each else drawn(h, values[0], mean, spread, seed, t)
                    some = np.flatnonzero(own[0] > 0)
                    weight, label, at = own[0][some], own[1][some], some * width
                slot[nodes] = np.arange(len(nodes))
                place = slot[_walked(flat, at, root[t], level, left, feature, limit)]
                slot[nodes] = -1
                inside = place >= 0
                p, w, y, a = (place, weight, label, at) if inside.all() else (place[inside], weight[inside], label[inside], at[inside])
                for j in range(seen):
                    to = (p * seen + j) * BINS + flat[a + candidates[k][p, j]]
                    total[k][0] += np.bincount(to, w, total[k].shape[1])
                    total[k][1] += np.bincount(to, y, total[k].shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(units)), pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], ["unit", "sums"])

    def best(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        nodes = len(units[k][1])
        total = sum(np.frombuffer(x, np.float64) for x in frame["sums"]).reshape(2, nodes, seen, BINS)
        low = np.cumsum(total, axis=3)
        w, y, all_w, all_y = low[0][..., :-1], low[1][..., :-1], low[0][..., -1:], low[1][..., -1:]
        v, z = all_w - w, all_y - y
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = y * y / w + z * z / v - all_y * all_y / all_w
        gain[(w < max(min_leaf, 0.5)) | (v < max(min_leaf, 0.5))] = -1
        # sums of doubles in another order are no gain
        gain[gain <= 1e-12 * np.abs(all_y * all_y / np.maximum(all_w, 1))] = -1
        flat = gain.reshape(nodes, -1)
        at = flat.argmax(axis=1)
        j, b, r = at // (BINS - 1), at % (BINS - 1), np.arange(nodes)
        out = np.stack([candidates[k][r, j], b, flat[r, at], w[r, j, b], y[r, j, b], v[r, j, b], z[r, j, b]], axis=1).astype(np.float64)
        return pd.DataFrame({"unit": [k], "best": [out.tobytes()]})

    made = table.coalesce(tasks).mapInArrow(added, "unit int, sums binary").groupBy("unit").applyInPandas(best, "unit int, best binary")
    return {r.unit: np.frombuffer(r.best, np.float64).reshape(-1, 7) for r in made.collect()}
