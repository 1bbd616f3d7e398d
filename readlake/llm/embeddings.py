"""Embedding near-dedup by p-stable hashing.

For unit vectors a cosine is a Euclidean distance, and quantised Gaussian projections put near
vectors into one cell. A table joins ``PROJECTIONS`` of them to a bucket; ``TABLES`` tables give
each pair as many chances. A pair is checked exactly in the first table where it meets, inside
its bucket, so links are counted there and no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import whole_runs
from .common import join_hot, saved, spread
from .graph import components

#: Width of a cell, projections of a bucket and tables: a pair of cosine 0.9 (distance 0.447) falls
#: into one cell with chance 0.82 and meets somewhere with chance 0.96, one of cosine 0.95 with
#: 0.9995, one of cosine 0 in a given table with 3e-6.
WIDTH, PROJECTIONS, TABLES = 2.0, 20, 160
SEED = 20240607
#: Vectors of a bucket that one task compares with as many at a time.
BLOCK = 1024


def hash_tables(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions (dim, TABLES * PROJECTIONS), their offsets, and odd multipliers that join cells."""
    random = np.random.default_rng([SEED, dim])
    directions = random.standard_normal((dim, TABLES * PROJECTIONS))
    offsets = random.uniform(0, WIDTH, TABLES * PROJECTIONS)
    joins = random.integers(0, 1 << 63, PROJECTIONS, dtype=np.int64) | 1
    return directions, offsets, joins


def bucket_keys(unit: np.ndarray, directions: np.ndarray, offsets: np.ndarray, joins: np.ndarray) -> np.ndarray:
    """(n, TABLES) 32-bit keys of the buckets of unit vectors."""
    cells = np.floor((unit @ directions + offsets) / WIDTH).astype(np.int64)
    keys = (cells.reshape(len(unit), TABLES, PROJECTIONS) * joins).sum(-1)  # wraps around
    return (keys ^ keys >> 32).astype(np.uint32)


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow, however large
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _hashed(classes: DataFrame) -> DataFrame:
    """(rep, keys) of classes (rep, vector); keys are packed 32-bit integers."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, tuple] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                rows = [np.array(v, np.float64) for v in part["vector"].to_pylist()]
                keys: list[bytes] = [b""] * len(rows)
                for dim in {len(r) for r in rows}:
                    if dim not in tables:
                        tables[dim] = hash_tables(dim)
                    own = [n for n, r in enumerate(rows) if len(r) == dim]
                    for n, k in zip(own, bucket_keys(_units(np.concatenate([rows[n] for n in own]), dim), *tables[dim])):
                        keys[n] = k.tobytes()
                yield pa.RecordBatch.from_arrays([part["rep"], pa.array(keys, pa.binary())], ["rep", "keys"])

    return classes.select("rep", "vector").mapInArrow(make, "rep long, keys binary")


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one that the links (i, j), given both ways, connect it with."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        low = low[low]
        if np.array_equal(low, label):
            return label
        label = low


def _count_links(dealt: DataFrame, least: float) -> DataFrame:
    """(rep, links, other): for the rows (bucket, part, left, right, rep, weight, place, keys,
    vector) of each group, how many vectors each class links with whose first common table this
    is, and a class that stands for all those it is connected with in the group."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches):
            table = table.combine_chunks()
            bucket, part = table["bucket"].to_numpy(), table["part"].to_numpy()
            reps, weights, at, right = (table[c].to_numpy(zero_copy_only=False) for c in ("rep", "weight", "place", "right"))
            keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint32).reshape(-1, TABLES)
            vectors = table["vector"].combine_chunks()
            lengths = np.diff(vectors.offsets.to_numpy())
            # vectors of different length never link: each length of a bucket is a group of its own
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]) | (lengths[1:] != lengths[:-1])) + 1
            bounds = np.concatenate([[0], cuts, [len(bucket)]])
            flat = vectors.flatten().to_numpy().astype(np.float64)
            starts = np.cumsum(lengths) - lengths
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                dim, t = int(lengths[a]), int(at[a])
                x = flat[starts[a] : starts[a] + (b - a) * dim]
                unit, k = _units(x, dim), keys[a:b]
                cross = bool(right[a:b].any())
                i = np.flatnonzero(~right[a:b])
                j = np.flatnonzero(right[a:b]) if cross else i
                close = unit[i] @ unit[j].T >= least
                p, q = np.nonzero(close if cross else np.triu(close, 1))
                i, j = i[p], j[q]
                for c in range(0, t, 8):  # drop what has met in an earlier table
                    new = ~(k[i, c : min(c + 8, t)] == k[j, c : min(c + 8, t)]).any(1)
                    i, j = i[new], j[new]
                    if not len(i):
                        break
                if not len(i):
                    continue
                i, j = np.concatenate([i, j]) + a, np.concatenate([j, i]) + a
                who, inverse = np.unique(i, return_inverse=True)
                links = np.bincount(inverse, weights[j]).astype(np.int64)
                out.append((reps[who], links, reps[who[_roots(len(who), inverse, np.searchsorted(who, j))]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["rep", "links", "other"])

    return dealt.mapInArrow(compare, "rep long, links long, other long")


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: vectors linked by a cosine of at least ``least``.

    Vectors that are null, empty or zero or hold a null or non-finite component link with nothing;
    neither do vectors of different length. Equal vectors are one class and link always; a cosine of
    just ``least`` links. Repeated rows of an id, and rows without one, count as vectors of their own;
    an empty table gives no rows. A bucket of more than ``BLOCK`` classes is compared block by block,
    each pair of blocks in a group of its own. Only the two columns are read, so others cannot clash.
    """
    rows = saved(spread(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable(F.col(vector_col)), F.col(vector_col)).alias("vector"))))
    named = rows.where("vector is not null").select(F.xxhash64("vector").alias("rep"), "vec_id", "vector")
    classes = saved(named.groupBy("rep").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector")))
    hashed = saved(_hashed(classes))
    place = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TABLES - 1)), lambda t: F.xxhash64(t, F.substring(F.col("keys"), t * 4 + 1, F.lit(4))))).alias("place", "bucket")
    cells = hashed.select("rep", place)
    sizes = cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    inside = cells.join(sizes, "bucket")
    # block b meets itself in part (b, b) and each other block once, as the left or the right side
    blocks = F.ceil(F.col("size") / BLOCK)
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    inside = inside.withColumn("blocks", blocks).withColumn("own", own).withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    inside = inside.withColumn("part", F.least("own", "mate") * F.col("blocks") + F.greatest("own", "mate")).withColumn("right", F.col("own") > F.col("mate"))
    full = inside.join(classes.select("rep", "weight", "vector"), "rep").join(hashed, "rep")
    dealt = full.select("bucket", "part", "right", "rep", "weight", "place", "keys", "vector").repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.size("vector"), "rep")
    found = saved(_count_links(dealt, least))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("u"), F.col("other").alias("v")))
    labelled = classes.select("rep", "least", "weight").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    tops = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = labelled.join(tops, "root").join(links, "rep", "left").select("rep", "weight", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    found = join_hot(named.select("rep", "vec_id"), saved(labels), "rep", "weight", rows.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = found.unionByName(alone)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"))


def op2_pstable_near_vectors(spark, sf_dir: str) -> DataFrame:
    """``near_vectors`` of all ``embeddings`` at a cosine of 0.9; every case is stated there."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
