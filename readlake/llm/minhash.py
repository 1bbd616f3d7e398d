"""MinHash near-dedup with sequential Bayesian verification.

Documents of equal shingle sets are one class. Classes meet in the buckets of ``BANDS`` bands of
``ROWS`` MinHash values. Within a bucket, the signatures of two classes are compared ``BATCH``
values at a time, and the pair is dropped once the posterior chance that its similarity reaches
the threshold falls below ``MISS``. What survives is verified on the full sets, in two rounds: first
the likeliest pairs that connect a bucket, then every surviving pair between classes that the
verified links have not joined; a class with many such pairs is compared with the whole of the
other group in blocks. So a group of copies costs a tree of links, and its pairs are no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import pairs_within, whole_runs
from .common import join_hot, saved, spread, whole_text
from .graph import components

ROWS, BANDS, BATCH = 6, 48, 32
HASHES = ROWS * BANDS
#: Chance at which a pair of the threshold's similarity may be dropped by one comparison.
MISS = 1e-6
#: Classes of a bucket that one group holds; a larger bucket is dealt over several.
BLOCK = 1500
#: Pairs between two roots of a bucket that are rows of their own; where more survive, members are
#: compared with the whole root instead.
FEW = 4
#: Pairs that are compared at once.
PAIRS = 100_000
_WORDS = 300_000
_random = np.random.default_rng(20240607)
_A = (_random.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, hashes: dict[bytes, int], k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``k`` words; of the whole sequence if it is
    shorter; words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(k, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ h[j : len(h) - width + 1 + j]
    out = out * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.unique(out ^ out >> np.uint64(29))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low halves of the least values of ``HASHES`` permutations of the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 1024):
        values = np.multiply.outer(_A, x[a : a + 1024])
        values += _B[:, None]
        np.minimum(low, values.min(1), out=low)
    return (low ^ low >> np.uint32(16)).astype(np.uint16)


def least_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """For each number of compared values, the fewest matches at which the similarity may still
    reach the threshold: with a flat prior it is Beta(1 + m, 1 + h - m), and its upper tail is
    the lower tail of a binomial of h + 1 trials."""
    out = {}
    for h in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(h + 1, m) * threshold**m * (1 - threshold) ** (h + 1 - m)
        out[h] = m
    return out


def features(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id (digest of the set) and signature of every row; the last
    two are null for an empty set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            n, ids, signatures = [], [], []
            for text in batch["data"]:
                s = shingle_set(text.as_py(), hashes, k)
                n.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "text_hash", "n_shingles", "set_id", "signature"])

    rows = spread(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_hash"), whole_text().cast("binary").alias("data")))
    return rows.mapInArrow(make, "doc_id long, text_hash long, n_shingles long, set_id binary, signature binary")


def _bands(classes: DataFrame) -> DataFrame:
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * width + 1, F.lit(width))))
    return classes.select("set_id", "n_shingles", F.explode(keys).alias("bucket"))


def survivors(matrix: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that neither their sizes nor a batch of the signatures rules out, and their matches."""
    keep = den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])
    i, j = i[keep], j[keep]
    matches = np.zeros(len(i), np.int64)
    for h in range(BATCH, HASHES + 1, BATCH):
        matches += np.count_nonzero(matrix[i, h - BATCH : h] == matrix[j, h - BATCH : h], axis=1)
        keep = matches >= least[h]
        i, j, matches = i[keep], j[keep], matches[keep]
        if not len(i):
            break
    return i, j, matches


def _forest(i: np.ndarray, j: np.ndarray, matches: np.ndarray, group: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which pairs connect the rows of each group, the likeliest first."""
    chosen = []
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    order = np.lexsort((j, i, -matches, group))
    joined, at = 0, -1
    for k in order.tolist():
        g = int(group[k])
        if g != at:
            joined, at = 0, g
        if joined == sizes[g] - 1:
            continue
        a, b = root(int(i[k])), root(int(j[k]))
        if a != b:
            parent[a] = b
            joined += 1
            chosen.append(k)
    return np.array(chosen, np.int64)


def _first_pairs(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b) of set ids: of the pairs that survive in each group (bucket, part) of rows (bucket,
    part, set_id, n_shingles, signature), the likeliest that connect it."""
    num, den = threshold
    least = least_matches(num / den)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches):
            ids, n, matrix, sizes, _ = _columns(table)
            found = [x for group, i, j in pairs_within(sizes, PAIRS) if len((x := survivors(matrix, n, i, j, least, num, den))[0])]
            if found:
                i, j, matches = (np.concatenate(x) for x in zip(*found))
                chosen = _forest(i, j, matches, np.repeat(np.arange(len(sizes)), sizes)[i], sizes)
                yield _named_pairs(ids, i[chosen], j[chosen])

    return _dealt(rows).mapInArrow(compare, "a binary, b binary").distinct()


def _later_pairs(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b, root) for pairs that survive between different roots, of rows with root and side
    besides (0 in a group that is compared with itself, else 1 or 2): the pair (a, b), or where more than ``FEW`` survive between two roots of a group, for
    each member of the side with fewer of them a task (a, null, root): compare it with all of that root."""
    num, den = threshold
    least = least_matches(num / den)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches):
            ids, n, matrix, sizes, _ = _columns(table)
            names = table["root"].to_pylist()
            place = {r: k for k, r in enumerate(dict.fromkeys(names))}
            root, side = np.array([place[r] for r in names]), table["side"].to_numpy()
            first = np.cumsum(sizes) - sizes
            lefts = np.where(side[first] > 0, np.add.reduceat((side == 1).astype(np.int64), first), -1)
            tasks: set[tuple[bytes, bytes]] = set()
            pairs: set[tuple[bytes, bytes]] = set()
            found = []
            for _, i, j in pairs_within(sizes, PAIRS, lefts):
                keep = root[i] != root[j]
                i, j, _ = survivors(matrix, n, i[keep], j[keep], least, num, den)
                found.append((i, j))
            i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
            group = np.repeat(np.arange(len(sizes)), sizes)
            swap = root[i] > root[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            key = np.stack([group[i], root[i], root[j]], 1)
            _, which, count = np.unique(key, axis=0, return_inverse=True, return_counts=True)
            which = which.ravel()
            many = count[which] > FEW
            pairs.update((ids[x], ids[y]) for x, y in zip(i[~many].tolist(), j[~many].tolist()))
            order, ends = np.argsort(which, kind="stable"), np.cumsum(count)
            for k in np.flatnonzero(count > FEW).tolist():
                own = order[ends[k] - count[k] : ends[k]]
                x, y = np.unique(i[own]), np.unique(j[own])
                few, other = (x, y) if len(x) <= len(y) else (y, x)
                tasks.update((ids[m], names[other[0]]) for m in few.tolist())
            rows = [(min(p), max(p), None) for p in sorted(pairs)] + [(a, None, r) for a, r in sorted(tasks)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], ["a", "b", "root"])

    return _dealt(rows, "side").mapInArrow(compare, "a binary, b binary, root binary").distinct()


def _paired(rows: DataFrame) -> DataFrame:
    """Rows (bucket, size, most, set_id, root, ...) dealt so that two of different roots meet once, with part
    and side: a bucket of more than ``BLOCK`` is cut into blocks of its largest root and of the rare
    rest, and each rare block meets itself and every other block in a group of its own."""
    rare = F.col("root") != F.col("most.root")
    large = F.col("size") > BLOCK
    few = F.when(large, F.ceil((F.col("size") - F.col("most.n")) / BLOCK)).otherwise(F.lit(1).cast("long"))
    rest = F.when(large, F.ceil(F.col("most.n") / BLOCK)).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumns({"few": few, "blocks": few + rest, "rare": rare | ~large})
    place = F.xxhash64("set_id", "bucket")
    own = F.when(F.col("rare"), F.pmod(place, "few")).otherwise(F.col("few") + F.pmod(place, F.greatest(F.col("blocks") - F.col("few"), F.lit(1))))
    mates = F.sequence(F.lit(0).cast("long"), F.when(F.col("rare"), F.col("blocks")).otherwise(F.col("few")) - 1)
    rows = rows.withColumn("own", own).withColumn("mate", F.explode(mates))
    side = F.when(F.col("own") == F.col("mate"), 0).when(F.col("own") < F.col("mate"), 1).otherwise(2)
    return rows.withColumn("part", F.least("own", "mate") * F.col("blocks") + F.greatest("own", "mate")).withColumn("side", side)


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", *order, "set_id")


def _columns(table: pa.Table):
    """Set ids, set sizes, signatures, sizes of the groups (bucket, part), and the parts."""
    bucket, part = table["bucket"].to_numpy(), table["part"].to_numpy()
    cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1
    sizes = np.diff(np.concatenate([[0], cuts, [len(bucket)]]))
    matrix = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(-1, HASHES)
    return table["set_id"].to_pylist(), table["n_shingles"].to_numpy(), matrix, sizes, part


def _named_pairs(ids: list[bytes], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    pairs = sorted({(min(ids[x], ids[y]), max(ids[x], ids[y])) for x, y in zip(i.tolist(), j.tolist())})
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])


def full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(set_id, shingles) of the wanted set ids, made again from the texts of one document each: the
    class's own (doc_id, text_hash), that of the least id or of any where none has an id."""
    chosen = classes.join(wanted, "set_id", "left_semi").select(F.col("own.doc_id").alias("own_id"), F.col("own.text_hash").alias("own_hash"))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_hash"), whole_text().cast("binary").alias("data"))
    texts = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")), "left_semi").select("data")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            own = [shingle_set(t.as_py(), hashes, k).tobytes() for t in batch["data"]]
            ids = [hashlib.blake2b(s, digest_size=16).digest() for s in own]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(own, pa.binary())], ["set_id", "shingles"])

    return texts.mapInArrow(sets, "set_id binary, shingles binary").dropDuplicates(["set_id"])


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """``den * common >= num * union`` of two sorted sets."""
    if len(y) < len(x):
        x, y = y, x
    n = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return den * n >= num * (len(x) + len(y) - n)


def verify_pairs(pairs: DataFrame, full: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), *threshold) for x, y in zip(batch["x"], batch["y"])]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(full.select(F.col("set_id").alias("a"), F.col("shingles").alias("x")), "a").join(full.select(F.col("set_id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(common, "a binary, b binary")


def verify_tasks(tasks: DataFrame, rooted: DataFrame, full: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """A link (a, b) for each task (a, root) and block of that root's members where there is one.
    Members and the tasks of a root are both dealt over blocks of about ``BLOCK``; each block of
    tasks meets each block of members in a group of its own."""
    num, den = threshold
    least = least_matches(num / den)
    asked = tasks.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("ask_blocks"))
    own = rooted.join(asked, "root").join(full, "set_id")
    blocks = own.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = F.xxhash64("set_id", "root")
    part = F.col("own") * F.col("ask_blocks") + F.col("ask")
    columns = ["root", part.alias("part"), "asks", "set_id", "n_shingles", "signature", "shingles"]
    mine = own.join(blocks, "root").withColumns({"own": F.pmod(place, "blocks"), "asks": F.lit(False)}).withColumn("ask", every("ask_blocks")).select(*columns)
    sets = rooted.drop("root").join(full, "set_id")
    asks = tasks.select("root", F.col("a").alias("set_id")).join(asked, "root").join(blocks, "root").join(sets, "set_id")
    asks = asks.withColumns({"ask": F.pmod(place, "ask_blocks"), "asks": F.lit(True)}).withColumn("own", every("blocks")).select(*columns)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches):
            ids, n, matrix, sizes, _ = _columns(table)
            asking, sets = table["asks"].to_numpy(), table["shingles"]
            links, at = [], 0
            for size in sizes.tolist():
                mine = at + np.flatnonzero(~asking[at : at + size])
                arrays: dict[int, np.ndarray] = {}
                load = lambda k, arrays=arrays: arrays[k] if k in arrays else arrays.setdefault(k, np.frombuffer(sets[k].as_py(), np.uint64))
                for x in (at + np.flatnonzero(asking[at : at + size])).tolist():
                    _, j, matches = survivors(matrix, n, np.full(len(mine), x), mine, least, num, den)
                    for y in j[np.argsort(-matches, kind="stable")].tolist():
                        if ids[x] != ids[y] and similar(load(x), load(y), num, den):
                            links.append((x, y))
                            break
                at += size
            if links:
                i, j = np.array(links).T
                yield _named_pairs(ids, i, j)

    rows = mine.unionByName(asks).withColumn("bucket", F.xxhash64("root"))
    return _dealt(rows).select("bucket", "part", "asks", "set_id", "n_shingles", "signature", "shingles").mapInArrow(compare, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash: groups of documents linked by a Jaccard similarity
    of at least ``num / den`` of their sets of distinct ``k``-word shingles.

    A shorter text is one shingle; an empty or null one has the empty set and links with nothing.
    component_id is the smallest doc_id that links reach, kept marks it; where no
    member has an id, component_id is null and kept marks the rows of one text. Equal texts are linked
    always; a pair of different sets at the threshold shares no bucket with chance ``(1 - s**ROWS)
    ** BANDS`` (5e-7 at 0.8). A similarity of just the threshold links. Repeated rows of a doc_id
    give a row each; an empty table gives none. A very long text is hashed whole, in pieces; only
    doc_id and text are read, so further columns cannot clash.
    """
    docs = docs.select("doc_id", "text")
    members = saved(features(docs, k))
    classes = saved(members.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("own"), F.min("text_hash").alias("least_hash"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")))
    bands = _bands(classes)
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    inside = saved(bands.join(shared, "bucket"))
    signatures = classes.select("set_id", "signature")
    slim = classes.select("set_id", "own")

    parts = F.ceil(F.col("size") / BLOCK)
    first = inside.withColumn("part", F.pmod(F.xxhash64("set_id", "bucket"), parts)).join(signatures, "set_id").select("bucket", "part", "set_id", "n_shingles", "signature")
    pairs = saved(_first_pairs(first, threshold))
    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("set_id")).where("set_id is not null").distinct()
    links = saved(verify_pairs(pairs, full_sets(docs, slim, ends(pairs), k), threshold))
    roots = saved(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    rooted = inside.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    per_root = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    major = per_root.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    second = _paired(rooted.join(major, "bucket")).join(signatures, "set_id").select("bucket", "part", "side", "set_id", "n_shingles", "signature", "root")
    later = saved(_later_pairs(second, threshold))
    tasks = later.where("b is null").select("a", "root")
    pairs = later.where("b is not null").select("a", "b").join(links, ["a", "b"], "left_anti")
    by_root = classes.select("set_id", "n_shingles", "signature").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    asked = by_root.join(tasks.select("root").distinct(), "root", "left_semi").select("set_id")
    full = saved(full_sets(docs, slim, ends(pairs).union(tasks.select("a")).union(asked).distinct(), k))
    more = verify_pairs(pairs, full, threshold).unionByName(verify_tasks(tasks, by_root, full, threshold))
    links = saved(links.unionByName(more))
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    own = classes.select("set_id", "n", F.col("own.doc_id").alias("least"), "least_hash").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    tops = own.groupBy("root").agg(F.min("least").alias("component_id"), F.min("least_hash").alias("top_hash"))
    labels = saved(own.join(tops, "root").select("set_id", "n", "component_id", "top_hash"))
    rows = members.select("doc_id", "n_shingles", "set_id", "text_hash")
    found = join_hot(rows.where("set_id is not null"), labels, "set_id", "n", rows.count())
    none = rows.where("set_id is null").withColumns({"component_id": F.lit(None).cast("long"), "top_hash": F.lit(None).cast("long")})
    out = found.unionByName(none)
    component = F.coalesce("component_id", "doc_id")
    kept = F.col("doc_id").eqNullSafe(component) & (component.isNotNull() | F.coalesce(F.col("text_hash") == F.col("top_hash"), F.lit(True)))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash")


def keep_one_of_each(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The documents, with all their columns, without all but one of each group of near duplicates:
    that of the smallest id. Rows are told apart by id and text, so one without an id stays if no
    group has taken it, of rows that repeat both one stays, and so does every empty or null text of
    an id of its own. Columns of any name pass through."""
    found = near_duplicates(docs, k, threshold).where("kept").select(F.col("doc_id").alias("_readlake_doc"), F.col("text_hash").alias("_readlake_hash")).distinct()
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_readlake_doc")) & (F.xxhash64(whole_text()) == F.col("_readlake_hash"))
    return docs.join(found, on, "left_semi").dropDuplicates(["doc_id", "text"])


def op9_bayes_minhash(spark, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of all ``documents`` by runs of two words; its docstring states every case."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2).drop("text_hash")
