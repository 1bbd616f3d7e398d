"""Approximate nearest neighbours by NN-descent, searched greedily on the neighbour graph.

NN-descent: a neighbour of a neighbour is likely a neighbour. Every vector has a list of its
``WIDTH`` nearest found so far. In a round each vector brings the vectors on its list together,
with itself, and offers them to one another; who improves on a list enters it. Pairs of which
neither is new to the list have met before and are passed over, and what can't enter is never a
row, so rounds become cheap and end when few lists change. The start is better than chance: vectors
sorted by which side of random planes they are on are compared in short stretches.

Nodes are numbered along one of the sortings and worked on in blocks of ``1 << BLOCK_BITS`` numbers. A
block asks each block that its lists name for all the vectors that it needs of it at once, gets each
once, and sends its offers in the same way. Vectors move as 16-bit integers.

Lists are by cosine, and queries seek the largest inner product. A query is a node of the graph: it walks
in rounds from its own and from the ``ENTRIES`` longest vectors, and all of its ``POOL`` best candidates that
have not been asked are asked for their lists, until there are none. What is left is measured on the
original vectors in double precision.

Equal vectors are one node, known by its smallest id, with as many of its smallest ids as a query
can return of it; so copies don't fill lists, and none that belongs in a result is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, saved_buckets, spread
from .embeddings import usable

#: Neighbours on a list, sortings at the start, vectors of a stretch and those that each of it offers.
WIDTH, SORTINGS, STRETCH, OFFERED = 64, 8, 256, 20
#: Rounds end when at most this part of all entries is new; and rounds at most.
SETTLED, ROUNDS = 0.1, 12
#: Bits of a node's number that tell its place in its block, candidates of a query, and long vectors
#: that it starts from.
BLOCK_BITS, POOL, ENTRIES = 11, 64, 16
#: Pieces of the finished graph, in which it lies sorted by node for the walk.
PIECES = 64
#: Vectors that the planes' places are taken from at most, and planes of a sorting.
SAMPLE, PLANES = 4096, 40
SEED = 20240811
#: Entries that a task holds of a block's offers before it drops all that can't stay.
HELD = 1 << 20
_NONE = np.float32(-np.inf).tobytes()
_LISTS = "node long, block long, ids binary, scores binary, fresh binary"
#: Offers to the nodes of a block, entry by entry; an old list has its one node in ``node``.
_OFFERS = "block long, node long, nodes binary, ids binary, scores binary, fresh binary"


def nodes_of(vectors: DataFrame, id_col: str, vector_col: str, copies: int) -> DataFrame:
    """node (smallest id), vector, dim, ids (the ``copies`` smallest, ascending) of each different vector."""
    rows = spread(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))).where(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()
    rank = F.row_number().over(W.partitionBy("vector").orderBy("id"))  # its bound is kept before the shuffle too
    few = rows.withColumn("_rank", rank).where(F.col("_rank") <= copies)
    nodes = few.groupBy("vector").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("ids"))
    return saved(nodes.select("node", "vector", F.size("vector").alias("dim"), "ids"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def coded(nodes: DataFrame) -> DataFrame:
    """node, dim, code, size: the vector at length one, as 16-bit integers, their step, and its length over the
    greatest of any (``size``), both as 32-bit floats."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    largest = nodes.agg(F.max(length)).first()[0] or 1.0
    largest = largest if np.isfinite(largest) else float(np.finfo(np.float64).max)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            flat, ends = _matrix(batch["vector"]) / largest, np.cumsum(dims)
            out: list[bytes] = [b""] * len(dims)
            sizes = np.zeros(len(dims), np.float32)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
                most = np.abs(x).max(1)[:, None]  # no overflow, however large or small
                size = np.sqrt(((x / most) ** 2).sum(1))[:, None]
                x, step = x / most / size, 1 / size / 32767
                rest = np.column_stack([step, most * size]).astype(np.float32)
                sizes[own] = rest[:, 1]
                for k, a, b in zip(own.tolist(), np.rint(x / step).astype(np.int16), rest):
                    out[k] = a.tobytes() + b.tobytes()
            yield pa.RecordBatch.from_arrays([batch["node"], batch["dim"], pa.array(out, pa.binary()), pa.array(sizes)], ["node", "dim", "code", "size"])

    return saved(nodes.select("node", "dim", "vector").mapInArrow(code, "node long, dim int, code binary, size float"))


def _decoded(codes: list[bytes] | np.ndarray) -> np.ndarray:
    """Rows of equal length from codes of equal length, as bytes or as rows of 16-bit integers; the
    relative length comes last."""
    raw = codes if isinstance(codes, np.ndarray) else np.frombuffer(b"".join(codes), np.int16).reshape(len(codes), -1)
    rest = np.ascontiguousarray(raw[:, -4:]).view(np.float32)
    return np.column_stack([raw[:, :-4] * rest[:, :1], rest[:, 1:]])


def _best(node: np.ndarray, ids: np.ndarray, scores: np.ndarray, fresh: np.ndarray, width: int) -> list[np.ndarray]:
    """The ``width`` best different entries of each node, by falling score and rising id; of an entry that
    comes twice the one that isn't fresh counts. Nodes rise."""
    parts = (node, ids, scores, fresh)
    keep = np.flatnonzero(node != ids)
    order = keep[np.lexsort((fresh[keep], ids[keep], node[keep]))]
    node, ids, scores, fresh = (x[order] for x in parts)
    first = np.ones(len(node), bool)
    first[1:] = (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])
    node, ids, scores, fresh = (x[first] for x in (node, ids, scores, fresh))
    order = np.lexsort((ids, -scores, node))
    node, ids, scores, fresh = (x[order] for x in (node, ids, scores, fresh))
    starts = _starts(node)
    place = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
    return [x[place < width] for x in (node, ids, scores, fresh)]


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _cut(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """The different keys, which come in runs, and each column's bytes of their runs."""
    starts = _starts(keys)
    ends = [*starts[1:].tolist(), len(keys)]
    return keys[starts], [[x[a:b].tobytes() for a, b in zip(starts.tolist(), ends)] for x in columns]


def _typed(ids: np.ndarray, scores: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return ids.astype(np.int64), scores.astype(np.float32), fresh.astype(np.int8)


def _merged(offers: DataFrame, width: int) -> DataFrame:
    """One list a node of each block's offers."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = None, [], 0

        def joined() -> list[np.ndarray]:
            return _best(*(np.concatenate(x) for x in zip(*held)), width)

        def done() -> pa.RecordBatch:
            node, *rest = joined()
            nodes, columns = _cut(node, *_typed(*rest))
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.full(len(nodes), block), pa.int64()), *(pa.array(x, pa.binary()) for x in columns)], ["node", "block", "ids", "scores", "fresh"])

        for batch in batches:
            for own, node, nodes, ids, scores, fresh in zip(*(batch[c].to_pylist() for c in ("block", "node", "nodes", "ids", "scores", "fresh"))):
                if own != block and held:
                    yield done()
                    held, size = [], 0
                block = own
                of = np.frombuffer(nodes, np.int64) if nodes is not None else np.full(len(fresh), node)
                held.append([of, np.frombuffer(ids, np.int64), np.frombuffer(scores, np.float32), np.frombuffer(fresh, np.int8)])
                size += len(fresh)
                if size > HELD:
                    held = [joined()]
                    size = len(held[0][0]) // 2  # what can't shrink doesn't count at once again
        if held:
            yield done()

    return offers.repartition("block").sortWithinPartitions("block").mapInArrow(merge, _LISTS)


def numbered(codes: DataFrame) -> DataFrame:
    """The codes with ``keys``, for each of ``SORTINGS`` sets of planes the sides that a vector is on, and a new
    number ``node``, by the first of them (the old one is ``vec``). The planes are random, and each goes
    through the median of at most ``SAMPLE`` vectors, those of the smallest hash."""
    sample: dict[int, list[bytes]] = {}
    for r in codes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect():
        sample.setdefault(r["dim"], []).append(bytes(r["code"]))

    def planes(dim: int) -> np.ndarray:
        return np.random.default_rng([SEED, dim]).standard_normal((dim, SORTINGS * PLANES)).astype(np.float32)

    medians = {dim: np.median(_decoded(x)[:, :-1] @ planes(dim), axis=0) for dim, x in sample.items()}
    shared = codes.sparkSession.sparkContext.broadcast(medians)

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(PLANES - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims, codes = batch["dim"].to_numpy(), batch["code"].to_pylist()
            keys = np.zeros((len(dims), SORTINGS), np.int64)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                at = _decoded([codes[k] for k in own])[:, :-1] @ planes(dim)
                above = at >= shared.value.get(dim, np.zeros(at.shape[1]))
                keys[own] = above.reshape(len(own), SORTINGS, PLANES) @ powers
            ends = np.arange(len(dims) + 1, dtype=np.int32) * SORTINGS
            yield pa.RecordBatch.from_arrays([batch["node"], batch["dim"], batch["code"], batch["size"], pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], ["vec", "dim", "code", "size", "keys"])

    keyed = saved(codes.mapInArrow(sides, "vec long, dim int, code binary, size float, keys array<long>"))
    order = ("dim", F.col("keys")[0], "vec")
    dealt = saved(keyed.repartitionByRange(*order).withColumn("_part", F.spark_partition_id().cast("long")))
    at = F.row_number().over(W.partitionBy("_part").orderBy(*order)).cast("long") - 1
    return saved(dealt.withColumn("node", F.shiftleft("_part", 40) + at).drop("_part"))


def started(codes: DataFrame) -> DataFrame:
    """Lists to start from: in each sorting a vector offers itself to its nearest in a stretch of about ``STRETCH``."""
    order = ("sorting", "dim", "key", "node")
    rows = saved(codes.select("node", "dim", "code", F.posexplode("keys").alias("sorting", "key")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, nodes, codes = None, [], []

        def stretches(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal nodes, codes
            while len(nodes) >= 2 * STRETCH or final and nodes:
                n = STRETCH if len(nodes) >= 2 * STRETCH else len(nodes) if len(nodes) <= STRETCH else (len(nodes) + 1) // 2
                own, x = np.array(nodes[:n]), _decoded(codes[:n])[:, :-1]
                nodes, codes = nodes[n:], codes[n:]
                k = min(OFFERED, n - 1)
                if k < 1:
                    continue
                near = x @ x.T
                np.fill_diagonal(near, -np.inf)
                best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                values = np.take_along_axis(near, best, 1)
                yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array([r.tobytes() for r in y], pa.binary()) for y in (own[best], values.astype(np.float32), np.ones(best.shape, np.int8)))], ["node", "ids", "scores", "fresh"])

        for batch in batches:
            which = list(zip(batch["sorting"].to_pylist(), batch["dim"].to_pylist()))
            for node, code, own in zip(batch["node"].to_pylist(), batch["code"].to_pylist(), which):
                if own != run:
                    yield from stretches(True)
                    run = own
                nodes.append(node)
                codes.append(code)
                if len(nodes) >= 2 * STRETCH:
                    yield from stretches(False)
        yield from stretches(True)

    offers = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, "node long, ids binary, scores binary, fresh binary")
    return _merged(_offered(offers), WIDTH)


def _block(node: str) -> Column:
    return F.shiftright(node, BLOCK_BITS)


def _offered(lists: DataFrame) -> DataFrame:
    return lists.select(_block("node").alias("block"), "node", F.lit(None).cast("binary").alias("nodes"), "ids", "scores", "fresh")


def _blocks(lists: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows sorted by ``block``: what it gets of the nodes that its lists name and of its own, packed: numbers,
    codes of one length, and the least scores that get a place on their lists (``kind`` 0); then its lists."""
    bits = BLOCK_BITS

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, ids = batch["node"].to_numpy(), batch["ids"].to_pylist()
            named = np.concatenate([node, np.frombuffer(b"".join(ids), np.int64)])
            block = np.concatenate([node, np.repeat(node, [len(x) // 8 for x in ids])]) >> bits
            order = np.lexsort((named, block))
            named, block = named[order], block[order]
            keep = np.ones(len(named), bool)
            keep[1:] = (named[1:] != named[:-1]) | (block[1:] != block[:-1])
            named, block = named[keep], block[keep]
            starts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (named[1:] >> bits != named[:-1] >> bits)])) if len(named) else []
            ends = [*starts[1:], len(named)]
            yield pa.RecordBatch.from_arrays([pa.array(named[starts] >> bits, pa.int64()), pa.array(block[starts], pa.int64()), pa.array([named[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], ["home", "block", "nodes"])

    def replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, numbers, codes, least = None, [], [], []
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for own, kind, node, code, last, block, asked in zip(*(batch[c].to_pylist() for c in ("home", "kind", "node", "code", "least", "block", "nodes"))):
                if own != home:
                    home, numbers, codes, least = own, [], [], []
                if kind == 0:
                    numbers.append(node)
                    codes.append(code)
                    least.append(last or _NONE)
                    continue
                wanted = np.frombuffer(asked, np.int64)
                at = np.searchsorted(np.array(numbers, np.int64), wanted).tolist()
                lengths = np.array([len(codes[k]) for k in at])
                for length in np.unique(lengths).tolist():
                    mine = np.flatnonzero(lengths == length).tolist()
                    for x, y in zip(out, (block, wanted[mine].tobytes(), b"".join([codes[at[k]] for k in mine]), b"".join([least[at[k]] for k in mine]))):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["block", "nodes", "codes", "least"])

    least = F.when(F.length("fresh") >= WIDTH, F.substring("scores", 4 * (WIDTH - 1) + 1, 4)).alias("least")
    null = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    there = codes.select("node", "code").join(lists.select("node", least), "node", "left")
    there = there.select(_block("node").alias("home"), F.lit(0).alias("kind"), "node", "code", "least", *null("long", "block"), *null("binary", "nodes"))
    asked = lists.select("node", "ids").mapInArrow(asks, "home long, block long, nodes binary")
    asked = asked.select("home", F.lit(1).alias("kind"), *null("long", "node"), *null("binary", "code", "least"), "block", "nodes")
    met = there.unionByName(asked).repartition("home").sortWithinPartitions("home", "kind", "node")
    got = met.mapInArrow(replies, "block long, nodes binary, codes binary, least binary")
    got = got.select("block", F.lit(0).alias("kind"), *null("long", "node"), "nodes", "codes", "least", *null("binary", "ids", "fresh"))
    own = lists.select("block", F.lit(1).alias("kind"), "node", *null("binary", "nodes", "codes", "least"), "ids", "fresh")
    return got.unionByName(own).repartition("block").sortWithinPartitions("block", "kind", "node")


def _lists_of(table: pa.Table) -> Iterator[tuple]:
    """For each block of a table: the different nodes that it has got, their codes and least scores, and of its
    lists the node's place among them, the places of what it names, and which are fresh."""
    blocks, kinds = table["block"].to_numpy(), table["kind"].to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]]))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        m = a + int((kinds[a:b] == 0).sum())
        parts = [np.frombuffer(x, np.int64) for x in table["nodes"][a:m].to_pylist()]
        codes = [c[k : k + len(c) // len(x)] for x, c in zip(parts, table["codes"][a:m].to_pylist()) for k in range(0, len(c), len(c) // len(x))]
        nodes, first = np.unique(np.concatenate(parts), return_index=True)  # what two batches asked for came twice
        least = np.frombuffer(b"".join(table["least"][a:m].to_pylist()), np.float32)[first]
        ids = [np.searchsorted(nodes, np.frombuffer(x, np.int64)) for x in table["ids"][m:b].to_pylist()]
        fresh = [np.frombuffer(x, np.int8) for x in table["fresh"][m:b].to_pylist()]
        yield nodes, [codes[k] for k in first.tolist()], least, np.searchsorted(nodes, table["node"][m:b].to_numpy()), ids, fresh


def descended(lists: DataFrame, codes: DataFrame) -> DataFrame:
    """One round: the lists after each node has brought those on its list together."""

    bits = BLOCK_BITS

    def offers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "block"):
            for nodes, codes, least, places, ids, fresh in _lists_of(table):
                lengths = np.array([len(c) for c in codes])
                found: list[tuple] = []
                for length in np.unique(lengths).tolist():
                    of = np.flatnonzero(lengths == length)
                    x = np.zeros((len(nodes), length // 2 - 4), np.float32)
                    x[of] = _decoded([codes[k] for k in of.tolist()])[:, :-1]
                    mine = [k for k in range(len(places)) if lengths[places[k]] == length and fresh[k].any()]
                    for a in range(0, len(mine), 128):
                        few = mine[a : a + 128]
                        most = max(len(ids[k]) for k in few) + 1
                        at, new, there = np.zeros((len(few), most), np.int64), np.zeros((len(few), most), bool), np.zeros((len(few), most), bool)
                        for row, k in enumerate(few):
                            n = len(ids[k])
                            at[row, :n], at[row, n], new[row, :n], new[row, n], there[row, : n + 1] = ids[k], places[k], fresh[k], True, True
                        y = x[at]
                        near = np.matmul(y, y.transpose(0, 2, 1))
                        ok = (near > least[at][:, :, None]) & (new[:, :, None] | new[:, None, :]) & there[:, :, None] & there[:, None, :]
                        g, i, j = np.nonzero(ok)
                        found.append((nodes[at[g, i]], nodes[at[g, j]], near[g, i, j]))
                if found:
                    to, others, scores = (np.concatenate(f) for f in zip(*found))
                    to, others, scores, new = _best(to, others, scores, np.ones(len(to), np.int8), WIDTH)
                    blocks, columns = _cut(to >> bits, to, *_typed(others, scores, new))  # nodes rise, and so do blocks
                    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.nulls(len(blocks), pa.int64()), *(pa.array(x, pa.binary()) for x in columns)], ["block", "node", "nodes", "ids", "scores", "fresh"])

    old = _offered(lists.withColumn("fresh", F.expr("cast(repeat('\\0', length(fresh)) as binary)")))
    return _merged(_blocks(lists, codes).mapInArrow(offers, _OFFERS).unionByName(old), WIDTH)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys of sorted rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch[key].to_numpy(zero_copy_only=False)
        if held and held[-1][key][-1].as_py() != column[0]:
            yield pa.Table.from_batches(held)
            held = []
        cuts = np.flatnonzero(column[1:] != column[:-1])
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]) + 1)])
            held = [batch.slice(int(cuts[-1]) + 1)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def neighbour_lists(codes: DataFrame) -> DataFrame:
    """node, block, ids, scores, fresh: packed lists of each node's nearest, the nearest first, a row for
    every node of the numbered ``codes``."""
    alone = codes.select("node", _block("node").alias("block"), *(F.lit(b"").alias(c) for c in ("ids", "scores", "fresh")))
    lists = saved(started(codes))
    lists = saved(lists.unionByName(alone.join(lists, "node", "left_anti")))
    for _ in range(ROUNDS):
        after = saved(descended(lists, codes))
        lists = saved(after.unionByName(alone.join(after, "node", "left_anti")))
        sizes = lists.agg(F.sum(F.length("fresh")), F.sum(F.length(F.expr("replace(cast(fresh as string), '\\0', '')")))).first()
        if not sizes[0] or sizes[1] <= SETTLED * sizes[0]:
            break
    return lists


def graph_of(codes: DataFrame) -> DataFrame:
    """node, code, ids, codes: each node's own code and the ids and codes on its list, packed; in ``PIECES``
    buckets by node, so that what asks for nodes is brought to them and the graph itself stays."""
    lists = neighbour_lists(codes)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "block"):
            for nodes, codes, _, places, ids, _ in _lists_of(table):
                for a in range(0, len(places), 256):
                    own = slice(a, a + 256)
                    columns = (nodes[places[own]], [codes[k] for k in places[own]], [nodes[x].tobytes() for x in ids[own]], [b"".join([codes[k] for k in x.tolist()]) for x in ids[own]])
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["node", "code", "ids", "codes"])

    return saved_buckets(_blocks(lists, codes).mapInArrow(gather, "node long, code binary, ids binary, codes binary"), "node", PIECES)


def _walked(queries: DataFrame, graph: DataFrame, entries: DataFrame, pool: int) -> DataFrame:
    """(query, node): the pool of every row (query, node, code) of ``queries`` at the end of its walk from
    that node of the graph and from the few of ``entries``."""
    state_kind = "query long, code binary, ids binary, scores binary, asked binary"
    empty = F.lit(b"")
    state = queries.select("query", "code", empty.alias("ids"), empty.alias("scores"), empty.alias("asked"))
    asks = queries.select("query", F.col("code").alias("sought"), "node")
    longest = queries.sparkSession.sparkContext.broadcast([tuple(r) for r in entries.collect()])  # ENTRIES rows

    def answer(batches: Iterator[pa.RecordBatch], more: list[tuple] | None = None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            rows = zip(*(batch[c].to_pylist() for c in ("query", "sought", "node", "code", "ids", "codes")))
            for query, sought, node, code, ids, codes in (x for row in rows for x in (row, *((*row[:2], *e) for e in more or ()))):
                if len(code) != len(sought):
                    continue  # vectors of another length
                raw = np.frombuffer(code + codes, np.int16).reshape(-1, len(code) // 2)
                x = _decoded(raw)
                near = x[:, :-1] @ _decoded([sought])[0, :-1] * x[:, -1]
                out[0].append(query)
                out[1].append(np.append([node], np.frombuffer(ids, np.int64)).astype(np.int64).tobytes())
                out[2].append(near.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.binary()))], ["query", "ids", "scores"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "query"):
            query = table["query"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])).tolist()
            columns = {c: table[c].to_pylist() for c in ("code", "ids", "scores", "asked")}
            out: list[tuple] = []
            for a, b in zip(starts, [*starts[1:], len(query)]):
                code = next(c for c in columns["code"][a:b] if c is not None)
                ids, scores = np.frombuffer(b"".join(columns["ids"][a:b]), np.int64), np.frombuffer(b"".join(columns["scores"][a:b]), np.float32)
                asked = np.frombuffer(b"".join(x for x in columns["asked"][a:b] if x is not None), np.int64)
                ids, first = np.unique(ids, return_index=True)
                best = np.lexsort((ids, -scores[first]))[:pool]
                ids, scores = ids[best], scores[first][best]
                todo = ids[~np.isin(ids, asked)]
                out.append((query[a], code, ids.tobytes(), scores.tobytes(), np.append(asked, todo).tobytes(), todo.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())))], ["query", "code", "ids", "scores", "asked", "todo"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return answer((b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)), longest.value)

    step = first
    while True:
        met = asks.join(graph, "node").select("query", "sought", "node", "code", "ids", "codes")
        news = met.mapInArrow(step, "query long, ids binary, scores binary").withColumns({"code": F.lit(None).cast("binary"), "asked": F.lit(None).cast("binary")})
        both = state.select("query", "code", "ids", "scores", "asked").unionByName(news).repartition("query").sortWithinPartitions("query")
        state = saved(both.mapInArrow(merge, f"{state_kind}, todo array<long>"))
        asks, step = state.select("query", F.col("code").alias("sought"), F.explode("todo").alias("node")), answer
        if asks.isEmpty():
            break

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["ids"].to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch["query"].to_numpy(), [len(x) // 8 for x in ids])), pa.array(np.frombuffer(b"".join(ids), np.int64))], ["query", "node"])

    return state.select("query", "ids").mapInArrow(candidates, "query long, node long")


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id fulfils the condition ``is_query`` (of column
    ``query_id``) the ``k`` rows of other ids with the largest inner product found, ties to the smaller id.

    Vectors that are null, empty or zero or hold a null or non-finite component take no part, nor do rows
    without an id; vectors of different length are not compared. Rows that repeat id and vector are
    one; an id with several vectors is several queries in one, whose best is returned, and as many
    candidates. A query has fewer than ``k`` rows only if there are not so many. An empty table gives
    no rows. Only the two columns are read, so others cannot clash.
    """
    nodes = nodes_of(vectors, id_col, vector_col, k + 1)
    codes = numbered(coded(nodes))
    graph = graph_of(codes)
    rows = vectors.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("vector")).where(is_query & usable(F.col("vector"))).distinct()
    own = saved(rows.join(nodes.select("vector", "node"), "vector").withColumn("query", F.xxhash64("query_id", "node")))
    longest = F.broadcast(codes.orderBy(F.desc("size"), "node").limit(ENTRIES).select("node"))
    numbers = codes.select("vec", "node")
    starts = own.select("query", F.col("node").alias("vec")).join(codes.select("vec", "node", "code"), "vec").drop("vec")
    pools = _walked(starts, graph, graph.join(longest, "node").select("node", "code", "ids", "codes"), max(POOL, 2 * k))
    pools = pools.join(numbers, "node").select("query", F.col("vec").alias("node"))
    pairs = pools.join(own.select("query", "query_id", F.col("vector").alias("sought")), "query").join(nodes.select("node", "vector", "ids"), "node")
    product = F.aggregate(F.zip_with("sought", "vector", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    scored = pairs.select("query_id", product.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id").distinct()
    best = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_nn_descent(spark, sf_dir: str) -> DataFrame:
    """``nearest`` of all ``embeddings`` for the ids divisible by 20; every case is stated there."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("query_id") % 20 == 0)
