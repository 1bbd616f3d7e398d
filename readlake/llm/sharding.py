"""K-d tree sharding: recursive weighted splits along the widest metadata dimension.

Every point has integer coordinates of ``BITS`` bits. A node is split where the weight on its
left comes nearest to the share of its left leaves; the place is found by distributed radix
descent, ``STEP`` bits at a time. The driver sees one row of each node, and what it decides goes
back as a small table of nodes, so a tree may have very many leaves; no window has more than
``2**STEP`` rows of a node, at any size of the input.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import each_copy, join_hot, saved, whole_text

BITS, STEP = 20, 15
#: A group of equal texts stays together unless it weighs more than this part of a shard.
GROUP_PART = 4
#: Rows of one block when slots are numbered.
BLOCK_ROWS = 100_000


def _node_table(spark: SparkSession, rows: Iterable[dict], fields: str) -> DataFrame:
    """Rows that the driver has decided, one a node, as a table to broadcast."""
    text = json.dumps(list(rows))
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<node:long,{fields}>>"))))


def kd_leaves(points: DataFrame, dims: Sequence[str], weight: str, ties: Sequence[str], n_leaves: int) -> DataFrame:
    """``points`` with a column ``shard`` from 0 to ``n_leaves - 1``.

    ``dims`` are non-null integer columns in [0, 2**20); ``ties`` are two such columns that order
    the points of equal coordinate (points equal there too are never parted). Empty input gives
    empty output; with fewer distinct points than leaves some leaves stay empty. Of dimensions of
    equal extent the first is taken, of two cuts equally near the one with more on the left.
    """
    spark = points.sparkSession
    tail = F.shiftleft(F.col(ties[0]).cast("long"), BITS).bitwiseOR(F.col(ties[1]).cast("long"))
    keys = [F.shiftleft(F.col(d).cast("long"), 2 * BITS).bitwiseOR(tail) for d in dims]
    at, leaves = points.withColumn("node", F.lit(0).cast("long")), {0: n_leaves}
    whole: list[int] | None = None
    while open_nodes := {k: n for k, n in leaves.items() if n > 1}:
        extents = [F.max(d) - F.min(d) for d in dims]
        inner = at.join(_node_table(spark, [{"node": k, "n": n} for k, n in open_nodes.items()], "n:int"), "node", "left_semi")
        rows = inner.groupBy("node").agg(F.sum(weight).alias("w"), *(x.alias(f"e{i}") for i, x in enumerate(extents))).collect()
        found = {r["node"]: r for r in rows}
        leaves = {k: n if k in found else 1 for k, n in leaves.items()}  # an empty node has nothing to split
        open_nodes = {k: n for k, n in open_nodes.items() if k in found}
        if not open_nodes:
            break
        whole = whole or [max(1, found[0][f"e{i}"]) for i in range(len(dims))]
        widest = {k: max(range(len(dims)), key=lambda i, k=k: (found[k][f"e{i}"] / whole[i], -i)) for k in open_nodes}
        target = {k: found[k]["w"] * (n // 2) / n for k, n in open_nodes.items()}
        key = F.coalesce(*(F.when(F.col("dim") == i, own) for i, own in enumerate(keys)))
        keyed = at.join(_node_table(spark, [{"node": k, "dim": widest[k]} for k in open_nodes], "dim:int"), "node").select("node", F.col(weight).alias("w"), key.alias("key"))
        prefix, below, here = dict.fromkeys(open_nodes, 0), dict.fromkeys(open_nodes, 0), {}
        for shift in range(3 * BITS - STEP, -1, -STEP):
            state = _node_table(spark, [{"node": k, "prefix": prefix[k], "below": below[k], "target": target[k]} for k in open_nodes], "prefix:long,below:long,target:double")
            inside = keyed.join(state, "node").where(F.shiftright("key", shift + STEP) == F.col("prefix"))
            bins = inside.groupBy("node", "below", "target", F.shiftright("key", shift).alias("bin")).agg(F.sum("w").alias("w"))
            run = F.sum("w").over(W.partitionBy("node").orderBy("bin")) + F.col("below")
            first = bins.withColumn("run", run).where(F.col("run") >= F.col("target")).groupBy("node").agg(F.min(F.struct("bin", "run", "w")).alias("x"))
            for r in first.collect():
                k, x = r["node"], r["x"]
                prefix[k], below[k], here[k] = x["bin"], x["run"] - x["w"], x["w"]
        #: The last key on the left: the one that crosses the target, or the one before it if that is nearer.
        last = {k: prefix[k] if below[k] + here[k] - target[k] <= target[k] - below[k] else prefix[k] - 1 for k in open_nodes}
        cuts = _node_table(spark, [{"node": k, "dim": widest[k], "last": last[k], "more": n // 2} for k, n in open_nodes.items()], "dim:int,last:long,more:long")
        moved = F.when(key > F.col("last"), F.col("node") + F.col("more")).otherwise(F.col("node"))
        at = saved(at.join(cuts, "node", "left").withColumn("node", moved).drop("dim", "last", "more"))
        leaves = {k: n for k, n in leaves.items() if k not in open_nodes} | {k: n // 2 for k, n in open_nodes.items()} | {k + n // 2: n - n // 2 for k, n in open_nodes.items()}
    return at.withColumn("shard", F.col("node").cast("int")).drop("node")


def number_slots(df: DataFrame, shard: str, order: Sequence[str], n_rows: int) -> DataFrame:
    """A gapless ``slot`` from 0 in each shard, numbered in hashed blocks so that no task holds a shard."""
    block = F.pmod(F.xxhash64(*order), F.lit(max(1, n_rows // BLOCK_ROWS + 1)))
    df = df.withColumn("block", block)
    before = F.sum("n").over(W.partitionBy(shard).orderBy("block")) - F.col("n")
    starts = df.groupBy(shard, "block").agg(F.count(F.lit(1)).alias("n")).select(shard, "block", before.alias("start"))
    inside = F.row_number().over(W.partitionBy(shard, "block").orderBy(*order)) - 1
    return df.withColumn("inside", inside).join(starts, [shard, "block"]).withColumn("slot", F.col("start") + F.col("inside")).drop("start", "inside", "block")


def shard_documents(docs: DataFrame, n_shards: int | None = 8, target_bytes: int | None = None) -> DataFrame:
    """Documents into ``n_shards`` shards, or as many as have at most ``target_bytes`` on the average, of
    near equal bytes, neighbours in (source, language, length) together. Returns doc_id, size,
    text_crc32, law, shard, slot, grown_shard.

    A null text counts as empty; size is its UTF-8 bytes plus 1. Null source and language are
    values of their own; as names have no distance, their hashes are the coordinates. Rows of equal
    text go to one shard under the metadata of the group's smallest values, except groups above
    ``1 / GROUP_PART`` of a shard, which near equal shards may have to part: those are dealt by
    doc_id. Repeated rows count each and are interchangeable; slots follow doc_id, checksum and copy
    within hashed blocks; an empty table gives no rows. A very long text is never parted, so its
    shard may be as much larger. Columns other than doc_id, text, source and lang are not read.
    """
    text = whole_text()
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"), "source", "lang")
    base = saved(each_copy(base))
    groups = base.groupBy("g").agg(F.count(F.lit(1)).alias("g_rows"), F.sum("size").alias("g_size"), F.min("source").alias("g_source"), F.min("lang").alias("g_lang"), F.max("size").alias("g_each"))
    total, n_rows = base.agg(F.sum("size"), F.count(F.lit(1))).first()
    if target_bytes is not None:
        n_shards = max(1, -(-(total or 0) // target_bytes))
    code = lambda c: F.coalesce(F.shiftright(F.crc32(F.col(c).cast("binary")), 12), F.lit(0))
    top = F.lit((1 << BITS) - 1)
    heavy = F.col("g_size") > (total or 0) / (n_shards * GROUP_PART)
    points = join_hot(base.drop("source", "lang"), groups, "g", "g_rows", n_rows).select(
        "doc_id", "size", "text_crc32", "copy",
        code("g_source").alias("x0"), code("g_lang").alias("x1"), F.least(F.floor(F.log2(F.col("g_each").cast("double")) * (1 << 14)), top).alias("x2"),
        F.col("g").bitwiseAND(top).alias("t0"), F.when(heavy, F.xxhash64("doc_id", "copy").bitwiseAND(top)).otherwise(F.lit(0)).alias("t1"),
    )
    leaves = kd_leaves(saved(points), ["x0", "x1", "x2"], "size", ["t0", "t1"], n_shards)
    out = number_slots(leaves.select("doc_id", "size", "text_crc32", "copy", "shard"), "shard", ["doc_id", "text_crc32", "copy"], n_rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_kd_tree_shards(spark, sf_dir: str) -> DataFrame:
    """``shard_documents`` of all ``documents`` into eight; every case is stated there."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
