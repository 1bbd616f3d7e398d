"""Merkle manifest of a dataset by a butterfly exchange of subtree roots.

Leaves are numbered by source and id, and every ``FANOUT ** INNER`` of them, aligned, are a part that
hashes its own subtree alone. Then the aligned groups of ``FANOUT`` subtrees swap their roots, round
by round: every part of a group gets all roots of the group, hashes their parent redundantly, and
so has both the root of the larger subtree and the siblings that its proofs need at that level.
After the last round every part knows the root and its whole upper proof, and nothing is sent down.

A subtree of many parts swaps in as many lanes, a part in each, so a part gets one message of each
sibling subtree; the parts of a smaller subtree serve several lanes. A round is thus one shuffle of
at most ``FANOUT`` short rows a part, whatever the sizes of the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

#: Nodes of a run, and levels of the tree inside a part: a part has ``FANOUT ** INNER`` leaves.
FANOUT, INNER = 16, 2
#: With this many sources or fewer, their table is broadcast.
FEW_SOURCES = 10_000
_SPLIT = "struct<left:string,right:string>"


def digest(value: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8."""
    return F.sha2(value.cast("binary"), 256)


def _field(value: Column) -> Column:
    """``-`` if null, else the bytes of the value, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def _split(nodes: Column, place: Column) -> Column:
    """What stands left and right of a place (from 0) of an array of digests, each in one string."""
    left, right = F.slice(nodes, F.lit(1), place), F.slice(nodes, place + 2, F.greatest(F.size(nodes) - place - 1, F.lit(0)))
    return F.struct(_joined(left).alias("left"), _joined(right).alias("right")).cast(_SPLIT)


def _parents(nodes: Column) -> Column:
    """The next level of an array of digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: digest(_joined(F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT)))))


def leaves_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and the leaf of the tampered text, null where nothing was tampered with."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaf = lambda text: digest(F.concat(*(_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _field(text)))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        leaf(F.col("text")).alias("leaf"),
        F.when(hit, leaf(F.translate("text", upper, lower))).alias("tampered"),
    )


def numbered(leaves: DataFrame) -> DataFrame:
    """The leaves with their place in their source (``idx``, from 0) and its number of leaves (``n``):
    by doc_id, null first, then by leaf; equal rows stand side by side in any order.

    Range partitions are numbered each for itself and start where those before end, so no source is
    in one task; a number of its own tells equal rows apart, so a row that repeats very often is
    dealt over several."""
    own = saved(leaves.withColumn("_row", F.monotonically_increasing_id()))
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("_row")]
    dealt = saved(own.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy("_part", "source").orderBy(*order[1:])
    rows = dealt.withColumn("_at", F.row_number().over(inside).cast("long") - 1)
    per = dealt.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    by_source = W.partitionBy("source")
    before = F.sum("_n").over(by_source.orderBy("_part")) - F.col("_n")
    per = per.select(F.col("source").alias("_source"), F.col("_part").alias("_p"), before.alias("_before"), F.sum("_n").over(by_source).alias("n"))
    met = rows.join(per, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_p")))
    return met.select("doc_id", "source", "leaf", "tampered", (F.col("_at") + F.col("_before")).alias("idx"), "n")


def _with_levels(parts: DataFrame) -> DataFrame:
    """Parts with the digests of the levels inside them: ``level0``, the sorted leaves, and so on, and the ``top``.
    A level only exists where the source has several nodes below it; else it is that below."""
    level = F.transform("leaves", lambda x: x["leaf"])
    for k in range(INNER):
        parts = parts.withColumn(f"level{k}", level)
        level = F.when(F.col("n") > FANOUT**k, _parents(F.col(f"level{k}"))).otherwise(F.col(f"level{k}"))
    return parts.withColumn("top", level)


def parts_of(rows: DataFrame) -> DataFrame:
    """A row a part: source, n, part (its place in the source), root, and its sorted leaves. Siblings are left
    out: they are some 15 digests a leaf and level, and would be held for thousands of parts at once."""
    leaf = F.struct("idx", "doc_id", "leaf", "tampered")
    parts = rows.withColumn("part", F.expr(f"idx div {FANOUT**INNER}")).groupBy("source", "n", "part").agg(F.array_sort(F.collect_list(leaf)).alias("leaves"))
    own = F.transform("leaves", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["leaf"].alias("leaf"), x["tampered"].alias("tampered")))
    return _with_levels(parts).select("source", "n", "part", F.col("top")[0].alias("root"), own.alias("leaves"))


def _with_inner(parts: DataFrame) -> DataFrame:
    """The other columns and a row a leaf: ``x``, the leaf with its siblings of the levels inside its part, from below."""
    names = [f"level{k}" for k in range(INNER)]
    rest = [c for c in parts.columns if c not in ("n", "leaves")]
    each = _with_levels(parts).select(*rest, "n", *names, F.posexplode("leaves").alias("place", "x"))
    proof = F.array().cast(f"array<{_SPLIT}>")
    for k, name in enumerate(names):
        at = F.floor(F.col("place") / FANOUT**k).cast("int")
        run = F.slice(F.col(name), F.floor(at / FANOUT).cast("int") * FANOUT + 1, F.lit(FANOUT))
        proof = F.concat(proof, F.when(F.col("n") > FANOUT**k, F.array(_split(run, at % FANOUT))).otherwise(F.array().cast(f"array<{_SPLIT}>")))
    return each.select(*rest, F.struct("x.doc_id", "x.leaf", "x.tampered", proof.alias("inner")).alias("x"))


def _swap(parts: DataFrame, tree: list[str]) -> DataFrame:
    """One round over the parts whose trees still have several subtrees. Each row has its subtree's
    place (``at``), its own place among the subtree's parts (``member`` of ``members``), the lanes of its
    group and the parts in the subtrees left of it (``before``); a part serves the lanes that are
    its member number modulo ``members``."""
    lanes = F.explode(F.sequence(F.col("member"), F.col("lanes") - 1, F.col("members")))
    sent = parts.select(*tree, F.expr(f"at div {FANOUT}").alias("group"), (F.col("at") % FANOUT).cast("int").alias("digit"), lanes.alias("lane"), "root", "key", "before", F.col("member").alias("own"), F.col("proof"))
    # the proof stays with the part itself: only what goes to its own lane carries it
    mine = F.col("lane") == F.col("own")
    sent = sent.withColumns({"key": F.when(mine, F.col("key")), "proof": F.when(mine, F.col("proof"))})
    met = sent.groupBy(*tree, "group", "lane").agg(F.array_sort(F.collect_list(F.struct("digit", "root", "key", "before", "own", "proof"))).alias("met"))
    roots = F.transform("met", lambda x: x["root"])
    met = met.withColumns({"roots": roots}).withColumn("parent", digest(_joined(F.col("roots"))))
    each = met.select(*tree, "group", "roots", "parent", F.posexplode("met").alias("place", "x")).where("x.key is not null")
    proof = F.concat(F.col("x.proof"), F.array(_split(F.col("roots"), F.col("place"))))
    return each.select(*tree, F.col("x.key").alias("key"), F.col("group").alias("at"), (F.col("x.before") + F.col("x.own")).alias("member"), F.col("parent").alias("root"), proof.alias("proof"))


def _rounds(count: int) -> int:
    """Levels until ``count`` nodes are one."""
    n = 0
    while count > 1:
        count, n = -(-count // FANOUT), n + 1
    return n


def exchanged(parts: DataFrame) -> DataFrame:
    """The parts (source, n, part, root) with subroot, root and the siblings of all levels above them
    (``upper``, those up to the subroot first)."""
    size = FANOUT**INNER
    state = saved(parts.select("source", F.expr(f"(n - 1) div {size} + 1").alias("units"), "part", "root").withColumn("key", F.struct("source", "part")).withColumn("proof", F.array().cast(f"array<{_SPLIT}>")))
    most = state.agg(F.max("units")).first()[0] or 0
    state = state.withColumnsRenamed({"part": "at"}).withColumn("member", F.lit(0).cast("long"))
    done = None
    for k in range(_rounds(most)):  # inside the sources: a full subtree has FANOUT ** k parts, the last one the rest
        full, units = F.lit(FANOUT**k).cast("long"), F.expr(f"(units - 1) div {FANOUT**k}L + 1")
        over = state.where(units == 1)
        done = over if done is None else done.unionByName(over)
        members = F.least(full, F.col("units") - F.col("at") * full)
        lanes = F.least(full, F.col("units") - F.expr(f"at div {FANOUT}") * FANOUT * full)
        sent = state.where(units > 1).withColumns({"members": members, "lanes": lanes, "before": (F.col("at") % FANOUT) * full})
        state = saved(_swap(sent, ["source", "units"]))
    done = state if done is None else done.unionByName(state)
    done = done.select("source", "units", "key", F.col("member"), "root", "proof")
    # above the sources: what stands at the k-th level is a run of FANOUT ** k sources
    per = done.groupBy("source").agg(F.max("units").alias("units"), F.max("root").alias("subroot"))
    ranked = saved(_ranked(per))
    sources = ranked.count()
    rounds = _rounds(sources)
    bounds = _lanes(ranked, rounds)
    if sources <= FEW_SOURCES:
        bounds = F.broadcast(bounds)
    state = done.withColumnRenamed("source", "_source").join(bounds.drop("units"), F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    state = saved(state.select("key", F.col("root").alias("subroot"), "root", "proof", F.col("rank").alias("at"), "member", "levels"))
    for k in range(rounds):
        own = F.col("levels")[k]
        sent = state.withColumns({"members": own["members"], "lanes": own["lanes"], "before": own["before"], "key": F.struct("key", "subroot", "levels")})
        state = _swap(sent, [])
        state = saved(state.select("key.key", "key.subroot", "key.levels", "at", "member", "root", "proof"))
    return state.select("key.source", "key.part", "subroot", "root", F.col("proof").alias("upper"))


def _ranked(per: DataFrame) -> DataFrame:
    """Sources with their rank from 0, null first, then by their bytes; numbered in range partitions."""
    order = F.col("source").asc_nulls_first()
    dealt = saved(per.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    rows = dealt.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(order)).cast("long") - 1)
    return rows.join(F.broadcast(counts), "_part").select("source", "units", (F.col("_at") + F.col("_before")).alias("rank"))


def _lanes(ranked: DataFrame, rounds: int) -> DataFrame:
    """The sources with, for each round, the parts of the subtree that they are in then (``members``),
    the lanes of its group (those of its largest subtree) and the parts of the group left of it."""
    out = ranked.withColumn("levels", F.array().cast("array<struct<members:bigint,lanes:bigint,before:bigint>>"))
    for k in range(rounds):
        unit, group = F.expr(f"rank div {FANOUT**k}L"), F.expr(f"rank div {FANOUT ** (k + 1)}L")
        subtrees = ranked.groupBy(group.alias("_group"), unit.alias("_unit")).agg(F.sum("units").alias("members"))
        each = W.partitionBy("_group")  # at most FANOUT subtrees
        level = F.struct("members", F.max("members").over(each).alias("lanes"), (F.sum("members").over(each.orderBy("_unit")) - F.col("members")).alias("before"))
        subtrees = subtrees.select("_unit", level.alias("_level"))
        out = out.withColumn("_own", unit).join(subtrees, F.col("_own") == F.col("_unit")).withColumn("levels", F.concat("levels", F.array("_level"))).drop("_own", "_unit", "_level")
    return out


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row: its leaf and proof,
    and the root that a tampered copy of the row folds to with the siblings of the original.

    A null field is hashed as ``-``, an empty text as ``0:``; a very long text is hashed whole. Leaves of
    a source ascend by doc_id, null first, those that share one by their digest; repeated rows have
    a leaf and a proof each. Rows without an id are never tampered with. The only document of the
    only source is the root itself, and its proof that of no sibling. An empty table gives no rows.
    Only doc_id, source, lang, n_chars and text are read, so further columns cannot clash.
    """
    parts = saved(parts_of(numbered(leaves_of(docs))))
    upper = exchanged(parts).withColumnsRenamed({"source": "_source", "part": "_part", "root": "top"})
    met = parts.drop("root").join(upper, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    rows = _with_inner(met.select("source", "n", "subroot", F.col("top").alias("root"), "upper", "leaves"))
    proof = F.concat("x.inner", "upper")
    fold = F.aggregate(proof, F.coalesce("x.tampered", "x.leaf"), lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))
    siblings = F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")
    out = rows.select("x.doc_id", "source", "x.leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_butterfly_manifest(spark, sf_dir: str) -> DataFrame:
    """``manifest`` of all ``documents``, which states what nulls, ties and repeated rows give."""
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
