"""The bench tables seen as reads, alignments, transcripts and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.functions.sequences import ascii_upper
from readlake.sources.tables import spread

#: What orders the alignments of one read.
TIES = ("line", "supplier", "price")
FLAGS = {("A", "F"): 0, ("A", "O"): 16, ("N", "F"): 256, ("N", "O"): 272, ("R", "F"): 4, ("R", "O"): 2064}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with part: every line is an alignment of its order to its part."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") * 10 + 100).alias("transcript_length"))
    lines = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    flag = F.lit(None).cast("int")
    for (a, b), v in FLAGS.items():
        flag = F.when((F.col("l_returnflag") == a) & (F.col("l_linestatus") == b), v).otherwise(flag)
    size, disc = F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int")
    own = lines.select(F.col("l_orderkey").alias("read_id"), F.col("l_partkey").alias("transcript_id"), F.round(F.col("l_tax") * 100).cast("int").alias("mapq"), size.alias("read_length"), disc.alias("I"), F.col("l_linenumber").alias("D"), (F.col("l_linenumber") * 10).alias("start"), flag.alias("flag"), "transcript_length", F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("dataset"))
    own = own.withColumn("aligned_length", F.expr("cast(read_length * (100 - I) div 100 as int)"))
    return own.withColumns({"end": F.col("start") + F.col("aligned_length"), "M": F.col("aligned_length"), "NM": F.when(F.col("I") != 0, F.col("I") + F.col("D"))})


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    start = (k * 7) % 900
    return p.select(k.alias("transcript_id"), (k % 25).alias("chrom"), start.alias("start"), (start + F.col("p_size") * 4).alias("end"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), (F.col("p_size") * 10 + 100).alias("length"), k.alias("ord"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    start = (k * 13) % 1000
    return e.select(k.alias("read_id"), (F.col("user_id") % 25).alias("chrom"), start.alias("start"), (start + F.floor("value") + 1).alias("end"))


def line_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a record of its order, so a read has several, and some that are equal."""
    rows, k = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    start = (k * 7) % 900
    return rows.select((F.col("l_orderkey") % 50000).alias("read_id"), (k % 25).alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    user = F.col("user_id").cast("string")
    header = F.when(k % 3 == 0, F.concat(F.lit("@r"), k.cast("string"), F.lit(" CB:Z:"), user, F.lit(" UB:Z:"), "event_type")).when(k % 3 == 1, F.concat(F.lit("@"), user, F.lit("_"), "event_type", F.lit("#"), k.cast("string"))).otherwise(F.concat(F.lit("@"), user))
    return e.select(k.alias("read_id"), header.alias("header"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a sequence; a null text is empty. One file of documents may be a single piece."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("seq_id"), ascii_upper(F.coalesce("text", F.lit(""))).alias("seq"))


def counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """expected and observed counts of customers and parts."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("barcode"))
    rows = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").withColumn("transcript_id", F.col("l_partkey") % 50)
    each = lambda c, name: rows.where(c).groupBy("barcode", "transcript_id").agg(F.count(F.lit(1)).alias(name))
    return each(F.col("l_linestatus") == "O", "expected_count"), each(F.col("l_returnflag") == "R", "observed_count")


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).select("read_id", "transcript_id", F.col("supplier").alias("barcode"), F.col("read_length").alias("original_length"), F.col("aligned_length").alias("sampled_length"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed embedding of each label as a profile; no label is a dataset of its own."""
    rows = table(spark, sf_dir, "embeddings").select(F.coalesce(F.col("label").cast("string"), F.lit("none")).alias("dataset"), F.posexplode("embedding").alias("bin", "x"))
    return rows.groupBy("dataset", "bin").agg((F.sum(F.floor(F.col("x").cast("double") * 1000000).cast("long")).cast("double") / 1000000.0).alias("value"))


SQL = {
    "aln": """SELECT l_orderkey AS read_id, l_partkey AS transcript_id, CAST(round(l_tax * 100) AS INTEGER) AS mapq,
        CAST(l_quantity AS INTEGER) AS read_length, CAST(round(l_discount * 100) AS INTEGER) AS i, l_linenumber AS d, l_linenumber * 10 AS s,
        CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 0 WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 16
             WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 256 WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 272
             WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 4 WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 2064 END AS flag,
        p_size * 10 + 100 AS tl, l_linenumber AS line, l_suppkey AS supplier, l_extendedprice AS price, l_returnflag AS dataset,
        (CAST(l_quantity AS INTEGER) * (100 - CAST(round(l_discount * 100) AS INTEGER))) // 100 AS al,
        l_linenumber * 10 + (CAST(l_quantity AS INTEGER) * (100 - CAST(round(l_discount * 100) AS INTEGER))) // 100 AS e
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "met": """SELECT *, CASE WHEN read_length = 0 THEN 0 ELSE al::DOUBLE / read_length END AS fraction, CASE WHEN tl = 0 THEN 0 ELSE (e - s)::DOUBLE / tl END AS coverage,
        CASE WHEN i = 0 THEN NULL WHEN al + i + d = 0 THEN 0 ELSE (al + i + d - (i + d))::DOUBLE / (al + i + d) END AS accuracy
        FROM aln WHERE (flag & 4) = 0""",
    "prim": """SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY mapq DESC, fraction DESC, line, supplier, price) = 1""",
    "tx": """SELECT p_partkey AS transcript_id, p_partkey % 25 AS chrom, (p_partkey * 7) % 900 AS s, (p_partkey * 7) % 900 + p_size * 4 AS e,
        CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_size * 10 + 100 AS len FROM part""",
    "ivl": """SELECT event_id AS read_id, user_id % 25 AS chrom, (event_id * 13) % 1000 AS s, (event_id * 13) % 1000 + CAST(floor("value") AS BIGINT) + 1 AS e FROM events""",
    "lin": """SELECT l_orderkey % 50000 AS read_id, l_partkey % 25 AS chrom, (l_partkey * 7) % 900 AS s, (l_partkey * 7) % 900 + CAST(l_quantity AS BIGINT) AS e FROM lineitem""",
    "hdr": """SELECT event_id AS read_id, CAST(user_id AS VARCHAR) AS barcode,
        CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_type END AS umi,
        CASE WHEN event_id % 3 = 0 THEN 'cb_tag' WHEN event_id % 3 = 1 THEN 'underscore' ELSE 'other' END AS fmt FROM events""",
    "ex": """SELECT o_custkey AS barcode, l_partkey % 50 AS transcript_id, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'O' GROUP BY ALL""",
    "ob": """SELECT o_custkey AS barcode, l_partkey % 50 AS transcript_id, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY ALL""",
    "cmp": """SELECT coalesce(ex.barcode, ob.barcode) AS barcode, coalesce(ex.transcript_id, ob.transcript_id) AS transcript_id, coalesce(ex.n, 0) AS ec, coalesce(ob.n, 0) AS oc
        FROM ex FULL OUTER JOIN ob ON ex.barcode = ob.barcode AND ex.transcript_id = ob.transcript_id""",
    "trk": """SELECT read_id, transcript_id, supplier AS barcode, read_length AS ol, al AS sl FROM aln""",
    "seqs": """SELECT doc_id AS seq_id, translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS s FROM documents""",
    "kmer": """SELECT *, len(list_distinct(list_transform(range(1, n - k + 2), lambda i: substr(s, i, k)))) AS kmers FROM (SELECT seq_id, s, length(s) AS n, CAST(CASE WHEN length(s) > 4 THEN least(4, length(s) // 2) ELSE 1 END AS INTEGER) AS k FROM seqs)""",
    "chars": """SELECT seq_id, length(s) AS n, unnest(string_split(s, '')) AS c, unnest(range(length(s))) AS p FROM seqs WHERE length(s) > 0""",
    "arms": """SELECT seq_id, max(h) FILTER (p < n - 30) AS h, count(*) FILTER (p < n - 15 AND g > 10) AS g FROM (
        SELECT seq_id, n, p, sum(hit) OVER (o ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS h, sum(CAST(c = 'G' AS INTEGER)) OVER (o ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS g FROM (
            SELECT *, CAST(c IN ('A', 'C', 'G', 'T') AND c = translate(lead(c, 20) OVER (PARTITION BY seq_id ORDER BY p), 'ACGT', 'TGCA') AS INTEGER) AS hit FROM chars)
        WINDOW o AS (PARTITION BY seq_id ORDER BY p)) GROUP BY 1""",
    "feat": """SELECT seq_id, CAST(n AS INTEGER) AS length, {gc(s)} AS gc_content, {gc(left(s, 50))} AS five_prime_gc, {gc(right(s, 50))} AS three_prime_gc,
        CASE WHEN n > 0 THEN kmers::DOUBLE / least(4 ** k, n - k + 1) ELSE 0 END AS complexity, CASE WHEN n > 30 THEN h / 10.0::DOUBLE ELSE 0 END AS hairpin_potential,
        CASE WHEN n >= 15 THEN g::DOUBLE / (n - 14) ELSE 0 END AS g_quadruplex_potential, {run} AS homopolymer_ratio, {skew} AS gc_skew FROM kmer LEFT JOIN arms USING (seq_id)""",
    "local_": """SELECT seq_id, w, any_value(n) AS n, sum(m) FILTER (c IN ('G', 'C')) AS gc, sum(m) AS size, abs(log2(sum(m)) - sum(m * log2(m)) / sum(m)) AS entropy FROM (SELECT seq_id, p // 100 AS w, c, any_value(n) AS n, count(*) AS m FROM chars GROUP BY ALL) GROUP BY 1, 2""",
    "three": """SELECT seq_id, w, kmer, count(*)::DOUBLE / greatest(1, least(100, any_value(n) - w * 100) - 2) AS share FROM (
        SELECT seq_id, n, p, p // 100 AS w, c || lead(c) OVER o || lead(c, 2) OVER o AS kmer FROM chars WINDOW o AS (PARTITION BY seq_id ORDER BY p))
        WHERE (p + 2) // 100 = w AND regexp_full_match(kmer, '[ACGT]{3}') GROUP BY 1, 2, 3""",
    "events_": """SELECT transcript_id, pos, sum(step) AS step FROM (
        SELECT a.transcript_id, greatest(a.s, 0) AS pos, 1 AS step FROM aln a JOIN tx USING (transcript_id) WHERE least(a.e, len) > greatest(a.s, 0)
        UNION ALL SELECT a.transcript_id, least(a.e, len), -1 FROM aln a JOIN tx USING (transcript_id) WHERE least(a.e, len) > greatest(a.s, 0)
        UNION ALL SELECT transcript_id, 0, 0 FROM tx UNION ALL SELECT transcript_id, len, 0 FROM tx) GROUP BY ALL""",
    "runs": """SELECT * FROM (SELECT transcript_id, pos AS seg_start, lead(pos) OVER w AS seg_end, CAST(sum(step) OVER w AS BIGINT) AS depth FROM events_ WINDOW w AS (PARTITION BY transcript_id ORDER BY pos)) WHERE seg_end IS NOT NULL""",
    "bins": """SELECT t.transcript_id, b.bin, t.len, coalesce(sum(greatest(0, least(r.seg_end, ((b.bin + 1) * t.len) // 20) - greatest(r.seg_start, (b.bin * t.len) // 20)) * r.depth)::DOUBLE / nullif(((b.bin + 1) * t.len) // 20 - (b.bin * t.len) // 20, 0), 0) AS v
        FROM tx t CROSS JOIN (SELECT range AS bin FROM range(20)) b JOIN runs r ON r.transcript_id = t.transcript_id GROUP BY t.transcript_id, b.bin, t.len""",
}

#: Parts of the SQL of sequences.
GC = "coalesce((length(x) - length(translate(x, 'GC', '')))::DOUBLE / nullif(length(x), 0), 0)"
RUN = "coalesce(coalesce(list_max(list_transform(regexp_extract_all(s, 'A+|C+|G+|T+'), lambda r: length(r))), 0)::DOUBLE / nullif(length(s), 0), 0)"
SKEW = "coalesce((length(replace(s, 'C', '')) - length(replace(s, 'G', '')))::DOUBLE / nullif(length(s) - length(translate(s, 'GC', '')), 0), 0)"


def gc_sql(x: str) -> str:
    return GC.replace("(x", f"({x}")


SQL["feat"] = SQL["feat"].replace("{gc(s)}", gc_sql("s")).replace("{gc(left(s, 50))}", gc_sql("left(s, 50)")).replace("{gc(right(s, 50))}", gc_sql("right(s, 50)")).replace("{run}", RUN).replace("{skew}", SKEW)

#: What each of them is made from.
_FROM = {"kmer": ["seqs"], "chars": ["seqs"], "arms": ["seqs", "chars"], "feat": ["seqs", "kmer", "chars", "arms"], "local_": ["seqs", "chars"], "three": ["seqs", "chars"], "met": ["aln"], "prim": ["aln", "met"], "cmp": ["ex", "ob"], "trk": ["aln"], "events_": ["aln", "tx"], "runs": ["aln", "tx", "events_"], "bins": ["aln", "tx", "events_", "runs"]}


def with_sql(*names: str) -> str:
    """WITH clause of the named bindings and all that they are made from, in order."""
    wanted = {x for n in names for x in (*_FROM.get(n, []), n)}
    return "WITH " + ", ".join(f"{k} AS ({SQL[k]})" for k in SQL if k in wanted) + " "
