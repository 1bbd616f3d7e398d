"""Secret scans with multipart credential linking, in Spark's own functions only.

Strong patterns stand alone. Weak parts (an account name or mail address, an opaque string, a host)
mean little by themselves: they are reported only where complementary parts lie within ``SCOPE`` code
points of each other in one document, found by an interval join on buckets of that width.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, spread, whole_text

#: (kind, pattern, group whose length counts, its least length), in the order that breaks ties.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Weak parts: kind, a quick test that goes before the pattern, pattern, group, least length, and
#: what a match must hold besides.
WEAK = (
    ("identifier", r"(?i)(?:user|login|account|_id)", r"""(?i)(?:access_key_id|client_id|account_id|username|user|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 1, 3, None),
    ("opaque", r"[A-Za-z0-9+/_-]{32}", r"[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32, r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"),
    ("email", r"@", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,24}", 0, 6, None),
    ("address", r"[0-9]\.[0-9]", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?", 0, 7, None),
    ("endpoint", r"://", r"""(?i)(?:https?|ftp|s3|jdbc:[a-z]+|mongodb|postgres|postgresql|mysql|redis|amqp)://[^\x20\x09-\x0D"'<>]+""", 0, 12, None),
)
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "opaque": "secret", "email": "identifier", "address": "endpoint", "endpoint": "endpoint"}
KINDS = [k for k, *_ in BASE] + [k for k, *_ in WEAK]
#: Code points between two parts of one credential at most.
SCOPE = 200
MASK = "[secret]"
#: Matches that one fold takes: places add up within pieces of so many, and then over the pieces.
PIECE = 256
_SPANS = "array<struct<start:int,kind_order:int,stop:int,kind:string>>"


def find_spans(text: Column, kind: str, pattern: str, group: int, least: int, holds: str | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has ``least`` code points or more:
    what stands between the matches and the matches themselves give the places by their lengths."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    parts = F.arrays_zip(F.split(text, pattern), hits, values)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + F.length(part["0"])
        stop = begin + F.coalesce(F.length(part["1"]), F.lit(0))
        good = F.length(part["2"]) >= least
        if holds:
            good = good & part["1"].rlike(holds)
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind_order"), stop.alias("stop"), F.lit(kind).alias("kind"))
        return F.struct(stop.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).cast(_SPANS).alias("out"))

    def shifted(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["kind_order"].alias("kind_order"), (s["stop"] + by).alias("stop"), s["kind"].alias("kind")))

    def over_pieces(parts: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / PIECE).cast("int"))
        folded = F.transform(numbers, lambda i: F.aggregate(F.slice(parts, i * PIECE + 1, F.lit(PIECE)), start, step))
        whole = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"))
        join = lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(shifted(x["out"], acc["at"]))).cast(f"array<{_SPANS}>").alias("out"))
        return F.aggregate(folded, whole, join, lambda acc: F.flatten(acc["out"]).cast(_SPANS))

    return F.transform(F.array(parts), over_pieces)[0]  # the matches are found once


def scan_parts(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, base spans and weak parts of every row."""
    rows = spread(docs.select("doc_id", whole_text().alias("text")))
    text, none = F.col("text"), F.array().cast(_SPANS)
    quick = {"access": text.contains("AKIA"), "endpoint": text.contains("://"), "email": text.contains("@")}
    found = {k: F.when(quick.get(k, text.rlike(p)), find_spans(text, k, p, g, n)).otherwise(none) for k, p, g, n in BASE}
    weak = {k: F.when(quick.get(k, text.rlike(q)), find_spans(text, k, p, g, n, holds)).otherwise(none) for k, q, p, g, n, holds in WEAK}
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.concat(*found.values()).alias("base"), F.concat(*weak.values()).alias("weak"))


def linked_parts(parts: DataFrame) -> DataFrame:
    """(doc_id, text_hash, linked): weak parts of a document with a complementary part in scope:
    an identifier or endpoint needs a secret, a secret needs an identifier or endpoint."""
    both = parts.where(F.size("weak") > 0).select("doc_id", "text_hash", F.explode(F.concat("weak", "base")).alias("s")).distinct()
    role = reduce(lambda out, k: F.when(F.col("s.kind") == k, ROLES[k]).otherwise(out), KINDS, F.lit(""))
    both = both.select("doc_id", "text_hash", "s", (role == "secret").alias("secret"), F.explode(F.array_distinct(F.transform(F.array(F.col("s.start"), F.col("s.stop")), lambda x: F.floor(x / SCOPE)))).alias("bucket"))
    weak = both.where(F.col("s.kind").isin([k for k, *_ in WEAK])).select("doc_id", "text_hash", "s", "secret", F.explode(F.array(*(F.col("bucket") + d for d in (-1, 0, 1)))).alias("bucket"))
    other = both.select(F.col("doc_id").alias("o_doc"), F.col("text_hash").alias("o_hash"), F.col("s").alias("o"), F.col("secret").alias("o_secret"), F.col("bucket").alias("o_bucket"))
    near = (F.col("o.start") - F.col("s.stop") <= SCOPE) & (F.col("s.start") - F.col("o.stop") <= SCOPE)
    apart = (F.col("o.start") >= F.col("s.stop")) | (F.col("s.start") >= F.col("o.stop"))
    same = F.col("doc_id").eqNullSafe(F.col("o_doc")) & (F.col("text_hash") == F.col("o_hash")) & (F.col("bucket") == F.col("o_bucket"))
    kept = weak.join(other, same & (F.col("secret") != F.col("o_secret")) & near & apart, "left_semi")
    return kept.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("s")).alias("linked"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base spans and linked weak spans of every document row.

    A null text counts as empty and has no spans; rows repeat as they came, null ids too; an empty
    table gives no rows. Rows of one doc_id and equal text share their links, which are the same.
    Spans that begin together are told apart by kind, as listed. A very long text is searched
    whole, its matches added up in pieces; only doc_id and text are read, so further columns
    cannot clash.
    """
    parts = saved(scan_parts(docs))
    links = linked_parts(parts).withColumnsRenamed({"doc_id": "l_doc", "text_hash": "l_hash"})
    on = F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("text_hash") == F.col("l_hash"))
    return parts.join(links, on, "left").select("doc_id", "text_hash", "base", F.coalesce("linked", F.array().cast(_SPANS)).alias("linked"))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every reported span replaced by ``MASK``, overlapping spans by one;
    n_chars follows the text. Rows without a span, null texts among them, stay as they are; rows
    repeat as they came, and columns of any name pass through."""
    spans = find_secrets(docs).where((F.size("base") > 0) | (F.size("linked") > 0))
    spans = spans.select(F.col("doc_id").alias("_readlake_doc"), F.col("text_hash").alias("_readlake_hash"), F.array_sort(F.concat("base", "linked")).alias("_readlake_spans")).dropDuplicates(["_readlake_doc", "_readlake_hash"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when((s["start"] >= acc["at"]) & ((acc["at"] == 0) | (s["start"] > acc["at"])), F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).cast("array<string>").alias("out"))

    masked = F.aggregate("_readlake_spans", start, step, lambda acc: F.concat(F.array_join(F.concat(acc["out"], F.array(F.lit(""))), MASK), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    on = F.col("doc_id").eqNullSafe(F.col("_readlake_doc")) & (F.xxhash64(whole_text()) == F.col("_readlake_hash"))
    text = F.when(F.col("_readlake_spans").isNotNull(), masked).otherwise(F.col("text"))
    joined = docs.join(spans, on, "left").withColumn("text", text)
    changed = F.when(F.col("_readlake_spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return joined.withColumn("n_chars", changed).select(*docs.columns)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked of every document row."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_secrets(docs).select("doc_id", *(count(k) for k, *_ in BASE), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "linked")).alias("spans"), F.size("linked").cast("long").alias("n_linked"))


def op4_linked_secrets(spark, sf_dir: str) -> DataFrame:
    """``secret_report`` of all ``documents``; ``find_secrets`` states every case."""
    return secret_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
