"""Alignment of two tokenizers over a corpus, with a fast path for tokens that stand for each other.

Both tokenizers cut the same bytes; the places where both cut part a text into groups. Most groups
are one token of each with the same bytes, and which B token that is depends on the A token alone:
an array of vocabulary length, worked out once, says so. Such groups are counted in a vector of
vocabulary length in each task. Only the tokens of other groups, and of pairs that the array
doesn't know, become pairs that are shuffled and counted.

Texts are tokenised once and kept as counts of tokens and pairs a document. When the corpus's counts
are known, a second pass over these looks them up: the vectors and the most frequent pairs, a
bounded number, are broadcast, and what else a document has meets its counts in a join.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters, vocabulary_path
from .common import saved, spread, whole_text

#: Pairs whose counts are broadcast at most; the counts of the others are joined.
FREQUENT = 1 << 20
#: Bytes of text aligned at once, and pairs that a task counts before it hands them on.
BATCH, HELD = 1 << 20, 1 << 20
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Pair:
    """Tokenizer A (a byte-level BPE in JSON) and B (a sentencepiece model), the bytes of their
    tokens, and ``same``: the B id with the same bytes as each A id, -1 where there is none."""

    def __init__(self, a_path: str, b_path: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        with open(a_path, encoding="utf-8") as f:
            file = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        special = {t["id"]: t["content"] for t in file["added_tokens"]}
        plain = {i: bytes(byte[c] for c in token) for token, i in file["model"]["vocab"].items() if i not in special}
        own = {t: i for i, t in plain.items()}
        self._a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=own, special_tokens={})
        self._path, self._slow = a_path, None
        self.a = [plain.get(i, b"") for i in range(max(plain, default=-1) + 1)]
        self._b = SentencePieceProcessor(model_file=b_path)
        raw = [self._b.is_byte(i) for i in range(self._b.get_piece_size())]
        pieces = [self._b.id_to_piece(i) for i in range(len(raw))]
        self.b = [bytes([int(p[3:5], 16)]) if r else p.replace("▁", " ").encode() for p, r in zip(pieces, raw)]
        first = {t: i for i, (t, r) in reversed([*enumerate(zip(self.b, raw))]) if not (r or self._b.is_control(i) or self._b.is_unknown(i))}
        self.same = np.array([first.get(t, -1) for t in self.a], np.int64)
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a, self.b))
        # what a token adds to the description of the groups: its id and what follows it
        self.words = [f"{i}{end}" for x, ends in ((self.a, ",|"), (self.b, ",;")) for i in range(len(x)) for end in ends]

    def encode_a(self, text: str) -> list[int]:
        """The library's ids; the quicker encoder of the same vocabulary gives up on some very long runs."""
        try:
            return self._a.encode_ordinary(text)
        except BaseException as e:  # it panics, which is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                raise
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._path)
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids

    def encode_b(self, texts: Sequence[str]) -> list[list[int]]:
        return self._b.encode(list(texts), num_threads=1)


@lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _empty() -> dict:
    return {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "ids": b"", "id_n": b"", "pairs": b"", "pair_n": b""}


def align(pair: Pair, texts: Sequence[str]) -> list[dict]:
    """What each text gives: sizes, the digest of its groups, its ids of the fast path and the other pairs,
    each distinct one once with its number, as packed 64-bit integers."""
    out = [_empty() for _ in texts]
    data = [(" " + t).encode("utf-8", "surrogatepass") for t in texts]
    found = []
    for k, (text, b) in enumerate(zip(texts, pair.encode_b(texts))):
        a = pair.encode_a(" " + text) if text else []
        if text and b"".join(map(pair.a.__getitem__, a)) == data[k] and b"".join(map(pair.b.__getitem__, b)) == data[k]:
            found.append((k, np.array(a, np.int64), np.array(b, np.int64)))
    if not found:
        return out
    a, b = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])
    a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    ends = np.union1d(a_end, b_end)  # an overlap ends at each
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    a_n, b_n = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
    # ids in the order of the description: the A tokens of a group, then its B tokens
    a_place = np.arange(len(a)) + (np.cumsum(b_n) - b_n)[a_group]
    b_place = np.arange(len(b)) + np.cumsum(a_n)[b_group]
    codes = np.empty(len(a) + len(b), np.int64)
    codes[a_place] = 2 * a + (np.append(a_group[1:], -1) != a_group)
    codes[b_place] = 2 * (len(pair.a) + b) + (np.append(b_group[1:], -1) != b_group)
    # overlaps: the fast path's ids, and the other pairs
    la, lb, group = a[np.searchsorted(a_end, ends)], b[np.searchsorted(b_end, ends)], np.searchsorted(cuts, ends)
    fast = ((a_n == 1) & (b_n == 1))[group] & (pair.same[la] == lb)
    last = np.cumsum([len(data[k]) for k, _, _ in found])
    doc = np.searchsorted(last, ends)
    a_last, b_last, link_last = np.cumsum([len(x[1]) for x in found]), np.cumsum([len(x[2]) for x in found]), np.searchsorted(ends, last, "right")
    cut_last = np.searchsorted(cuts, last, "right")
    own = _by_doc(doc[fast], la[fast], len(pair.a), len(found))
    other = _by_doc(doc[~fast], la[~fast] * len(pair.b) + lb[~fast], len(pair.a) * len(pair.b), len(found))
    for x, (k, own_a, own_b) in enumerate(found):
        start, end = (a_last[x - 1] + b_last[x - 1] if x else 0), a_last[x] + b_last[x]
        (ids, id_n), (pairs, pair_n) = own[x], other[x]
        sizes = [int(y[x] - (y[x - 1] if x else 0)) for y in (cut_last, link_last)]
        out[k] = {"n_a": len(own_a), "n_b": len(own_b), "n_groups": sizes[0], "n_links": sizes[1], "groups_sha256": _described(pair, codes[start:end]), "ids": ids, "id_n": id_n, "pairs": pairs, "pair_n": pair_n}
    return out


def _by_doc(doc: np.ndarray, key: np.ndarray, most: int, n: int) -> list[tuple[bytes, bytes]]:
    """For each of n documents its distinct keys, below ``most``, and how often it has them."""
    values, counts = np.unique(doc * most + key, return_counts=True)
    cuts = np.searchsorted(values, np.arange(1, n) * most)
    return [(v.tobytes(), c.tobytes()) for v, c in zip(np.split(values % most, cuts), np.split(counts.astype(np.int64), cuts))]


def _described(pair: Pair, codes: np.ndarray) -> str:
    digest, last = hashlib.sha256(), len(codes) - 1
    for k in range(0, len(codes), 1 << 18):
        text = "".join(map(pair.words.__getitem__, codes[k : k + (1 << 18)].tolist()))
        digest.update((text[:-1] if k + (1 << 18) > last else text).encode())
    return digest.hexdigest()


_COLUMNS = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "ids": pa.binary(), "id_n": pa.binary(), "pairs": pa.binary(), "pair_n": pa.binary()}
_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, ids binary, id_n binary, pairs binary, pair_n binary"


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row a document with what ``align`` says of its text, and a number ``row`` of its own. Texts are
    taken together up to ``BATCH`` bytes, a longer one alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(a_path, b_path)

        def done(ids: list, texts: list) -> pa.RecordBatch:
            rows = align(pair, texts)
            return pa.RecordBatch.from_arrays([pa.array(ids if c == "doc_id" else [r[c] for r in rows], t) for c, t in _COLUMNS.items()], [*_COLUMNS])

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = text.as_py()
                if texts and held + len(text) > BATCH:
                    yield done(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
            if texts:
                yield done(ids, texts)

    rows = spread(docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text")))
    return saved(rows.mapInArrow(run, _SCHEMA).withColumn("row", F.monotonically_increasing_id()))


def _flat(column) -> np.ndarray:
    """All 64-bit integers of a binary column, row after row."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64)


def _row_sizes(column) -> np.ndarray:
    return np.array([len(x) // 8 for x in column.to_pylist()], np.int64)


def count_links(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(key, n) of every pair that the corpus has linked, ``key = a * B's vocabulary + b``. The fast path's
    ids are counted in a vector a task, and the vectors are summed by id; other pairs are counted in
    each task and summed by pair."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(load(a_path, b_path).a), np.int64)
        for batch in batches:
            np.add.at(total, _flat(batch["ids"]), _flat(batch["id_n"]))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], ["id", "n"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = counts = np.zeros(0, np.int64)

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

        for batch in batches:
            more, n = np.concatenate([keys, _flat(batch["pairs"])]), np.concatenate([counts, _flat(batch["pair_n"])])
            keys, where = np.unique(more, return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, where, n)
            if len(keys) > HELD:
                yield handed()
                keys = counts = np.zeros(0, np.int64)
        yield handed()

    pair = load(a_path, b_path)
    by_id = aligned.select("ids", "id_n").mapInArrow(vectors, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    same = aligned.sparkSession.createDataFrame(list(enumerate(pair.same.tolist())), "id long, same long")
    known = by_id.join(F.broadcast(same), "id").select((F.col("id") * len(pair.b) + F.col("same")).alias("key"), "n")  # at most one row an A token
    other = aligned.select("pairs", "pair_n").mapInArrow(pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return saved(known.unionByName(other).groupBy("key").agg(F.sum("n").alias("n")))


def _frequent(totals: DataFrame) -> int:
    """The least power of two so that at most ``FREQUENT`` pairs are counted as often or more."""
    sizes = {r["e"]: r["n"] for r in totals.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 63 rows at most
    seen = 0
    for e in sorted(sizes, reverse=True):
        seen += sizes[e]
        if seen > FREQUENT:
            return 2 ** (e + 1)
    return 1


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """How tokenizers A and B align over the documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256. ``n_best`` are the links whose pair is the most frequent of its B token in the corpus,
    ties included, and ``count_sum`` adds up the corpus's counts of the pairs of all links.

    Null and empty texts, and those that a tokenizer doesn't give back byte for byte, have no tokens:
    zeros and an empty digest; they count for no pair. Special tokens' strings are plain text. Rows
    stand each for itself, and repeated ones count repeatedly; null ids pass through; an empty table
    gives no rows. A very long text is aligned whole and costs its length. Only doc_id and text are
    read, so further columns cannot clash.
    """
    a_path, b_path = a_path or vocabulary_path("byte_bpe_50k.json"), b_path or vocabulary_path("piece_bpe_32k.model")
    spark, pair = docs.sparkSession, load(a_path, b_path)
    aligned = align_documents(docs, a_path, b_path)
    totals = count_links(aligned, a_path, b_path)
    width = len(pair.b)
    b = (F.col("key") % width).alias("b")
    best = np.zeros(width, np.int64)
    for r in totals.groupBy(b).agg(F.max("n").alias("n")).collect():  # a row a B token
        best[r["b"]] = r["n"]
    known = np.zeros(len(pair.a), np.int64)
    keys = spark.createDataFrame([(i * width + s, i) for i, s in enumerate(pair.same.tolist()) if s >= 0], "key long, id long")
    for r in totals.join(F.broadcast(keys), "key").select("id", "n").collect():  # at most a row an A token
        known[r["id"]] = r["n"]
    least = _frequent(totals)
    often = totals.where(F.col("n") >= least).toArrow()  # at most FREQUENT rows
    often_keys, often_n = often["key"].to_numpy(), often["n"].to_numpy()
    order = np.argsort(often_keys)
    shared = spark.sparkContext.broadcast((best, known, often_keys[order], often_n[order]))
    names = [c for c in _COLUMNS if c not in ("ids", "id_n", "pairs", "pair_n")]
    columns = [*names, "row", "n_best", "count_sum", "rest", "rest_n"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, known, often_keys, often_n = shared.value
        same = load(a_path, b_path).same
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                ids, id_n, pairs, pair_n = (_flat(batch[c]) for c in ("ids", "id_n", "pairs", "pair_n"))
                sizes, more = _row_sizes(batch["ids"]), _row_sizes(batch["pairs"])
                at = np.searchsorted(often_keys, pairs)
                hit = np.append(often_keys, -1)[at] == pairs
                n = np.where(hit, np.append(often_n, 0)[at], 0)
                top, total = _sums(sizes, id_n * (known[ids] == best[same[ids]])), _sums(sizes, id_n * known[ids])
                top += _sums(more, pair_n * (hit & (n == best[pairs % width])))
                total += _sums(more, pair_n * n)
                ends = np.concatenate([[0], np.cumsum(_sums(more, (~hit).astype(np.int64)))]).astype(np.int32)
                rest = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[~hit])) for x in (pairs, pair_n)]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*names, "row")), pa.array(top), pa.array(total), *rest], columns)

    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, n_best long, count_sum long, rest array<long>, rest_n array<long>"
    scored = aligned.mapInArrow(look_up, kinds)
    result = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if least == 1:  # every pair was broadcast
        return scored.select(*result)
    scored = saved(scored)
    tops = spark.createDataFrame(list(enumerate(best.tolist())), "b long, top long")
    rare = totals.where(F.col("n") < least).withColumn("b", b).join(F.broadcast(tops), "b").select("key", "n", (F.col("n") == F.col("top")).cast("long").alias("is_best"))
    links = scored.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("x")).select("row", F.col("x.rest").alias("key"), F.col("x.rest_n").alias("times"))
    sums = links.join(rare, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("is_best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = scored.drop("rest", "rest_n").join(sums, "row", "left")
    return both.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).select(*result)


def _sums(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def op12_identity_alignment(spark, sf_dir: str) -> DataFrame:
    """``alignment`` of all ``documents``, which states what nulls, ties and repeated rows give."""
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
