"""Language ID with a linear-chain conditional random field over words.

Every word of a text gets a score for each language from byte n-grams, affixes and a lexicon, and
neighbouring words are tied by learned transitions, so a code-switched text has words of several
languages. Forward-backward gives each word's chances; their mean names the document's language.
All words of a batch advance together: texts are cut into blocks whose transfer matrices are
worked out side by side and then chained.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import spread, whole_text

#: The sample that the model is fitted on: documents of a language at most and of all together (but one
#: of each at least), and characters of a text, from a place that depends on its id.
TRAIN_DOCS, TRAIN_ALL, TRAIN_CHARS = 300, 19_200, 2000
#: Rows of each hashed feature table, and weights of one at most: many languages share fewer rows.
TABLE, WEIGHTS = 1 << 16, 1 << 22
#: A word is in the lexicon if the sample has it so often.
LEXICON_COUNT = 3
#: Words of a training sequence, words of one language in a row there, passes, step and decay.
SEQUENCE, SWITCH, EPOCHS, STEP, DECAY = 64, 16, 6, 0.3, 1e-4
#: Words of a block, and bytes of text that are worked on at once with up to 16 languages.
BLOCK, CHUNK = 32, 1 << 18
UNKNOWN = "und"
#: Bytes that are no letters part words; A-Z are in lower case by then.
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (3 * table + lexicon + 1, labels)
    transitions: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    table: int = TABLE

    def chunk(self) -> int:
        """Bytes of text at once: the transfer matrices of its blocks grow with the square of the labels."""
        return max(1 << 10, int(CHUNK / max(1.0, len(self.labels) / 16) ** 2))


def prepare(text: bytes) -> bytes:
    """Lower case, every run of non-letters one space, a space at both ends."""
    words = text.lower().translate(_LETTERS).split()
    return b" " + b" ".join(words) + b" " if words else b""


def has_letter(text: bytes) -> bool:
    low = text.lower().translate(_LETTERS).strip()
    return bool(low) and (any(b < 128 and b != 32 for b in low) or any(c.isalpha() for c in low.decode("utf-8", "replace")))


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    power = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    terms = (data[np.repeat(starts, lengths) + place].astype(np.uint64) + np.uint64(7)) * power[place]
    return np.add.reduceat(terms, np.cumsum(lengths) - lengths)


def word_features(data: np.ndarray, lexicon: np.ndarray, table: int = TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all words of prepared text, and where each word's begin: pairs and triples of
    bytes with the spaces at both ends, the two affixes of three bytes, and the lexicon entry."""
    space = data == 32
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    lengths = ends - starts
    d = np.concatenate([data, np.full(4, 32, np.uint8)]).astype(np.uint32)
    pair = d[:-1] << np.uint32(8) | d[1:]
    triple = (d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA77) + d[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
    quad = (d[:-3] * np.uint32(0x27D4EB2F) + d[1:-2] * np.uint32(0x165667B1) + d[2:-1] * np.uint32(0x9E3779B1) + d[3:] * np.uint32(0x85EBCA77)) >> np.uint32(16)
    n = 2 * lengths + 4  # length + 1 pairs, length triples, two affixes, the entry
    begin = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.int64)
    for values, count, shift, at in ((pair, lengths + 1, 0, 0), (triple, lengths, table, lengths + 1)):
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(begin + at, count) + place] = values[np.repeat(starts - 1, count) + place] % table + np.int64(shift)
    out[begin + 2 * lengths + 1] = quad[starts - 1].astype(np.int64) % table + 2 * table
    out[begin + 2 * lengths + 2] = quad[np.maximum(ends - 3, 0)].astype(np.int64) % table + 2 * table
    own = word_hashes(data, starts, lengths)
    at = np.searchsorted(lexicon, own)
    known = lexicon[np.minimum(at, len(lexicon) - 1)] == own if len(lexicon) else np.zeros(len(own), bool)
    out[begin + 2 * lengths + 3] = 3 * table + np.where(known, at, len(lexicon))
    return out, begin


def emissions(features: np.ndarray, begin: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[features], begin, axis=0) if len(begin) else np.zeros((0, weights.shape[1]))


def marginals(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Chances of the labels at each word of texts of ``counts`` words (each at least one): the
    scores of all texts one after the other, (words, labels). Equal to forward-backward word by word."""
    n, labels = scores.shape
    e = np.exp(scores - scores.max(1, keepdims=True)) + 1e-30
    a = np.exp(transitions - transitions.max())
    blocks = -(-counts // BLOCK)
    text = np.repeat(np.arange(len(counts)), blocks)
    order = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    size = np.minimum(BLOCK, counts[text] - order * BLOCK)
    first = (np.cumsum(counts) - counts)[text] + order * BLOCK
    b = len(text)
    at = np.minimum(first[None, :] + np.arange(BLOCK)[:, None], n - 1)
    inside = np.arange(BLOCK)[:, None] < size[None, :]
    m = np.broadcast_to(np.eye(labels), (b, labels, labels)).copy()
    for k in range(BLOCK):
        own = inside[k]
        step = (m[own].reshape(-1, labels) @ a).reshape(-1, labels, labels) * e[at[k, own]][:, None, :]
        m[own] = step / step.max((1, 2), keepdims=True)
    before, after = np.ones((b, labels)), np.ones((b, labels))
    base = np.cumsum(blocks) - blocks
    for k in range(1, int(blocks.max(initial=0))):
        own = base[blocks > k] + k
        x = np.einsum("bi,bij->bj", before[own - 1], m[own - 1])
        before[own] = x / x.sum(1, keepdims=True)
        own = (base + blocks)[blocks > k] - k
        x = np.einsum("bij,bj->bi", m[own], after[own])
        after[own - 1] = x / x.sum(1, keepdims=True)
    forward = np.empty((BLOCK, b, labels))
    x = before
    for k in range(BLOCK):
        y = (x @ a) * e[at[k]]
        forward[k] = x = np.where(inside[k][:, None], y / y.sum(1, keepdims=True), x)
    out = np.empty((n, labels))
    x = after
    for k in range(BLOCK - 1, -1, -1):
        own = inside[k]
        g = forward[k, own] * x[own]
        out[at[k, own]] = g / g.sum(1, keepdims=True)
        y = (e[at[k]] * x) @ a.T
        x = np.where(own[:, None], y / y.sum(1, keepdims=True), x)
    return out


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """Prepared text in pieces of about ``size`` bytes, cut between words; each has its outer spaces."""
    start = 0
    while len(text) - start > size:
        cut = text.find(b" ", start + size)
        if cut < 0 or cut == len(text) - 1:
            break
        yield text[start : cut + 1]
        start = cut
    if text[start:].strip():
        yield text[start:]


def _batches(texts: list[bytes], size: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Indices and prepared pieces of texts of about ``size`` bytes together; texts without words are left out."""
    held, total = [], 0
    for n, text in enumerate(texts):
        for own in pieces(prepare(text), size):
            held.append((n, own))
            total += len(own)
            if total >= size:
                yield [i for i, _ in held], [t for _, t in held]
                held, total = [], 0
    if held:
        yield [i for i, _ in held], [t for _, t in held]


def label_words(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chances of the labels at each word of prepared non-empty texts, and their numbers of words."""
    counts = np.array([t.count(b" ") - 1 for t in texts])
    data = np.frombuffer(b"".join([t[:-1] for t in texts]) + b" ", np.uint8)
    features, begin = word_features(data, model.lexicon, model.table)
    return marginals(emissions(features, begin, model.weights), counts, model.transitions), counts


@dataclass
class Verdict:
    """Language of a text and its mean chance over the words, the mean of each word's highest chance,
    and how many words have each label as their likeliest."""

    lang: str = UNKNOWN
    score: float = 0.0
    sure: float = 0.0
    words: dict[str, int] | None = None


def judge(model: Model, texts: list[bytes]) -> list[Verdict]:
    """A verdict on each whole text. One that is longer than what is worked on at once is labelled in
    pieces; of languages with equal means the first by name holds."""
    out = [Verdict() for _ in texts]
    if not model.labels:
        return out
    size = len(model.labels)
    total, sure, top = np.zeros((len(texts), size)), np.zeros(len(texts)), np.zeros((len(texts), size), np.int64)
    for rows, own in _batches([t if has_letter(t) else b"" for t in texts], model.chunk()):
        chances, counts = label_words(model, own)
        first = np.cumsum(counts) - counts
        np.add.at(total, rows, np.add.reduceat(chances, first, axis=0))
        np.add.at(sure, rows, np.add.reduceat(chances.max(1), first))
        np.add.at(top, (np.repeat(rows, counts), chances.argmax(1)), 1)
    n = top.sum(1)
    for k in np.flatnonzero(n).tolist():
        mean = np.round(np.minimum(1.0, total[k] / n[k]), 9)  # batches differ in the last bits
        best = int(mean.argmax())
        out[k] = Verdict(model.labels[best], float(mean[best]), round(min(1.0, float(sure[k] / n[k])), 9), {model.labels[j]: int(top[k, j]) for j in np.flatnonzero(top[k]).tolist()})
    return out


def predict(model: Model, texts: list[bytes]) -> list[tuple[str, float]]:
    """Language and its mean chance over the words of each whole text."""
    return [(v.lang, v.score) for v in judge(model, texts)]


def fit(samples: list[tuple[str, bytes]], seed: int = 1) -> Model:
    """A model of (language, text) samples. Training sequences switch language every ``SWITCH``
    words on the average, so that the transitions are learned from switches as well."""
    labels = sorted({label for label, _ in samples})
    random = np.random.default_rng(seed)
    words: dict[str, list[bytes]] = {label: [] for label in labels}
    for label, text in sorted(samples):
        words[label] += prepare(text).split()
    labels = [label for label in labels if words[label]]
    if not labels:
        return Model([], np.zeros((3 * TABLE + 1, 0)), np.zeros((0, 0)), np.zeros(0, np.uint64))
    table = min(TABLE, max(1 << 10, 1 << int(np.log2(WEIGHTS / len(labels)))))
    sequence, truth = [], []
    places = {label: 0 for label in labels}
    while places:
        label = sorted(places)[int(random.integers(len(places)))]
        take = 1 + int(random.geometric(1 / SWITCH))
        own = words[label][places[label] : places[label] + take]
        sequence += own
        truth += [labels.index(label)] * len(own)
        places[label] += take
        if places[label] >= len(words[label]):
            del places[label]
    data = np.frombuffer(b" " + b" ".join(sequence) + b" ", np.uint8)
    space = np.flatnonzero(data == 32)
    hashes = word_hashes(data, space[:-1] + 1, np.diff(space) - 1)
    values, counts = np.unique(hashes, return_counts=True)
    lexicon = values[counts >= LEXICON_COUNT]
    features, begin = word_features(data, lexicon, table)
    n, size = len(truth), len(labels)
    width = np.diff(np.append(begin, len(features)))
    weights, transitions = np.zeros((3 * table + len(lexicon) + 1, size)), np.zeros((size, size))
    seen, seen_t = np.full(weights.shape, 1e-2), np.full(transitions.shape, 1e-2)
    goal = np.eye(size)[truth]
    pieces = np.arange(0, n, SEQUENCE)
    for _ in range(EPOCHS):
        random.shuffle(pieces)
        for k in range(0, len(pieces), 128):
            part = np.sort(pieces[k : k + 128])
            lengths = np.minimum(part + SEQUENCE, n) - part
            own = np.concatenate([np.arange(a, a + m) for a, m in zip(part, lengths)])
            spans = width[own]
            rows = features[np.repeat(begin[own] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())]
            scores = emissions(rows, np.cumsum(spans) - spans, weights)
            chances = marginals(scores, lengths, transitions)
            error = (chances - goal[own]) / SEQUENCE
            used, inverse = np.unique(rows, return_inverse=True)
            per_row = np.repeat(error, spans, axis=0)
            grad = np.stack([np.bincount(inverse, per_row[:, j], len(used)) for j in range(size)], 1) + DECAY * weights[used]
            seen[used] += grad**2
            weights[used] -= STEP * grad / np.sqrt(seen[used])
            # expected and true transitions within the sequences; neighbours' chances stand for their joint
            inner = np.ones(len(own), bool)
            inner[np.cumsum(lengths) - lengths] = False
            now, before = np.flatnonzero(inner), np.flatnonzero(inner) - 1
            joint = _pairs(scores, chances, before, now, transitions)
            true = goal[own][before].T @ goal[own][now]
            grad_t = (joint - true) / SEQUENCE + DECAY * transitions
            seen_t += grad_t**2
            transitions -= STEP * grad_t / np.sqrt(seen_t)
    return Model(labels, weights.astype(np.float32), transitions, lexicon, table)


def _pairs(scores: np.ndarray, chances: np.ndarray, before: np.ndarray, now: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Expected transitions between neighbours: the joint chances with the marginals of both words
    (scaled until they fit, which the chain's own joint does in one form only)."""
    joint = np.exp(transitions - transitions.max())[None] * np.ones((len(now), 1, 1))
    p, q = chances[before], chances[now]
    for _ in range(8):
        joint *= (p / np.maximum(joint.sum(2), 1e-30))[:, :, None]
        joint *= (q / np.maximum(joint.sum(1), 1e-30))[:, None, :]
    return joint.sum(0)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is a multiple of 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, docs_each: int = TRAIN_DOCS, in_all: int = TRAIN_ALL, size: int = TRAIN_CHARS) -> list[tuple[str, bytes]]:
    """Up to ``docs_each`` documents of every language, ``in_all`` of all together, by hash of their
    id, and ``size`` characters of each from a place that the hash gives: a bounded sample, the same
    in any layout. No language is left out; with very many of them each has fewer documents."""
    place = F.xxhash64(F.col("doc_id").cast("string"))
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())  # counted without the texts
    n = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not n:
        return []
    each = max(1, min(docs_each, in_all // len(n)))
    # hashes are uniform, so a slightly generous share of them holds the sample; the smallest are kept
    share = F.create_map(*[x for k, c in sorted(n.items()) for x in (F.lit(k), F.lit(min(1.0, (each + 6 * each**0.5) / c)))])
    below = (place.cast("double") / F.lit(2.0**63) + 1) / 2 <= share[F.col("lang")]
    start = F.pmod(F.xxhash64(F.lit("window"), F.col("doc_id").cast("string")), F.greatest(F.lit(1), F.length("text") - size + 1)) + 1
    rows = usable.where(F.col("text").isNotNull() & below).select("lang", place.alias("h"), F.substring(F.col("text"), start.cast("int"), F.lit(size)).alias("text"))
    first = F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))
    return [(r["lang"], r["text"].encode()) for r in rows.withColumn("k", first).where(F.col("k") <= each).collect()]


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, words of every whole text; words tells how many words have
    which language, as ``de:3,en:40``. The model is learned from the documents that aren't held out
    unless it is given.

    ``und`` with score 0 and no words where a text is null, empty or has no letter, and everywhere if
    there is nothing to learn from. Of languages with equal means the first by name holds. A text of
    more than a chunk is labelled whole, in pieces cut between words. Rows stand each for itself,
    repeated ids too; an empty table gives none; other columns are not read.
    """
    model = model or fit(training_sample(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                found = judge(shared.value, part["data"].to_pylist())
                words = [",".join(f"{k}:{n}" for k, n in sorted((v.words or {}).items())) for v in found]
                columns = [pa.array([v.lang for v in found], pa.string()), pa.array([v.score for v in found], pa.float64()), pa.array(words, pa.string())]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], *columns], ["doc_id", "held_out", "lang_pred", "score", "words"])

    rows = spread(docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), whole_text().cast("binary").alias("data")))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, words string")


def language_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, start, end, lang): runs of words [start, end) of one language in every text, words
    from 0 between non-letters. Texts without a letter have none."""
    model = model or fit(training_sample(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            texts = [t if has_letter(t) else b"" for t in batch["data"].to_pylist()] if own.labels else []
            held: dict[int, list[np.ndarray]] = {}
            for rows, parts in _batches(texts, own.chunk()):
                chances, counts = label_words(own, parts)
                for k, best in zip(rows, np.split(chances.argmax(1), np.cumsum(counts)[:-1])):
                    held.setdefault(k, []).append(best)
            for k, best in held.items():
                labels = np.concatenate(best)
                starts = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
                ends = np.append(starts[1:], len(labels))
                yield pa.RecordBatch.from_arrays([pa.array([ids[k]] * len(starts), pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array([own.labels[x] for x in labels[starts]], pa.string())], ["doc_id", "start", "end", "lang"])

    rows = spread(docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().cast("binary").alias("data")))
    return rows.mapInArrow(run, "doc_id long, start long, end long, lang string")


def keep_identified(docs: DataFrame, least: float, model: Model | None = None) -> DataFrame:
    """The documents, with all their columns, in which the mean of each word's highest chance is at
    least ``least``, or with more than three labels that share of three even chances; those that are
    ``und`` (null, empty, no letter) go. Words may be of several languages, in any shares. Nothing is
    moved or joined, so repeated rows, null ids and columns of any name pass through."""
    model = model or fit(training_sample(docs))
    least = least * 3 / max(3, len(model.labels))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                found = judge(shared.value, [(t or "").encode("utf-8", "surrogatepass") for t in part.column(place).to_pylist()])
                yield part.filter(pa.array([v.lang != UNKNOWN and v.sure >= least for v in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_crf_language(spark, sf_dir: str) -> DataFrame:
    """``identify`` for all ``documents``, learned from those that aren't held out; every case is stated there."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
