"""BPE encoding and decoding with forced boundaries.

Two symbols that never stand side by side inside a token of the vocabulary can't end up in one
token, so a word may be cut between them: the fragments are encoded independently and their ids
concatenated. A fragment is short and recurs far more often than its word, so most are looked up.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import spread, whole_text

#: Entries of a generation of each of a worker's two tables.
CACHE = 200_000
#: Longer runs are encoded each time; only shorter ones are kept in the tables.
LONGEST_KEPT = 256
#: Fragments of more symbols are merged by a queue of pairs.
SHORT = 24
END = "</w>"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Separators that str.split() takes for white space and the pattern's ``\s`` doesn't.
_CONTROLS = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[\s--[\x1c-\x1f]]+", regex.V1)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _unassigned() -> re.Pattern:
    """Finds what this Python's Unicode tables may not know: code points of the first plane that they
    don't, and all of the others. (Many ranges beyond the first plane would be tried one by one.)"""
    spans, start = [], None
    for c in range(0x10001):
        unknown = c < 0x10000 and unicodedata.category(chr(c)) == "Cn"
        if unknown and start is None:
            start = c
        elif not unknown and start is not None:
            spans.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = None
    return re.compile(f"[{''.join(spans)}\U00010000-\U0010ffff]")


class Generations(dict):
    """A table of at most ``2 * CACHE`` values made on demand: when the young ones fill it they
    become the old ones, and an old one that is asked for is young again."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ForcedBoundaryBpe:
    """Encoder and decoder of a vocabulary file whose words end in ``</w>``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.ids: dict[str, int] = file["model"]["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(file["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.token = [self.tokens.get(i) for i in range(max(self.tokens, default=-1) + 1)]
        self.letters = byte_letters()
        self.beside = {p for t in self.ids for s in [self.symbols(t)] for p in zip(s, s[1:])}
        self._cut = re.compile("|".join(map(re.escape, sorted(self.special)))) if self.special else None
        self._path, self._library, self._unknown = path, None, _unassigned()
        self.pieces, self.chunks = Generations(self.piece), Generations(self.chunk)

    @staticmethod
    def symbols(token: str) -> list[str]:
        """Letters of a token, the last one with the word's end if it has one."""
        if token.endswith(END) and len(token) > len(END):
            token = token[: -len(END)]
            return [*token[:-1], token[-1] + END]
        return [*token]

    def split(self, piece: str) -> Iterator[tuple[str, ...]]:
        """The fragments of a piece between its forced boundaries."""
        return self.cut([*piece] if piece.isascii() and piece.isalnum() else [self.letters[b] for b in piece.encode()])

    def cut(self, letters: list[str]) -> Iterator[tuple[str, ...]]:
        """The same of a piece's letters."""
        letters[-1] += END
        start = 0
        for k, pair in enumerate(zip(letters, letters[1:]), 1):
            if pair not in self.beside:
                yield tuple(letters[start:k])
                start = k
        yield tuple(letters[start:])

    def merge(self, fragment: tuple[str, ...]) -> tuple[int, ...]:
        """Ids of a fragment: the pair of lowest rank is joined, leftmost first, until none is left."""
        if len(fragment) > SHORT:
            return self._merge_long(fragment)
        parts, rank, none = list(fragment), self.rank.get, len(self.rank)
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < none:
            k = ranks.index(low)
            parts[k] += parts.pop(k + 1)
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank((parts[k], parts[k + 1]), none)
            if k:
                ranks[k - 1] = rank((parts[k - 1], parts[k]), none)
        return tuple([self.ids[p] for p in parts if p in self.ids])

    def _merge_long(self, fragment: tuple[str, ...]) -> tuple[int, ...]:
        """The same in n log n steps: symbols are a linked list and their pairs wait in a heap by rank
        and place; an entry whose pair has changed since is passed over."""
        parts, rank, n = list(fragment), self.rank.get, len(fragment)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [rank(p) for p in zip(parts, parts[1:])] + [None]  # rank of the pair that begins at each symbol
        heap = [(r, k) for k, r in enumerate(now) if r is not None]
        heapify(heap)
        while heap:
            r, k = heappop(heap)
            if now[k] != r:
                continue
            gone = after[k]
            parts[k] += parts[gone]
            parts[gone], now[gone] = None, None
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
                now[k] = rank((parts[k], parts[after[k]]))
                if now[k] is not None:
                    heappush(heap, (now[k], k))
            else:
                now[k] = None
            left = before[k]
            if left >= 0:
                now[left] = rank((parts[left], parts[k]))
                if now[left] is not None:
                    heappush(heap, (now[left], left))
        return tuple([self.ids[p] for p in parts if p in self.ids])

    def piece(self, piece: str) -> bytes:
        """Packed ids of a match of the splitting pattern."""
        return _packed([i for fragment in self.split(piece) for i in self.merge(fragment)])

    def chunk(self, chunk: str) -> bytes:
        """The same of a run without white space."""
        if chunk.isascii() and chunk.isalpha():
            return self._kept(self.pieces, chunk)
        return b"".join([self._kept(self.pieces, p) for p in _PIECES.findall(chunk)])

    @staticmethod
    def _kept(table: Generations, key: str) -> bytes:
        return table[key] if len(key) <= LONGEST_KEPT else table.make(key)

    def packed(self, text: str) -> bytes:
        """Ids of a whole text, little-endian 32-bit integers; special tokens stand for themselves."""
        if not self._cut or "<|" not in text:
            return b"".join(self._plain(text))
        out, start = [], 0
        for m in self._cut.finditer(text):
            out += self._plain(text[start : m.start()])
            out.append(_packed([self.special[m[0]]]))
            start = m.end()
        return b"".join([*out, *self._plain(text[start:])])

    def _plain(self, text: str) -> Iterator[bytes]:
        if not text.isascii() and self._unknown.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self._by_library(text)
        return self._by_words(text)

    def _by_library(self, text: str) -> Iterator[bytes]:
        """Where a text has code points that only the library may know, it says what the pieces are; they
        come with a letter for each byte."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        for letters, _ in self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text)):
            yield _packed([i for fragment in self.cut([*letters]) for i in self.merge(fragment)])

    def _by_words(self, text: str) -> Iterator[bytes]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no sigma of its own at a word's end
        text = text.lower()
        chunks = _SPACE.split(text) if _CONTROLS.search(text) else text.split()
        return (self._kept(self.chunks, c) for c in chunks if c)

    def encode(self, text: str) -> list[int]:
        return _unpacked(self.packed(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens of the ids, apart by spaces; ids that no token has are left out."""
        own, n = self.token, len(self.token)
        try:
            return " ".join([own[i] for i in ids])
        except (IndexError, TypeError):
            return " ".join([own[i] for i in ids if 0 <= i < n and own[i] is not None])


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _unpacked(packed: bytes) -> array:
    out = array("I")
    out.frombytes(packed)
    if sys.byteorder == "big":
        out.byteswap()
    return out


@lru_cache(maxsize=2)
def load(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary files have ``name``; every worker has them at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, and with ``with_ids`` the
    ids as packed little-endian 32-bit integers.

    A null text counts as empty: no tokens, and the digests of nothing. Rows are encoded each for
    itself, so repeated rows (and null or repeated ids) give repeated results and an empty table
    none; only doc_id and text are read, so further columns cannot clash. Among pairs of equal rank
    the leftmost is merged first. A very long text costs its length, a very long word n log n steps;
    a worker keeps at most ``2 * CACHE`` words and as many pieces, none above ``LONGEST_KEPT``
    letters. The decoded text is made from the packed ids alone.
    """
    path = path or vocabulary_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    names = [c.strip().split()[0] for c in schema.split(",")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows: list[list] = [[] for _ in names]
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"]):
                    packed = bpe.packed(text.as_py())
                    decoded = bpe.decode(_unpacked(packed))
                    row = (doc_id, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), packed)
                    for column, value in zip(rows, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()))], names)

    rows = spread(docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text")))
    return rows.mapInArrow(encode, schema)


def op7_forced_boundary_bpe(spark, sf_dir: str) -> DataFrame:
    """``encode_documents`` of all ``documents``, which states what nulls, empty and long texts give."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
