import hashlib
import random
import struct
import time

import pytest
from tokenizers import Tokenizer

from readlake.llm import bpe

from .data import awkward, empty, table

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    r = random.Random(1)
    texts = ["Héllo  wörld's 123 it's!!***\n ß", " ", "<|endoftext|> a <|startoftext|>b<|endof", "Ñcición İstanbul ﬁ á x​q 你好", "'s 'S a'll b'LL", "a\xa0b\x1cc d", "ΑΣ ΣΑΣ Σ", "x" * 3000, "\u0085a b", "é ½ ² Ⅷ", "\x00a\x01", "it's they're I'd"]
    kinds = [(32, 127), (0x80, 0x500), (0x3000, 0x9FFF), (0x1F300, 0x1F700), (32, 33)]
    return texts + ["".join(chr(r.randrange(*r.choice(kinds))) for _ in range(r.randrange(40))) for _ in range(1500)]


def test_same_as_the_library(library):
    own = bpe.load(PATH)
    texts = odd_texts() + [t for t in awkward() if t is not None]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == want.ids
        assert own.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_forced_boundaries_are_sound():
    """Cutting never changes what the merges give, and some words are cut."""
    own, cut = bpe.load(PATH), 0
    for word in ["hello", "straße", "你好世界", "naïveté", "ñqzx", "wörldß", "zqzqjx"]:
        letters = [own.letters[b] for b in word.encode()]
        letters[-1] += bpe.END
        parts = list(own.split(word))
        cut += len(parts) > 1
        assert [x for p in parts for x in p] == letters
        assert tuple(i for p in parts for i in own.merge(p)) == own.merge(tuple(letters))
    assert cut


def test_full_tables_keep_results(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE", 3)
    own = bpe.ForcedBoundaryBpe(PATH)
    text = " ".join(t for t in awkward() if t and len(t) < 900)
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(own.chunks) <= 3 and len(own.chunks.old) <= 3


@pytest.mark.parametrize("word", ["a" * 1_000_000, "ab" * 500_000, "-" * 1_000_000, "é" * 300_000])
def test_very_long_words(library, word):
    """A word of a million letters is merged in n log n steps and kept in no table."""
    own, began = bpe.ForcedBoundaryBpe(PATH), time.time()
    ids = own.encode(word)
    assert time.time() - began < 60
    assert ids == library.encode(word, add_special_tokens=False).ids
    assert max(map(len, [*own.chunks, *own.pieces]), default=0) <= bpe.LONGEST_KEPT


def test_long_and_short_merges_agree(monkeypatch):
    own, r = bpe.load(PATH), random.Random(2)
    for _ in range(300):
        letters = ["".join(r.choices("aeinrst", k=1)) for _ in range(r.randrange(2, 60))]
        letters[-1] += bpe.END
        monkeypatch.setattr(bpe, "SHORT", 100)
        want = own.merge(tuple(letters))
        monkeypatch.setattr(bpe, "SHORT", 0)
        assert own.merge(tuple(letters)) == want


def test_decoding_of_ids_that_no_token_has(library):
    own = bpe.load(PATH)
    assert own.decode([320, 10**6, 321]) == own.decode([320, 321]) == library.decode([320, 321], skip_special_tokens=False)


def test_report(spark, library):
    texts = awkward() + odd_texts()[:40]
    rows = {r.doc_id: r for r in bpe.encode_documents(table(spark, texts), with_ids=True).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert bytes(rows[i].ids) == packed
    assert bpe.encode_documents(empty(spark)).count() == 0


def test_every_code_point_is_split_as_the_library_does(library):
    """Also those that this Python's Unicode tables don't know: a sweep of all planes."""
    texts = [" ".join(f"a{chr(c)}-{chr(c)}b" for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in [*range(0, 0x20000, 64), *range(0x2FC00, 0x33000, 64), *range(0xE0000, 0xE0400, 64)]]
    own = bpe.load(PATH)
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == e.ids
