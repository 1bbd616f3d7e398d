import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from readlake.llm import align as A
from readlake.llm.bpe import byte_letters, vocabulary_path

from .data import awkward, empty, table

PATHS = (vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))
ODD = ["a▁b", "x <|endoftext|> y</s><s>", "  two  spaces\n\n\tand\r\nlines ", "日本語テキスト混じり 👩‍👩‍👧 é́", "aaaaaaaaab" * 40, "\x00\x01", " ", "don't I'll WE'VE 12345678 ---- ....", "naïve Straße ÅNGSTRÖM", "�​"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def brute(libraries, texts):
    """Pair by pair, with the libraries of the contract."""
    a_lib, b_lib = libraries
    byte = {c: bytes([b]) for b, c in enumerate(byte_letters())}
    a_bytes = {i: b"".join(byte[c] for c in t) for t, i in a_lib.get_vocab().items() if i != 50256}
    piece = lambda i: bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()
    out, links = [], []
    for text in texts:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(map(piece, b)) != whole:
            out.append([0, 0, 0, 0, ""])
            links.append([])
            continue
        spans = []
        for ids, size in ((a, lambda i: len(a_bytes[i])), (b, lambda i: len(piece(i)))):
            at, own = 0, []
            for i in ids:
                own.append((at, at := at + size(i), i))
            spans.append(own)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, start = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in own if start <= s and e <= c) for own in spans))
            start = c
        pairs = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e] if len(a) < 3000 else fast_pairs(spans)
        out.append([len(a), len(b), len(groups), len(pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()])
        links.append(pairs)
    total = Counter(p for x in links for p in x)
    best = Counter()
    for (_, j), n in total.items():
        best[j] = max(best[j], n)
    return [(*x[:4], sum(total[p] == best[p[1]] for p in own), sum(total[p] for p in own), x[4]) for x, own in zip(out, links)]


def fast_pairs(spans):
    out, j = [], 0
    b = spans[1]
    for s, e, i in spans[0]:
        while b[j][1] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][0] < e:
            out.append((i, b[k][2]))
            k += 1
    return out


def check(rows, want):
    assert [tuple(r)[1:] for r in sorted(rows, key=lambda r: r.doc_id)] == want


def test_equals_a_pair_by_pair_version(spark, libraries, monkeypatch):
    texts = [t for t in awkward() if t is None or len(t) < 50000] + ODD + ["word " * 3000]
    want = brute(libraries, texts)
    docs = table(spark, texts)
    got = A.alignment(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    check(got.collect(), want)
    for frequent in (0, 3, 40):  # most pairs, and all, come through the join
        monkeypatch.setattr(A, "FREQUENT", frequent)
        monkeypatch.setattr(A, "HELD", 5)
        monkeypatch.setattr(A, "BATCH", 300)
        check(A.alignment(docs.repartition(5)).collect(), want)


def test_the_fast_path_is_most_of_a_text(libraries):
    pair = A.load(*PATHS)
    text = "The people of the town were happy with their house and the small garden " * 3
    (x,) = A.align(pair, [text])
    assert len(x["id_n"]) and sum(memoryview(x["id_n"]).cast("q")) > 0.9 * x["n_links"]
    assert all(s < 0 or pair.a[i] == pair.b[s] for i, s in enumerate(pair.same)) and (pair.same >= 0).sum() > 10_000


def test_quick_encoder_equals_the_library(libraries):
    pair = A.load(*PATHS)
    texts = [f" a{''.join(f'{chr(c)}b {chr(c)}{chr(c)}1' for c in range(k, k + 64) if not 0xD800 <= c < 0xE000)}" for k in range(0, 0x30000, 64)]
    texts += ["z" * 300_000, "\n" * 100_000]
    for text, e in zip(texts, libraries[0].encode_batch(texts, add_special_tokens=False)):
        assert pair.encode_a(text) == e.ids
    monkey = type("Fails", (), {"encode_ordinary": lambda self, text: (_ for _ in ()).throw(BaseException("panic"))})()
    quick, pair._a = pair._a, monkey
    try:
        assert pair.encode_a(" some text") == libraries[0].encode(" some text").ids
    finally:
        pair._a = quick


def test_repeated_rows_null_ids_and_empty_tables(spark, libraries):
    texts = ["same text here"] * 4 + [None, ""]
    rows = A.alignment(table(spark, texts, ids=[1, 1, None, None, None, 2])).collect()
    want = brute(libraries, texts)
    assert sorted(tuple(r)[1:] for r in rows) == sorted(want) and sorted(str(r.doc_id) for r in rows) == ["1", "1", "2", "None", "None", "None"]
    assert A.alignment(empty(spark)).count() == 0
