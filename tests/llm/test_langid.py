import random
import zlib

import numpy as np
import pytest

from readlake.llm import langid as L

from .data import empty, table

SYLLABLES = {"aa": "ba ko ti mu".split(), "bb": "ster eng lich auf".split(), "cc": "ción ñe llo ar".split()}


def text(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randrange(1, 4))) for _ in range(n))


def corpus(n=400):
    r = random.Random(2)
    langs = [r.choice(list(SYLLABLES)) for _ in range(n)]
    return [text(r, lang, r.randrange(3, 60)) for lang in langs], langs


def test_marginals_are_forward_backward():
    r = np.random.default_rng(0)
    for _ in range(20):
        counts = r.integers(1, 90, 5)
        scores, transitions = 2 * r.standard_normal((counts.sum(), 3)), r.standard_normal((3, 3))
        got, at = L.marginals(scores, counts, transitions), 0
        for n in counts:
            e, a = np.exp(scores[at : at + n]), np.exp(transitions)
            forward, x = [], np.ones(3)
            for t in range(n):
                x = (x @ a) * e[t]
                x /= x.sum()
                forward.append(x)
            backward, y = [None] * n, np.ones(3)
            for t in range(n - 1, -1, -1):
                backward[t] = y
                y = a @ (e[t] * y)
                y /= y.sum()
            want = np.array(forward) * np.array(backward)
            assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
            at += n


def test_expected_transitions_are_the_chain_s():
    r = np.random.default_rng(1)
    scores, transitions = r.standard_normal((6, 3)), r.standard_normal((3, 3))
    chances = L.marginals(scores, np.array([6]), transitions)
    got = L._pairs(scores, chances, np.arange(5), np.arange(1, 6), transitions)
    # brute force over all paths, with the same virtual word before the first
    want, total = np.zeros((3, 3)), 0.0
    for path in np.ndindex(*[3] * 6):
        w = np.exp(transitions[:, path[0]]).sum() * np.exp(sum(scores[t, p] for t, p in enumerate(path)) + sum(transitions[p, q] for p, q in zip(path, path[1:])))
        total += w
        for p, q in zip(path, path[1:]):
            want[p, q] += w
    assert np.allclose(got, want / total, atol=1e-3)


def test_held_out_accuracy_and_code_switching(spark):
    texts, langs = corpus()
    special = [None, "", "12 34 ?!", "“”…", "é", "ba " * 30000]
    docs = table(spark, texts + special, langs=langs + [None] * len(special))
    rows = {r.doc_id: r for r in L.identify(docs).collect()}
    assert len(rows) == len(texts) + len(special)
    out = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in rows)
    assert sum(rows[i].lang_pred == langs[i] for i in out) / len(out) > 0.97
    n = len(texts)
    assert [(rows[n + k].lang_pred, rows[n + k].score) for k in range(4)] == [("und", 0.0)] * 4
    assert rows[n + 4].lang_pred != "und" and rows[n + 5].lang_pred == "aa" and all(0 <= r.score <= 1 for r in rows.values())
    model = L.fit(L.training_sample(docs))
    r = random.Random(9)
    chances, _ = L.label_words(model, [L.prepare((text(r, "aa", 30) + " " + text(r, "bb", 30)).encode())])
    labels = [model.labels[k] for k in chances.argmax(1)]
    assert labels[:27].count("aa") >= 25 and labels[-27:].count("bb") >= 25


def test_prediction_sees_the_text_only(spark):
    texts, langs = corpus(120)
    model = L.fit(list(zip(langs, (t.encode() for t in texts))))
    one = {r.doc_id: r.lang_pred for r in L.identify(table(spark, texts, langs=langs), model).collect()}
    two = {r.doc_id: r.lang_pred for r in L.identify(table(spark, texts, langs=langs[::-1], sources=["z"] * 120, ids=list(range(1000, 1120))), model).collect()}
    assert [one[i] for i in range(120)] == [two[1000 + i] for i in range(120)]
    assert L.predict(model, [t.encode() for t in texts])[7][0] == L.predict(model, [texts[7].encode()])[0][0]


def test_nothing_to_learn_from(spark):
    assert [r.lang_pred for r in L.identify(table(spark, ["hello there"])).collect()] == ["und"]
    assert L.identify(empty(spark)).count() == 0 and L.keep_identified(empty(spark), 0.5).count() == 0


def test_filter_keeps_rows_whole(spark):
    texts, langs = corpus(60)
    docs = table(spark, texts + [None, "123"], langs=langs + [None, None])
    kept = L.keep_identified(docs, 0.4)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == set(range(60)) and rows[5].text == texts[5] and rows[5].base == "x"


def test_filter_keeps_code_switched_texts(spark):
    r = random.Random(4)
    own = {"aa": "ba ko ti mu".split(), "bb": "ster eng lich auf".split(), "cc": "ción ñe llo ar".split(), "dd": "wyz prz szc dło".split()}
    say = lambda lang, n: " ".join("".join(r.choices(own[lang], k=r.randrange(1, 4))) for _ in range(n))
    model = L.fit([(lang, say(lang, 40).encode()) for lang in own for _ in range(60)])
    texts = [" ".join(say(lang, 30) for lang in langs) for langs in (["aa", "bb", "cc"], ["bb", "cc", "dd"], list(own), list(own)[::-1])]
    assert all(score < 0.4 for _, score in L.predict(model, [t.encode() for t in texts]))
    kept = L.keep_identified(table(spark, [*texts, "12 34", None]), 0.4, model)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("size", [3, 4, 64])
def test_filter_rejects_what_the_model_is_lost_about(spark, size):
    lost = L.Model([f"l{k:02}" for k in range(size)], np.zeros((3 * L.TABLE + 1, size), np.float32), np.zeros((size, size)), np.zeros(0, np.uint64))
    assert L.keep_identified(table(spark, ["ba ko ti", "mu " * 50]), 0.4, lost).count() == 0
    lost.weights[:, 1:3] = 0.5  # split between two related languages
    assert L.keep_identified(table(spark, ["ba ko ti", "mu " * 50]), 0.4, lost).count() == 2


@pytest.mark.parametrize("word", ["a", "ab", "straße"])
def test_word_features_have_one_entry_each(word):
    data = np.frombuffer(L.prepare(word.encode()), np.uint8)
    features, begin = L.word_features(data, np.zeros(0, np.uint64))
    assert begin.tolist() == [0] and len(features) == 2 * len(word.encode()) + 4 and features[-1] == 3 * L.TABLE
