import random

import numpy as np
from pyspark.sql import functions as F

from readlake.llm import toxicity as T

from .data import empty, table

BAD = ["scumbag", "moronic", "filthier"]


def corpus(n=900):
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts, quality, toxic = [], [], []
    for _ in range(n):
        low, bad = r.random() < 0.3, r.random() < 0.2
        own = r.choices(words, k=r.randrange(5, 60)) + ["spam"] * (2 * low)
        if bad:
            own.insert(r.randrange(len(own)), r.choice(BAD).upper() + "!")
        r.shuffle(own)
        texts.append(" ".join(own))
        quality.append(0 if low else 1)
        toxic.append(int(bad))
    return texts, quality, toxic


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    texts, quality, toxic = corpus()
    special = [None, "", "moronic " * 20000]
    marked = labels(spark, [(i, quality[i], toxic[i]) for i in range(600)] + [(5, None, 1), (None, 1, 1), (10**6, 1, 1)])
    rows = {r.doc_id: r for r in T.toxicity(table(spark, texts + special), marked).collect()}
    assert len(rows) == len(texts) + 3
    for name, want in (("toxic", toxic), ("low_quality", [1 - q for q in quality])):
        assert np.mean([getattr(rows[i], name) == bool(want[i]) for i in range(600, 900)]) > 0.97
    n = len(texts)
    assert not rows[n].toxic and rows[n].toxic_score == rows[n + 1].toxic_score and rows[n + 2].toxic


def test_later_models_see_earlier_chances():
    """A category that follows the first one and says nothing in its own words."""
    r = np.random.default_rng(0)
    first = r.random(2000) < 0.4
    second = first ^ (r.random(2000) < 0.05)
    ids = [np.array(sorted(T.word_ids(b"signal") if a else T.word_ids(b"other"))) for a in first]
    chain = T.fit_chain(ids, [("a", first), ("b", second)])
    assert len(chain[1].earlier) == 1
    p = T.predict(chain, [b"signal", b"other"])
    assert p[0, 1] > 0.8 > 0.3 > p[1, 1]


def test_models_are_plain_logistic_regressions():
    """The sparse fit against the same steps on a dense matrix, and predictions word by word."""
    r = np.random.default_rng(3)
    words = [f"u{k}".encode() for k in range(40)]
    texts = [b" ".join(r.choice(words, 12)) for _ in range(300)]
    y = np.array([b"u1 " in t + b" " or b"u2 " in t + b" " for t in texts], float)
    ids = [np.array(sorted(i for w in T.distinct_words(t) for i in T.word_ids(w))) for t in texts]
    rows = T._Rows(ids)
    extra = r.random((300, 1))
    got_w, got_v, got_b = T._fit(rows, extra, y, np.ones(300, bool))
    columns = rows.choose(y, T.KEPT, np.ones(300, bool))
    x = np.zeros((300, len(columns)))
    for n, own in enumerate(ids):
        for j, c in enumerate(columns):
            x[n, j] = rows.names[c] in set(own.tolist())
    w, v, b = np.zeros(len(columns)), np.zeros(1), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    sw, sv, sb = np.full(len(w), 1e-8), np.full(1, 1e-8), 1e-8
    for _ in range(T.PASSES):
        e = (1 / (1 + np.exp(-np.clip(x @ w + extra @ v + b, -30, 30))) - y) / 300
        gw, gv, gb = x.T @ e + T.PENALTY * w, extra.T @ e + T.PENALTY * v, e.sum()
        sw, sv, sb = sw + gw**2, sv + gv**2, sb + gb**2
        w, v, b = w - T.STEP * gw / np.sqrt(sw), v - T.STEP * gv / np.sqrt(sv), b - T.STEP * gb / np.sqrt(sb)
    assert len(columns) and np.allclose(got_w[columns], w, atol=1e-6) and np.allclose(got_v, v, atol=1e-6) and abs(got_b - b) < 1e-6
    chain = T.fit_chain(ids, [("a", y > 0), ("b", y < 1)])
    p = T.predict(chain, texts[:20])
    for n, t in enumerate(texts[:20]):
        earlier = []
        for link in chain:
            score = sum(float(link.weights[i]) for word in T.distinct_words(t) for i in T.word_ids(word)) + float(np.dot(link.earlier, earlier)) + link.bias
            earlier.append(1 / (1 + np.exp(-score)))
        assert np.allclose(p[n], earlier, atol=1e-4)


def test_constant_labels_and_no_rows(spark):
    docs = table(spark, ["some text", None])
    rows = T.toxicity(docs, labels(spark, [(0, 1, 0)])).collect()
    assert len(rows) == 2 and not any(r.toxic for r in rows)
    assert T.toxicity(docs, labels(spark, [])).count() == 2
    assert T.toxicity(empty(spark), labels(spark, [])).count() == 0


def test_a_labelled_id_on_very_many_rows(spark):
    """Equal rows are one, and no more rows than the bound are featurised, whatever an id repeats."""
    docs = spark.createDataFrame([(1, "same text") for _ in range(3000)] + [(2, f"text {i}") for i in range(3000)] + [(i, f"word {i}") for i in range(3, 40)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    ids, marked = T.training_rows(docs, labels, [("toxic", F.col("toxic"))], most=50)
    assert len(ids) == 50 == len(marked[0][1])
    ids, _ = T.training_rows(docs.where("doc_id <> 2"), labels, [("toxic", F.col("toxic"))], most=50)
    assert len(ids) == 38
