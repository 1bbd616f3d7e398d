"""Small document tables with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, bucket long, base string, s string, k_doc string, copies long"


def table(spark, texts, sources=None, langs=None, ids=None):
    """Documents of the texts, with further columns whose names the operators use themselves."""
    n = len(texts)
    ids = ids if ids is not None else list(range(n))
    sources = sources or [None if i % 7 == 6 else f"s{i % 3}" for i in range(n)]
    langs = langs or [None] * n
    rows = [(i, t, lang, s, len(t) if t is not None else None, -1, -1, -1, "x", "y", "z", -1) for i, t, lang, s in zip(ids, texts, langs, sources)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def awkward(seed=0):
    """Texts: null, empty, blank, one word, long, equal ones, non-ASCII, and ordinary ones."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["été", "straße", "İst", "你好", "Released", "under", "the", "MIT", "License."]
    texts = [None, "", "  \n\t", "one", "one", "été", "a" * 5000, "word " * 30000]
    texts += [" ".join(r.choices(words, k=r.randrange(1, 120))) for _ in range(60)]
    return texts + [texts[20]] * 5 + [texts[21] + " tail"]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
