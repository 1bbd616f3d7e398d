import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from readlake.llm import common as C
from readlake.llm import sharding as K

from .data import awkward, empty, table


def shards(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    return by


def test_sizes_slots_and_groups(spark):
    r = random.Random(1)
    texts = awkward()[:7] + [" ".join(["w"] * r.randrange(1, 40)) + str(i) for i in range(3000)]
    texts += [texts[50]] * 4 + ["hot copy " * 9] * 1500 + [None] * 3
    sources = [None if i % 9 == 1 else "hot" if i % 3 else f"s{i % 20}" for i in range(len(texts))]
    rows = K.shard_documents(table(spark, texts, sources)).collect()
    assert len(rows) == len(texts)
    total = sum(x.size for x in rows)
    for x in rows:
        raw = (texts[x.doc_id] or "").encode()
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    by = shards(rows)
    assert set(by) == set(range(8))
    for own in by.values():
        assert abs(sum(x.size for x in own) - total / 8) < 0.02 * total / 8
        assert sorted(x.slot for x in own) == list(range(len(own)))
    of = defaultdict(set)
    for x in rows:
        of[texts[x.doc_id]].add(x.shard)
    assert len(of[texts[50]]) == 1 and len(of["hot copy " * 9]) > 1  # small groups stay together, a hot one can't
    again = K.shard_documents(table(spark, texts, sources).repartition(5)).collect()
    assert {(x.doc_id, x.shard, x.slot) for x in again} == {(x.doc_id, x.shard, x.slot) for x in rows}


def test_splits_are_weighted_medians(spark):
    """Against a plain recursion on the same points, one dimension at a time."""
    r = random.Random(2)
    points = [(r.randrange(1 << 20), r.randrange(1 << 18), r.randrange(1, 50), i) for i in range(400)]
    df = spark.createDataFrame(points, "a long, b long, w long, t long").withColumn("u", F.lit(0))
    got = {x.t: x.shard for x in K.kd_leaves(df, ["a", "b"], "w", ["t", "u"], 5).collect()}
    whole = [max(p[d] for p in points) - min(p[d] for p in points) for d in (0, 1)]
    want = {}

    def split(own, shard, n):
        if n == 1:
            want.update({p[3]: shard for p in own})
            return
        d = max((0, 1), key=lambda d: ((max(p[d] for p in own) - min(p[d] for p in own)) / whole[d], -d))
        own = sorted(own, key=lambda p: (p[d], p[3]))
        target, run, cut = sum(p[2] for p in own) * (n // 2) / n, 0, 0
        for k, p in enumerate(own):
            run += p[2]
            if run >= target:
                cut = k + 1 if run - target <= target - (run - p[2]) else k
                break
        split(own[:cut], shard, n // 2)
        split(own[cut:], shard + n // 2, n - n // 2)

    split(points, 0, 5)
    assert got == want and len(Counter(want.values())) == 5


def test_equal_texts_stay_together(spark):
    """Every group that is no more than a fourth of a shard, also one of many rows or of long texts."""
    r = random.Random(5)
    texts = [" ".join(r.choices("abcdefgh", k=r.randrange(5, 400))) for _ in range(500)]
    texts += [t for t in texts[:60] for _ in range(r.randrange(1, 6))] + ["many copies"] * 300
    rows = K.shard_documents(table(spark, texts)).collect()
    of, weight, total = defaultdict(set), Counter(), sum(x.size for x in rows)
    for x in rows:
        of[texts[x.doc_id]].add(x.shard)
        weight[texts[x.doc_id]] += x.size
    assert all(len(of[t]) == 1 for t in of if weight[t] <= total / 32)
    assert all(abs(sum(x.size for x in own) - total / 8) < 0.1 * total / 8 for own in shards(rows).values())


def test_target_bytes_give_the_number_of_leaves(spark):
    texts = [f"document number {i} " * (1 + i % 7) for i in range(900)]
    rows = K.shard_documents(table(spark, texts), target_bytes=1500).collect()
    n = -(-sum(x.size for x in rows) // 1500)
    by = shards(rows)
    assert set(by) == set(range(n)) and n > 30 and max(sum(x.size for x in own) for own in by.values()) < 1.2 * 1500


def test_rows_that_repeat_very_often(spark, monkeypatch):
    monkeypatch.setattr(C, "COPIES", 100)
    rows = K.shard_documents(table(spark, ["same"] * 700 + ["x", None], ids=[None] * 700 + [1, 2])).collect()
    assert len(rows) == 702
    for own in shards(rows).values():
        assert sorted(x.slot for x in own) == list(range(len(own)))


def test_few_rows(spark):
    assert K.shard_documents(empty(spark)).count() == 0
    rows = K.shard_documents(table(spark, ["a", "a", None], ids=[1, 1, None])).collect()
    assert len(rows) == 3 and all(0 <= x.shard < 8 for x in rows)


def test_native_plan(spark):
    plan = K.shard_documents(table(spark, awkward()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
