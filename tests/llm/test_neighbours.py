import numpy as np
from pyspark.sql import functions as F

from readlake.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int, node long, code binary, query long"


def frame(spark, vectors, ids=None):
    rows = [(i, v, 0, -1, b"x", -1) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(vectors, ids, queries, k=20):
    rows = {(i, tuple(np.float32(v).tolist())) for i, v in zip(ids, vectors) if i is not None and usable(v)}
    out = {}
    for q in queries:
        score = {}
        for own in [v for i, v in rows if i == q]:
            for i, v in rows:
                if i != q and len(v) == len(own):
                    score[i] = max(score.get(i, -np.inf), float(np.dot(own, v)))
        if any(i == q for i, _ in rows):
            out[q] = sorted(((-s, i) for i, s in score.items()))[:k]
    return out


def recall(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r)
    assert set(got) <= set(want)
    hits = 0
    for q, best in want.items():
        own = sorted(got.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(best) + 1))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        least = best[-1][0] + 1e-9 if best else 0
        hits += sum(-r.score <= least for r in own)
    return hits / sum(map(len, want.values()))


def lists_of(df):
    return {r.node: np.frombuffer(r.ids, np.int64) for r in df.collect()}


def test_recall_on_vectors_of_all_lengths(spark, monkeypatch):
    """Small lists and stretches, so that the rounds and the walk have work to do."""
    for name, value in (("WIDTH", 24), ("SORTINGS", 3), ("STRETCH", 40), ("OFFERED", 8), ("POOL", 40), ("BLOCK_BITS", 6)):
        monkeypatch.setattr(N, name, value)
    r = np.random.default_rng(2)
    x = r.standard_normal((1500, 16)) * np.exp(0.2 * r.standard_normal((1500, 1)))
    x[:300] = x[0] + 0.05 * r.standard_normal((300, 16))
    vectors = [list(map(float, v)) for v in x]
    want = brute(vectors, range(1500), range(0, 1500, 20))
    rows = N.nearest(frame(spark, vectors), F.col("query_id") % 20 == 0).collect()
    assert recall(rows, want) >= 0.95
    for r_ in rows[:200]:
        assert abs(r_.score - np.dot(np.float32(x[r_.query_id]).astype(float), np.float32(x[r_.vec_id]).astype(float))) < 1e-12


def test_rounds_find_most_of_the_graph(spark, monkeypatch):
    for name, value in (("WIDTH", 20), ("SORTINGS", 2), ("STRETCH", 32), ("OFFERED", 5)):
        monkeypatch.setattr(N, name, value)
    r = np.random.default_rng(5)
    x = r.standard_normal((800, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes = N.numbered(N.coded(N.nodes_of(frame(spark, [list(map(float, v)) for v in x]), "vec_id", "embedding", 21)))
    vec = {q.node: q.vec for q in codes.collect()}
    named = lambda df: {vec[i]: np.array([vec[j] for j in v.tolist()]) for i, v in lists_of(df).items()}
    near = x @ x.T
    np.fill_diagonal(near, -9)
    truth = np.argsort(-near, axis=1)[:, :10]
    share = lambda lists: np.mean([len(set(lists[i].tolist()) & set(truth[i].tolist())) / 10 for i in range(800)])
    found = named(N.neighbour_lists(codes))
    first, last = share(named(N.started(codes))), share(found)
    assert first < 0.6 and last > 0.95
    assert all(len(v) == 20 and len(set(v.tolist())) == 20 and i not in v for i, v in found.items())


def test_one_round_is_the_join_of_neighbours_of_neighbours(spark, monkeypatch):
    """From given lists a round finds what bringing every list together by hand finds."""
    monkeypatch.setattr(N, "WIDTH", 6)
    monkeypatch.setattr(N, "BLOCK_BITS", 4)
    r = np.random.default_rng(7)
    x = r.standard_normal((60, 8))
    codes = N.saved(N.coded(N.nodes_of(frame(spark, [list(map(float, v)) for v in x]), "vec_id", "embedding", 21)))
    got = {q.node: N._decoded([bytes(q.code)])[0, :-1] for q in codes.collect()}
    near = np.array([[got[i] @ got[j] for j in range(60)] for i in range(60)], np.float32)
    start = {i: r.permutation([j for j in range(60) if j != i])[:6] for i in range(60)}
    start = {i: v[np.lexsort((v, -near[i, v]))] for i, v in start.items()}
    fresh = {i: r.integers(0, 2, 6).astype(np.int8) for i in range(60)}
    lists = spark.createDataFrame([(i, i >> 4, v.astype(np.int64).tobytes(), near[i, v].tobytes(), fresh[i].tobytes()) for i, v in start.items()], N._LISTS)
    want = {i: set(v.tolist()) for i, v in start.items()}
    for v in range(60):
        own = [*zip(start[v].tolist(), fresh[v].tolist()), (v, 1)]
        for a, new_a in own:
            for b, new_b in own:
                if a != b and (new_a or new_b):
                    want[a].add(b)
    out = lists_of(N.descended(lists, codes))
    for i, offered in want.items():
        best = sorted(offered, key=lambda j: (-near[i, j], j))[:6]
        assert np.allclose(sorted(near[i, best]), sorted(near[i, out[i]]), atol=1e-6)


def test_awkward_vectors_copies_and_ids(spark):
    nan, inf = float("nan"), float("inf")
    r = np.random.default_rng(1)
    vectors = [list(map(float, r.standard_normal(8))) for _ in range(70)]
    vectors += [vectors[0]] * 60 + [None, [], [0.0] * 8, [nan] + [1.0] * 7, [inf] + [1.0] * 7, [None] + [1.0] * 7]
    vectors += [[1.0, 2.0, 3.0], [2.0, 1.0, 0.5], [3e38] * 8, [1e-30] * 8, vectors[3], vectors[4], vectors[5]]
    ids = [*range(136), 200, 220, 240, 260, 20, 20, None]
    want = brute(vectors, ids, range(0, 261, 20))
    rows = N.nearest(frame(spark, vectors, ids), F.col("query_id") % 20 == 0).collect()
    assert recall(rows, want) == 1.0
    assert {q: len(v) for q, v in want.items()}[200] == 1 and not any(r.query_id in (140, 160) for r in rows)
    zero = [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == 0]
    assert zero == [i for _, i in want[0]]


def test_a_third_of_all_rows_is_one_vector(spark):
    r = np.random.default_rng(3)
    vectors = [[1.0, 0.5, 0.25]] * 400 + [list(map(float, r.standard_normal(3))) for _ in range(300)]
    rows = N.nearest(frame(spark, vectors), F.col("query_id") % 20 == 0).collect()
    assert recall(rows, brute(vectors, range(700), range(0, 700, 20))) >= 0.99


def test_few_rows_and_none(spark):
    few = [[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]]
    rows = N.nearest(frame(spark, few), F.col("query_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"])] == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert N.nearest(frame(spark, [[1.0]]), F.col("query_id") % 20 == 0).count() == 0
    assert N.nearest(frame(spark, []), F.col("query_id") % 20 == 0).count() == 0
