import numpy as np

from readlake.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, bucket long"


def frame(spark, vectors, ids=None):
    rows = [(i, v, 0, -1, -1) for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(vectors, least=0.9):
    good = [i for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(vectors))}
    for a in good:
        for b in good:
            if a < b and len(vectors[a]) == len(vectors[b]):
                x, y = np.float32(vectors[a]).astype(float), np.float32(vectors[b]).astype(float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[a].add(b)
                    links[b].add(a)
    component = {}
    for i in links:
        todo = [] if i in component else [i]
        while todo:
            x = todo.pop()
            if x not in component:
                component[x] = i
                todo += links[x]
    return links, component


def vectors():
    r = np.random.default_rng(1)
    out = [list(map(float, r.standard_normal(16))) for _ in range(60)]
    for size, noise in ((90, 0.1), (20, 0.25)):
        base = r.standard_normal(16)
        out += [list(map(float, base + noise * r.standard_normal(16))) for _ in range(size)]
    nan, inf = float("nan"), float("inf")
    return out + [out[0]] * 3 + [[2.0 * x for x in out[1]], None, [], [0.0] * 16, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [2.0] * 8, [3e38] * 16, [1e-30] * 16]


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    v = vectors()
    links, component = brute(v)
    rows = {r.vec_id: r for r in E.near_vectors(frame(spark, v)).collect()}
    assert len(rows) == len(v)
    assert all(rows[i].n_links <= len(links[i]) for i in links)
    total = sum(map(len, links.values()))
    assert total > 4000 and sum(r.n_links for r in rows.values()) >= 0.97 * total
    assert sum(rows[i].component_id != component[i] for i in component) <= 1
    for i in range(len(v) - 10, len(v) - 4):
        assert (rows[i].n_links, rows[i].component_id, rows[i].kept) == (0, i, True)
    assert rows[0].n_links == 3 and rows[len(v) - 13].component_id == 0


def test_lengths_that_share_buckets(spark, monkeypatch):
    """One vector of another length in a bucket costs the others no link."""
    v = [[1.0, k / 50, 0.0] for k in range(6)] + [[1.0, 0.5], [1.0, 0.6], [0.0] * 4 + [1.0]]
    links, component = brute(v)
    zero = bytes(4 * E.TABLES)
    monkeypatch.setattr(E, "_hashed", lambda classes: classes.selectExpr("rep", f"unhex('{zero.hex()}') keys"))
    got = {r.vec_id: r for r in E.near_vectors(frame(spark, v)).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    assert {i: r.component_id for i, r in got.items()} == component


def test_repeated_ids_and_empty_table(spark):
    rows = E.near_vectors(frame(spark, [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]], ids=[4, 4, None])).collect()
    assert sorted((r.vec_id or -1, r.n_links) for r in rows) == [(-1, 0), (4, 1), (4, 1)]
    assert E.near_vectors(frame(spark, [])).count() == 0


def test_recall_of_the_tables():
    r = np.random.default_rng(3)
    x = r.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = r.standard_normal((4000, 64))
    y -= (x * y).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    tables = E.hash_tables(64)
    for cosine, least in ((0.9, 0.93), (0.95, 0.995)):
        z = cosine * x + np.sqrt(1 - cosine**2) * y
        met = (E.bucket_keys(x, *tables) == E.bucket_keys(z, *tables)).any(1).mean()
        assert met > least
