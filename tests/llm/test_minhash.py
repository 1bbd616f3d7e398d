import random
import re
from itertools import combinations

import numpy as np

from readlake.llm import minhash as M
from readlake.llm.buckets import pairs_within

from .data import awkward, empty, table

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(texts, k, num=80, den=100):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(texts))]


def near_copies(r, n, size, changes):
    base = [f"b{r.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(r.randrange(*changes)):
            own[r.randrange(size)] = f"c{r.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def check(spark, texts, k):
    rows = {r.doc_id: r for r in M.near_duplicates(table(spark, texts), k).collect()}
    sets, want = groups(texts, k)
    assert len(rows) == len(texts)
    for i in range(len(texts)):
        assert (rows[i].n_shingles, rows[i].component_id, rows[i].kept) == (len(sets[i]), want[i], want[i] == i)


def test_groups_by_brute_force(spark):
    r = random.Random(5)
    texts = awkward() + ["The END", "the end", "THE end "] + [t for _ in range(12) for t in near_copies(r, r.randrange(2, 9), r.randrange(8, 90), (0, 6))]
    check(spark, texts, 2)


def test_large_group_with_stragglers(spark, monkeypatch):
    """Copies around the threshold: many pairs survive the sketches and fail on the full sets."""
    monkeypatch.setattr(M, "BLOCK", 40)
    r = random.Random(6)
    passage = [f"p{i}" for i in range(40)]
    shared = [" ".join([f"q{r.randrange(10**6)}" for _ in range(30)] + passage) for _ in range(40)]
    check(spark, near_copies(r, 160, 120, (4, 22)) + shared, 5)


def test_round_two_deals_pairs_of_blocks(spark, monkeypatch):
    """A template that many documents share: no group has more than two blocks, no pair meets twice."""
    monkeypatch.setattr(M, "BLOCK", 40)
    seen = []
    later = M._later_pairs
    monkeypatch.setattr(M, "_later_pairs", lambda rows, threshold: seen.append(rows.collect()) or later(rows, threshold))
    r = random.Random(7)
    passage = [f"p{i}" for i in range(90)]
    texts = [" ".join(passage + [f"q{r.randrange(10**6)}" for _ in range(20)]) for _ in range(200)] + [" ".join(passage + [f"u{i}" for i in range(19)] + [f"v{k}"]) for k in range(90)]
    check(spark, texts, 2)
    groups, met, buckets = {}, {}, {}
    for row in seen[0]:
        groups.setdefault((row.bucket, row.part), []).append(row)
        buckets.setdefault(row.bucket, {})[row.set_id] = row.root
    assert max(map(len, buckets.values())) > 150 and max(map(len, groups.values())) <= 130
    for (bucket, _), rows in groups.items():
        for x, y in combinations(rows, 2):
            if x.root != y.root and (x.side == 0 or x.side != y.side):
                pair = (bucket, *sorted((bytes(x.set_id), bytes(y.set_id))))
                met[pair] = met.get(pair, 0) + 1
    assert set(met.values()) == {1}
    assert len(met) == sum(a != b for roots in buckets.values() for a, b in combinations(roots.values(), 2))


def test_pairs_between_sides():
    found = [(g, i, j) for part in pairs_within(np.array([3, 4, 2, 2]), 2, np.array([-1, 1, 0, 2])) for g, i, j in zip(*map(np.ndarray.tolist, part))]
    assert found == [(0, 0, 1), (0, 0, 2), (0, 1, 2), (1, 3, 4), (1, 3, 5), (1, 3, 6)]


def test_thresholds_of_the_posterior():
    least = M.least_matches(0.8, 1e-4)
    r = np.random.default_rng(0)
    for h, m in least.items():
        assert (r.binomial(h, 0.8, 20000) < m).mean() < 2e-3 and (r.binomial(h, 0.3, 20000) >= m).mean() < 0.02


def test_signature_estimates_similarity():
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[100:], np.random.default_rng(2).integers(0, 1 << 63, 100, dtype=np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((M.signature(a) == M.signature(b)).mean() - true) < 0.08


def test_ids_that_are_null_or_repeated(spark):
    texts = ["a b c d e f", "a b c d e f", "x y z", None, "a b c d e f"]
    rows = M.near_duplicates(table(spark, texts, ids=[None, 5, 7, 7, 5]), 2).collect()
    assert len(rows) == 5 and all(r.component_id == 5 for r in rows if r.n_shingles == 5)
    kept = M.keep_one_of_each(table(spark, texts, ids=[None, 5, 7, 7, 5]), 2)
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(5, "a b c d e f"), (7, ""), (7, "x y z")]


def test_near_copies_without_ids(spark):
    r = random.Random(8)
    two, bridged, alone = (near_copies(r, n, 60, (0, 3)) for n in (3, 2, 1))
    docs = table(spark, two + two[:1] + bridged + alone + [None], ids=[None] * 4 + [9, None, None, None])
    rows = M.near_duplicates(docs, 2).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows if r.component_id) == [(-1, 9, False), (9, 9, True)]
    kept = [r.text for r in M.keep_one_of_each(docs, 2).collect()]
    assert len(kept) == 4 and {bridged[0], alone[0], None} < set(kept) and len(set(kept) & set(two)) == 1


def test_bridge_without_id(spark):
    """a and b are linked only by way of a text that has no id."""
    words = [f"v{i}" for i in range(100)]
    texts = [" ".join(words[a : a + 80]) for a in (0, 8, 16)]
    rows = M.near_duplicates(table(spark, texts, ids=[1, None, 2]), 2).collect()
    assert [r.component_id for r in rows] == [1, 1, 1]


def test_empty_table(spark):
    assert M.near_duplicates(empty(spark)).count() == 0 and M.keep_one_of_each(empty(spark)).count() == 0
