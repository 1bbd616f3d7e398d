import hashlib
import random
import zlib

from pyspark.sql import functions as F

from readlake.llm import merkle as M

from .data import awkward, empty, table


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes):
    """The root of a list of nodes and each one's siblings on the way, as (left, right) by level."""
    proofs, place, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[k : k + M.FANOUT] for k in range(0, len(level), M.FANOUT)]
        for i, at in enumerate(place):
            run = runs[at // M.FANOUT]
            proofs[i].append(("".join(run[: at % M.FANOUT]), "".join(run[at % M.FANOUT + 1 :])))
            place[i] = at // M.FANOUT
        level = [h(*run) for run in runs]
    return level[0] if level else None, proofs


def brute(rows):
    def leaf(r, text):
        return h(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))

    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    out, subroots, proofs = [], [], {}
    for s in names:
        own = sorted(groups[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        top, inner = tree([leaf(r, r.text) for r in own])
        subroots.append(top)
        proofs[s] = (own, inner)
    root, upper = tree(subroots)
    for s, sub, more in zip(names, subroots, upper):
        for r, inner in zip(*proofs[s]):
            text = r.text
            if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            x = leaf(r, text)
            for left, right in inner + more:
                x = h(left, x, right)
            proof = h(*(a + b for a, b in inner + more))
            out.append((r.doc_id, leaf(r, r.text), sub, root, proof, x, x == root))
    return sorted(out, key=str)


def got(docs):
    rows = M.manifest(docs).drop("source")
    assert rows.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, rows.collect()), key=str)


def test_equals_the_plain_tree_on_awkward_rows(spark):
    texts = awkward() + ["Any Text With Capitals"] * 3
    ids = list(range(len(texts) - 4)) + [None, None, 7, 7]
    docs = table(spark, texts, ids=ids)
    want = brute(docs.collect())
    assert got(docs) == want
    assert {x[-1] for x in want} == {True, False} and got(docs.repartition(7)) == want


def test_many_levels_and_ragged_ends(spark, monkeypatch):
    """Small runs and parts: several rounds inside the sources and above them, incomplete everywhere."""
    r = random.Random(4)
    sizes = [1, 2, 3, 4, 5, 8, 9, 10, 17, 26, 27, 28, 81, 82, 100]
    sources = [None if k == 4 else f"ü{k:02}" for k, n in enumerate(sizes) for _ in range(n)]
    r.shuffle(sources)
    docs = table(spark, [f"Text {r.random()}" for _ in sources], sources)
    monkeypatch.setattr(M, "FANOUT", 3)
    for inner in (1, 2):
        monkeypatch.setattr(M, "INNER", inner)
        assert got(docs) == brute(docs.collect())
    monkeypatch.setattr(M, "FEW_SOURCES", 2)
    assert got(docs) == brute(docs.collect())


def test_a_hot_row_and_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(M, "INNER", 1)
    docs = table(spark, ["Same"] * 300 + [f"t{i}" for i in range(40)], ["hot"] * 310 + ["x"] * 30, ids=[5] * 300 + list(range(40)))
    assert got(docs) == brute(docs.collect())


def test_small_tables(spark):
    assert M.manifest(empty(spark)).count() == 0
    for texts in ([None], ["A"], ["A", "A"]):
        docs = table(spark, texts, ["s"] * len(texts))
        assert got(docs) == brute(docs.collect())
    (x,) = got(table(spark, ["A"], [None], ids=[1]))
    assert x[1] == x[2] == x[3] and x[4] == h()


def test_each_part_gets_one_message_of_each_sibling(spark):
    """No round makes more than FANOUT rows a part, though one source has far more parts than others."""
    sources = ["hot"] * 4000 + [f"s{k}" for k in range(20)]
    docs = table(spark, [f"t{i}" for i in range(4020)], sources)
    parts = M.parts_of(M.numbered(M.leaves_of(docs)))
    up = M.exchanged(parts)
    assert up.count() == parts.count() == 36 and up.select("root").distinct().count() == 1
    lanes = M._lanes(M._ranked(parts.groupBy("source").agg(F.count(F.lit(1)).alias("units"))), 2)
    sent = sum(x.units // x.levels[0].members * x.levels[0].lanes for x in lanes.collect())
    assert sent <= M.FANOUT * 36


def test_saved_parts_are_as_large_as_their_leaves(spark):
    """Siblings are some 15 digests a leaf and level; a task holds thousands of parts at once, so they have none."""
    docs = table(spark, [f"t{i}" for i in range(600)], ["s"] * 600)
    parts = M.parts_of(M.numbered(M.leaves_of(docs)))
    size = parts.selectExpr("max(octet_length(to_json(leaves)) / size(leaves)) AS bytes").first().bytes
    assert size < 250 and got(docs) == brute(docs.collect())
