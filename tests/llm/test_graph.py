import random

from readlake.llm.graph import components


def test_components_by_brute_force(spark):
    r = random.Random(4)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1300)] + [(5000, x) for x in range(5001, 5200)] + [(7, 7), (8, 9), (9, 8)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
