"""Connected components against union-find, over sorted and shuffled chains, stars and random links."""

import random

from quillon.operators.graph import connected_components


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for scope, a, b in edges:
        if a != b:
            x, y = find((scope, a)), find((scope, b))
            parent[max(x, y)] = min(x, y)
    return {k: find(k)[1] for k in parent}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    chain = rng.sample(range(3000), 3000)
    edges = [(0, a, b) for a, b in zip(chain, chain[1:])] + [(1, i, i + 1) for i in range(300)] + [(2, 999, i) for i in range(500)]
    edges += [(3, rng.randrange(900), rng.randrange(900)) for _ in range(400)] + [(4, 7, 7)]
    df = spark.createDataFrame(edges, "s int, a long, b long")
    assert {(r.s, r.id): r.root for r in connected_components(df, "a", "b", ["s"]).collect()} == union_find(edges)
    assert connected_components(df.limit(0), "a", "b", ["s"]).count() == 0
