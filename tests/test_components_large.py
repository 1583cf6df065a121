import random

import pytest

from loomspan.operators import components as c


@pytest.mark.parametrize("large", [c.LARGE, 10])
def test_smallest_node_of_dense_and_thin_graphs(spark, large, monkeypatch):
    sizes = []
    stars = c._stars
    monkeypatch.setattr(c, "_stars", lambda e, n: sizes.append(e.count()) or stars(e, n))
    rnd = random.Random(2)
    block = lambda lo: [(lo + rnd.randrange(30), lo + rnd.randrange(30)) for _ in range(700)]
    # an edge that is no node's first or last joins blocks; a chain and loops beside them
    edges = block(0) + block(100) + block(200) + [(15, 115)] + [(i, i + 1) for i in range(300, 320)] + [(400, 400), (None, 5), (0, 29), (100, 129)]
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    got = c.connected_components(spark.createDataFrame(edges, "a int, b int"), large=large)
    assert sorted((r.node, r.component) for r in got.collect()) == sorted(root.items())
    edges_in = len({frozenset(e) for e in edges if None not in e and e[0] != e[1]})
    assert sizes[0] == edges_in if large == c.LARGE else sizes[0] * 2 <= edges_in
