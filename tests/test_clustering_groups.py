import random
from itertools import combinations

import pytest

from loomspan.operators import graphs as g


@pytest.mark.parametrize("group", [g.GROUP, 7])
def test_groups_find_every_triangle(spark, group):
    rnd = random.Random(5)
    pairs = [(f"n{rnd.randrange(40):02}", f"n{rnd.randrange(40):02}") for _ in range(260)] + [("hub", f"n{i:02}") for i in range(40)] + [("x", "y"), ("x", None)]
    near: dict = {}
    for a, b in pairs:
        if b and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for x, n in near.items():
        links = sum(b in near[a] for a, b in combinations(n, 2))
        want[x] = (len(n), links, pytest.approx(2 * links / (len(n) * (len(n) - 1)) if len(n) > 1 else 0.0))
    out = g.clustering(spark.createDataFrame(pairs, "src string, dst string"), group)
    assert {r.node: (r.k, r.links, r.coefficient) for r in out.collect()} == want
    # a list is sent to groups of nodes and not joined to each edge
    assert "array_intersect" not in out._jdf.queryExecution().toString()
    assert g.clustering(spark.createDataFrame([], "src long, dst long"), group).count() == 0
