import random

import pytest

from loomspan.operators.graphs import max_depth
from loomspan.operators.paths import closure, longest

E = "a int, b int"


def brute(edges, start, zero):
    out = set()
    for s in start:
        seen, todo = set(), [b for a, b in edges if a == s]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b for a, b in edges if a == x]
        out |= {(s, x) for x in seen} | ({(s, s)} if zero else set())
    return sorted(out)


@pytest.mark.parametrize("most", [(4, 100_000), (0, 0), (0, 60)])
def test_closure_of_random_graphs(spark, most):
    rng = random.Random(most[1])
    for n, m in ((12, 16), (30, 30), (40, 90)):
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
        start = rng.sample(range(n + 3), 6)
        for zero in (True, False):
            got = closure(spark.createDataFrame([*edges, (None, 1), (1, None)], E), spark.createDataFrame([(s,) for s in [*start, None, start[0]]], "a int"), zero, None, *most)
            assert sorted(tuple(r) for r in got.collect()) == brute(edges, start, zero)


def test_a_chain_of_ten_thousand_takes_few_rounds(spark):
    n = 10_000
    chain = spark.range(n - 1).selectExpr("cast(id as int) as a", "cast(id + 1 as int) as b")
    rounds = []
    got = closure(chain, spark.createDataFrame([(0,)], "a int"), True, rounds)
    assert got.count() == n and len(rounds) <= 15
    rounds = []
    assert longest(chain, rounds) == n - 1 and len(rounds) <= 30


def test_squares_that_would_be_large_end_the_doubling(spark):
    edges = [(i, j) for i in range(0, 60) for j in (i + 1, i + 2, i + 3)]
    rounds = []
    got = closure(spark.createDataFrame(edges, E), spark.createDataFrame([(0,)], "a int"), False, rounds, 0, 400)
    assert sorted(r.b for r in got.collect()) == list(range(1, 63)) and max(rounds) < 16
    assert longest(spark.createDataFrame(edges, E), [], 0, 400) == 60


def test_depth(spark):
    def depth(rows):
        return max_depth(spark.createDataFrame(rows, "src int, dst int"))

    assert depth([(1, 0), (2, 1), (3, 1), (4, 3), (4, 0)]) == 4
    assert depth([(1, 2), (2, 1)]) == 0 and depth([(1, 2), (2, 1), (5, 4)]) == 2
    assert max_depth(spark.createDataFrame([], "src int, dst int")) == 0
    with pytest.raises(RuntimeError):
        depth([(1, 0), (2, 1), (1, 2)])
