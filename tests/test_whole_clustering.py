from itertools import combinations

import pytest

from loomspan.plans.catalog import QUERIES


def parquet(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_every_order_counts(spark, tmp_path):
    orders = {1: [1, 2, 3], 7: [3, 4], 20: [4, 5], 33: [5, 3], 41: [6], 43: [6, 7]}
    parquet(spark, tmp_path, "lineitem", [(k, s) for k, v in orders.items() for s in [*v, v[0]]], "l_orderkey long, l_suppkey long")
    near: dict = {}
    for v in orders.values():
        for a, b in combinations(v, 2):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for x, n in near.items():
        links = sum(b in near[a] for a, b in combinations(n, 2))
        want[x] = (len(n), links, 2 * links / (len(n) * (len(n) - 1)) if len(n) > 1 else 0.0)
    got = QUERIES["clustering_coefficients"](spark, str(tmp_path)).collect()
    assert {r.node: (r.k, r.links, pytest.approx(r.coefficient)) for r in got} == want


def test_deltas_take_every_order(spark, tmp_path):
    rows = [("F", 10.0, "1-URGENT"), ("F", 20.0, "2-HIGH"), ("F", 40.0, "5-LOW"), ("P", 7.0, None), ("P", 9.0, "3-MEDIUM"), ("O", 5.0, "1-URGENT")]
    parquet(spark, tmp_path, "orders", [(2 * i + 1, *r) for i, r in enumerate(rows)], "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    got = {r.metric: (r.pre, r.post, r.delta) for r in QUERIES["metric_deltas"](spark, str(tmp_path)).collect()}
    assert got == {"F": (15.0, 40.0, 25.0), "P": (None, 8.0, None), "O": (5.0, None, None)}
