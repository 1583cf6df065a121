from collections import Counter

from loomspan.plans.catalog import QUERIES


def test_every_line_is_an_edge(spark, tmp_path):
    # a hub supplier, a chain to another and a component apart; few lines would pass the thin queries' filter
    lines = [(p, 1) for p in range(1, 9)] + [(8, 2), (9, 2), (20, 5), (21, 5), (1, 1)]
    rows = [(p, s, float(i), 0.0) for i, (p, s) in enumerate(lines)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    edges = {(f"p{p}", f"s{s}") for p, s in lines}
    degree = Counter(x for e in edges for x in e)
    comp = {x: x for x in degree}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    size = Counter(comp.values())
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.node: r.degree for r in run("node_degrees")} == degree
    assert {r.node: r.component for r in run("graph_components")} == comp
    assert {r.component: r["size"] for r in run("component_sizes")} == size
    (r,) = run("connectivity_summary")
    n = len(degree)
    assert (r.nodes, r.edges, r.max_degree, r.median_degree, r.components) == (n, len(edges), max(degree.values()), sorted(degree.values())[n // 2], len(size))
    assert (r.avg_degree, r.density, r.clustering, r.largest_share) == (round(2 * len(edges) / n, 4), round(len(edges) / (n * (n - 1)), 6), 0.0, round(max(size.values()) / n, 4))
