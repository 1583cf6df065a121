import random

from loomspan.operators import components as c


def test_edges_added_to_components(spark, monkeypatch):
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(90)]
    more = [(rnd.randrange(260), rnd.randrange(260)) for _ in range(60)] + [(900, 901), (901, 902), edges[0]]
    frame = lambda rows: spark.createDataFrame(rows, "a int, b int")
    rows = lambda df: sorted((r.node, r.component) for r in df.collect())
    part, whole = c.connected_components(frame(edges)), rows(c.connected_components(frame(edges + more)))
    sizes = []
    stars = c._stars
    monkeypatch.setattr(c, "_stars", lambda e, n: sizes.append(e.count()) or stars(e, n))
    assert rows(c.with_edges(part, frame(more))) == whole
    assert sizes == [sizes[0]] and sizes[0] < len(more)
    assert rows(c.with_edges(part, frame([]))) == rows(part)


def test_a_round_scans_its_edges_six_times_at_most(spark, monkeypatch):
    """Before it was twelve; each scan and exchange takes memory on the driver."""
    plans = []
    written = c.written
    monkeypatch.setattr(c, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or written(df, name))
    got = c.connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int"))
    assert {(r.node, r.component) for r in got.collect()} == {(i, 0) for i in range(41)}
    rounds = [p.count("Relation [") for name, p in plans if name == "cc-round"]
    assert rounds and max(rounds) <= 6
