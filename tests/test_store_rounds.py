import pytest

from loomspan.operators import store as st
from loomspan.operators.profile import profiled
from loomspan.plans.relational import triples_of
from loomspan.terms import iri, literal, triples


def test_nothing_is_written_beside_the_store(spark, monkeypatch, tmp_path):
    rows = [(i, i % 3, i % 50, i % 7, "0.1", "5") for i in range(20_000)]
    names = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_discount string, l_quantity string"
    spark.createDataFrame(rows + rows[:500], names).write.parquet(f"{tmp_path}/lineitem.parquet")
    plain = triples_of(spark, str(tmp_path), "lineitem")
    loose = triples_of(spark, str(tmp_path), "lineitem", repeats=True)
    # no string moves before the store has made ids of it
    assert "Exchange" in plain._jdf.queryExecution().toString() and "Exchange" not in loose._jdf.queryExecution().toString()
    beside, stores = [], []
    written = st.written
    monkeypatch.setattr(st, "written", lambda df, name: beside.append(name) or written(df, name))
    cost = profiled(spark, [("store", lambda: stores.append(st.build_store(loose, buckets=4)))]).first()
    try:
        assert cost.status == "done" and beside == []
        assert stores[0].table("by_s").count() == stores[0].table("by_o").count() == plain.count() == 6 * 20_000
        # terms move once, and triples once for each table
        assert cost.shuffle_rows < 2 * 6 * 20_500 + 2 * stores[0].table("terms").count()
    finally:
        stores[0].close()


@pytest.mark.parametrize("bits", [64, 9])
def test_rounds_give_what_one_round_gives(spark, monkeypatch, bits):
    g = triples(spark, [(f"s{i}", f"p{i % 2}", iri(f"s{i // 2}") if i % 3 else literal(str(i % 5))) for i in range(60)])
    got = []
    for size in (st.ROUND, 7):
        monkeypatch.setattr(st, "ROUND", size)
        s = st.build_store(g.unionByName(g), buckets=5, bits=bits)
        try:
            text = {r.id: r.v for r in s.table("terms").collect()}
            got += [sorted((text[r.s], text[r.p], text[r.o], r.literal) for r in s.table(t).collect()) for t in ("by_s", "by_o")]
        finally:
            s.close()
    assert len(got[0]) == 60 and all(x == got[0] for x in got)
