import pytest

from loomspan.operators import store as st
from loomspan.terms import iri, triples


@pytest.mark.parametrize("bits", [64, 3])
def test_repeated_triples_meet_by_ids(spark, monkeypatch, bits):
    names = []
    written = st.written
    monkeypatch.setattr(st, "written", lambda df, name: names.append(name) or written(df, name))
    g = triples(spark, [("a", "p", iri("b")), ("a", "p", iri("c")), ("b", "q", iri("c"))])
    s = st.build_store(g.unionByName(g).unionByName(g), bits=bits, buckets=3)
    try:
        assert s.table("by_s").count() == 3 and s.table("by_o").count() == 3
        assert s.table("terms").count() == len({"a", "b", "c", "p", "q"})
        assert s.statistics.predicates["p"][0] == 2
        # the coded triples are written as the tables and nowhere else
        assert "store-coded" not in names
    finally:
        s.close()
