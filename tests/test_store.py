import re

import pytest
from pyspark.sql import functions as F

from loomspan.operators.sparql import Parser, sparql
from loomspan.operators.store import StoreEngine, build_store, open_store
from loomspan.terms import LABEL, SUBCLASS, TYPE, XSD, iri, literal, triples

E = "http://e/"
P = f"PREFIX : <{E}> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> "


@pytest.fixture(scope="module")
def g(spark):
    rows = []
    for i in range(120):
        rows += [(f"{E}line{i}", TYPE, iri(E + "Line")), (f"{E}line{i}", E + "of", iri(f"{E}order{i % 40}")), (f"{E}line{i}", E + "n", literal(str(i % 7), XSD + "integer"))]
    for i in range(40):
        rows += [(f"{E}order{i}", TYPE, iri(E + "Order")), (f"{E}order{i}", E + "by", iri(f"{E}person{i % 5}")), (f"{E}order{i}", LABEL, literal(f"o{i % 3}", lang="en" if i % 2 else None))]
    for i in range(5):
        rows += [(f"{E}person{i}", TYPE, iri(E + "Person")), (f"{E}person{i}", LABEL, literal(f"p{i}"))]
    rows += [(E + "person0", E + "rare", iri(E + "order1")), (E + "Line", SUBCLASS, iri(E + "Thing")), (E + "Thing", SUBCLASS, iri(E + "Line")), (E + "Order", SUBCLASS, iri(E + "Thing"))]
    rows += [rows[0], (E + "en", E + "n", literal("1")), (E + "en", E + "n", literal("1", XSD + "integer")), (E + "en", LABEL, literal("order1", lang="en"))]
    return triples(spark, rows).cache()


QUERIES = [
    "SELECT ?l ?n WHERE { ?l a :Line ; :n ?n ; :of ?o . FILTER(?n >= 4) }",
    "SELECT DISTINCT ?p WHERE { ?l :of ?o . ?o :by ?p . ?p rdfs:label ?name . FILTER(?name != \"p3\") }",
    "SELECT ?o ?name ?r WHERE { ?o a :Order OPTIONAL { ?o rdfs:label ?name . FILTER(LANG(?name) = \"en\") } OPTIONAL { ?r :rare ?o } }",
    "SELECT ?x (COUNT(?o) AS ?n) (COUNT(DISTINCT ?o) AS ?d) WHERE { ?l :of ?o . ?o :by ?x } GROUP BY ?x",
    "SELECT ?name (MAX(?n) AS ?top) WHERE { ?l :n ?n ; :of ?o . ?o rdfs:label ?name } GROUP BY ?name",
    "SELECT ?x WHERE { { ?x :by :person1 } UNION { ?x :n ?n . FILTER(?n = 6) } UNION { ?x a :Person . BIND(1 AS ?k) } }",
    "SELECT DISTINCT ?c ?up WHERE { ?l a ?c . ?c rdfs:subClassOf* ?up }",
    "SELECT ?x WHERE { ?x rdfs:subClassOf+ :Thing }",
    "SELECT ?s WHERE { ?s :n \"1\" }",
    "SELECT ?p ?o WHERE { :person0 ?p ?o }",
    "SELECT ?x WHERE { ?x :nothing ?y }",
    "SELECT DISTINCT ?x ?y ?l WHERE { ?x a :Order OPTIONAL { ?x rdfs:label ?l . FILTER(?l = \"o1\") } ?y rdfs:label ?l }",
    "SELECT ?o ?k WHERE { ?o a :Order ; rdfs:label ?name . BIND(CONCAT(STR(?name), \"!\") AS ?k) }",
    "CONSTRUCT { ?p :has ?o ; :named ?name } WHERE { ?o :by ?p . ?p rdfs:label ?name }",
]


@pytest.fixture(scope="module")
def store(g):
    s = build_store(g, buckets=4)
    yield s
    s.close()


@pytest.fixture(scope="module")
def tight(g):
    s = build_store(g, buckets=3, bits=9)
    yield s
    s.close()


@pytest.mark.parametrize("text", QUERIES)
def test_rows_are_those_of_the_plain_engine(g, store, tight, text):
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    want = rows(sparql(g, P + text))
    assert rows(store.sparql(P + text)) == want
    assert rows(tight.sparql(P + text)) == want


def test_ids_that_met_were_told_apart(store, tight, g):
    assert not store.clashing and tight.clashing
    for s in (store, tight):
        t = s.table("terms")
        assert t.count() == t.select("id").distinct().count() == t.select("v", "k", "dt", "lang").distinct().count()
        assert s.table("by_s").count() == g.distinct().count() == s.table("by_o").count()


def exchanges(df):
    return len(re.findall(r"\+- Exchange|:- Exchange", df._jdf.queryExecution().executedPlan().toString()))


def test_stars_join_without_an_exchange(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        star = StoreEngine(store).group(Parser(P + "SELECT ?l WHERE { ?l a :Line ; :n ?n ; :of ?o }").query().where)
        assert exchanges(star.df) == 0
        # the second star is bucketed by its subject already: only what comes to it moves
        chain = StoreEngine(store).group(Parser(P + "SELECT ?l WHERE { ?l :n ?n ; :of ?o . ?o :by ?p ; rdfs:label ?name }").query().where)
        assert exchanges(chain.df) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_the_worst_text_order_runs_in_the_best(store):
    text = P + "SELECT ?l WHERE { ?l a :Line . ?l :n ?n . ?l :of ?o . ?o :by ?p . ?o rdfs:label ?name . ?p :rare ?x }"
    parts = Parser(text).query().where.parts
    got = [t[1][1].rsplit("/", 1)[-1].rsplit("#", 1)[-1] for _, t in StoreEngine(store).ordered(parts, set())]
    assert got[:2] == ["rare", "by"] and set(got[2:]) == {"type", "n", "of", "label"} and got.index("of") < got.index("n")


def test_characteristic_sets(store):
    s = store.statistics
    assert s.star(frozenset([E + "of", E + "n"])) == 120 and s.star(frozenset([E + "by"])) == 40 and s.star(frozenset([E + "by", E + "n"])) == 0
    assert s.predicates[E + "rare"] == (1, 1, 1) and s.classes[E + "Person"] == 5


def test_a_store_is_opened_again(spark, g, tmp_path):
    build_store(g, str(tmp_path / "kept"), buckets=2).close()
    again = open_store(spark, str(tmp_path / "kept"))
    assert again.sparql(P + "SELECT ?l WHERE { ?l a :Line }").count() == 120
    assert again.statistics.classes[E + "Line"] == 120
    again.close()


def test_an_empty_store(g):
    s = build_store(g.where(F.lit(False)), buckets=2)
    assert s.sparql(P + "SELECT ?l WHERE { ?l a :Line ; :n ?n }").count() == 0
    s.close()
