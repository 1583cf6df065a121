import pytest
from pyspark.sql import functions as F

from loomspan.operators.sparql import SparqlError, closure, sparql
from loomspan.terms import LABEL, SUBCLASS, TYPE, XSD, iri, literal, triples

E = "http://e/"
P = f"PREFIX : <{E}> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> "


@pytest.fixture(scope="module")
def g(spark):
    rows = [
        (E + "a", TYPE, iri(E + "K")), (E + "b", TYPE, iri(E + "L")), (E + "c", TYPE, iri(E + "M")),
        (E + "K", SUBCLASS, iri(E + "L")), (E + "L", SUBCLASS, iri(E + "M")), (E + "M", SUBCLASS, iri(E + "K")),
        (E + "a", LABEL, literal("one", lang="en")), (E + "a", LABEL, literal("uno", lang="es")),
        (E + "a", E + "n", literal("0.05", XSD + "decimal")), (E + "b", E + "n", literal("x", XSD + "decimal")), (E + "c", E + "n", literal("0.5", XSD + "decimal")),
    ]
    return triples(spark, rows).cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bag_and_optional(g):
    got = {tuple(r) for r in sparql(g, P + "SELECT ?x ?l WHERE { ?x a ?k OPTIONAL { ?x rdfs:label ?l } }").collect()}
    assert got == {(E + "a", "one"), (E + "a", "uno"), (E + "b", None), (E + "c", None)}


def test_filter_error_drops_row(g):
    assert rows(sparql(g, P + "SELECT ?x WHERE { ?x :n ?v FILTER(?v >= 0.03) }")) == [(E + "a",), (E + "c",)]


def test_closure_in_a_cycle_ends(g):
    assert rows(sparql(g, P + "SELECT DISTINCT ?x WHERE { ?x a ?k . ?k rdfs:subClassOf* :M }")) == [(E + "a",), (E + "b",), (E + "c",)]


def test_zero_length_path(spark):
    e = spark.createDataFrame([(1, 2)], "a int, b int")
    start = spark.createDataFrame([(9,)], "a int")
    assert rows(closure(e, start, True)) == [(9, 9)]
    assert rows(closure(e, start, False)) == []


def test_unbound_sort_key_and_hidden_key(g):
    assert len(rows(sparql(g, P + "SELECT ?x WHERE { ?x a ?k } ORDER BY ?never"))) == 3
    got = [r[0] for r in sparql(g, P + "SELECT DISTINCT ?k WHERE { ?x a ?k } ORDER BY ?x").collect()]
    assert got == [E + "K", E + "L", E + "M"]


def test_join_on_unbound_follows_the_rules(g):
    """An unbound variable joins with every value of the later pattern; a bound one only with its own."""
    got = rows(sparql(g, P + "SELECT ?x ?y ?l WHERE { ?x a ?k OPTIONAL { ?x rdfs:label ?l } ?y :n ?l }"))
    numbers = [(E + "a", "0.05"), (E + "b", "x"), (E + "c", "0.5")]
    assert got == sorted((x, y, n) for x in (E + "b", E + "c") for y, n in numbers)


def test_construct_skips_unbound_and_merges(g):
    out = sparql(g, P + "CONSTRUCT { ?x :named ?l } WHERE { ?x a ?k OPTIONAL { ?x rdfs:label ?l } }")
    assert out.count() == 2


def test_outside_the_subset(g):
    with pytest.raises(SparqlError):
        sparql(g, "SELECT ?x WHERE { ?x ?p ?o } HAVING (?x > 1)")


def test_empty_graph(spark):
    empty = triples(spark, [(E + "a", TYPE, iri(E + "K"))]).where(F.lit(False))
    assert sparql(empty, P + "SELECT ?x WHERE { ?x a ?k . ?k rdfs:subClassOf* :M }").count() == 0
