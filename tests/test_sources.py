import pytest

from loomspan.operators.graphs import sanitise
from loomspan.sources.html import events, first_block
from loomspan.sources.json_io import METADATA, metadata_triples, nested_report, read_json
from loomspan.sources.reports import dot_edges, markdown, split_blocks, split_headed
from loomspan.sources.turtle import TurtleError, TurtleParser, parse_ntriples, read_ntriples, read_turtle, write_ntriples, write_turtle
from loomspan.sources.xml import metadata, read_works
from loomspan.terms import COLUMNS, RDF, SUBCLASS, XSD, iri, literal, triples

TTL = '''@prefix : <http://e/> . # a comment
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a a :K, :L ; :n 15000000.0 ; :m 3 ; :t """two
lines""" ; :u "é\\"q"@en , "x"^^xsd:string .
[ :p ( 1 :b ) ] .
:b :ok true ; .
'''


def test_turtle_terms():
    rows = TurtleParser(TTL, "f").parse()
    assert ("http://e/a", "iri", "http://e/n", "15000000.0", "literal", XSD + "decimal", None) in rows
    assert ("http://e/a", "iri", "http://e/t", "two\nlines", "literal", None, None) in rows
    assert ("http://e/a", "iri", "http://e/u", 'é"q', "literal", None, "en") in rows
    assert ("http://e/b", "iri", "http://e/ok", "true", "literal", XSD + "boolean", None) in rows
    assert sum(r[2] == RDF + "first" for r in rows) == 2 and len(rows) == 13
    assert all(r[0].startswith("_:f.") for r in rows if r[1] == "bnode")


@pytest.mark.parametrize("bad", [":a :b :c .", "@prefix : <http://e/> . :a :b", "@prefix : <http://e/> . :a :b ^ ."])
def test_turtle_errors(bad):
    with pytest.raises(TurtleError):
        TurtleParser(bad, "f").parse()


def test_round_trips(spark, tmp_path):
    (tmp_path / "g.ttl").write_text(TTL)
    g = read_turtle(spark, str(tmp_path / "g.ttl"))
    key = lambda df: sorted(str(tuple(r)) for r in df.select(*COLUMNS).collect())
    plain = g.where("s_kind = 'iri' and o_kind <> 'bnode'")
    write_ntriples(plain, str(tmp_path / "nt"))
    assert key(read_ntriples(spark, str(tmp_path / "nt"))) == key(plain)
    write_turtle(plain, str(tmp_path / "out"), {"": "http://e/"})
    assert key(read_turtle(spark, str(tmp_path / "out" / "*.txt"))) == key(plain)
    assert read_turtle(spark, str(tmp_path / "missing.ttl"), missing_ok=True).count() == 0


def test_ntriples_lines(spark):
    lines = spark.createDataFrame([("# no",), ("",), ('<s> <p> "a\\"b\\n"@EN .',), ("<s> <p> _:x .",)], "value string")
    assert sorted((r.o, r.o_kind, r.o_lang) for r in parse_ntriples(lines).collect()) == [("_:x", "bnode", None), ('a"b\n', "literal", "en")]


def test_html(spark):
    html = "<div id='art_5'><div id='005.001'><p class='c'>One &amp; <b>two<p>Three<script>'</p>'</script></div></div><p> </p>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = [(r.page_id, r.pos, r["class"], r.unit_id, r.container_id, r.text) for r in events(pages, tags=("p",)).collect()]
    assert got == [(1, 0, "c", "art_5", "005.001", "One & two"), (1, 1, None, "art_5", "005.001", "Three")]
    assert {r.page_id: r.summary for r in first_block(pages, "none").collect()} == {1: "One & two", 2: "", 3: ""}


def test_xml(spark, tmp_path):
    (tmp_path / "w.xml").write_text("""<N><WORK><URI><VALUE>http://c/1</VALUE></URI><SAMEAS><URI><TYPE>celex</TYPE><IDENTIFIER>1</IDENTIFIER></URI></SAMEAS>
    <SAMEAS><URI><TYPE>celex</TYPE><IDENTIFIER>2</IDENTIFIER></URI></SAMEAS>
    <RESOURCE_LEGAL_DATE_DEADLINE><VALUE>2026-08-02</VALUE><ANNOTATION><TEXT>{ART} 5 AR 6.1 ART 5</TEXT></ANNOTATION></RESOURCE_LEGAL_DATE_DEADLINE>
    <WORK_CITES_WORK><URI><VALUE>http://c/9</VALUE></URI></WORK_CITES_WORK><WORK_CITES_WORK><SAMEAS><URI><TYPE>celex</TYPE><IDENTIFIER>7</IDENTIFIER></URI></SAMEAS></WORK_CITES_WORK>
    <WORK_CITES_WORK><SAMEAS><URI><TYPE>celex</TYPE><IDENTIFIER>7</IDENTIFIER></URI></SAMEAS></WORK_CITES_WORK></WORK></N>""")
    r = metadata(read_works(spark, str(tmp_path / "w.xml"))).first()
    assert r.regulation.celex == "2" and r.deadlines[0].article_references == ["5", "6"]
    assert [c.celex for c in r.cites] == [None, "7"]


def test_json_metadata(spark, tmp_path):
    assert read_json(spark, str(tmp_path / "no.json"), METADATA, missing_ok=True).count() == 0
    (tmp_path / "m.json").write_text('{"regulation": {"celex": "C", "cellar_uri": "u"}, "deadlines": [{"date": "2026-08-02", "article_references": ["Art 5", "6"]}, {"date": "2026-08-02"}, {}], "created_by": [{"label": "A B"}, {}], "amends": [{"celex": "3/1(2)"}, {"cellar_uri": "x"}]}')
    t = metadata_triples(read_json(spark, str(tmp_path / "m.json"), METADATA), "http://e/", "Law")
    assert t.where("p like '%hasArticleReference'").count() == 2
    assert t.where("s = 'http://e/Creator_A_B'").count() == 2
    assert t.where("s = 'http://e/Legislation_3_1_2_' and p like '%hasModifiedLocation'").count() == 0
    (tmp_path / "e.json").write_text('{"regulation": {"celex": "C"}, "deadlines": [{"date": "2026-08-02"}]}')
    assert metadata_triples(read_json(spark, str(tmp_path / "e.json"), METADATA), "http://e/", "Law").count() == 0


def test_reports(spark):
    text = "# CQ1 — one\nPREFIX a: <b>\nSELECT ?x WHERE { ?x ?p ?o }\n# ---\n# LLM2 — two\n# note\nPREFIX a: <b>\nSELECT ?y WHERE { ?y ?p ?o }\n"
    assert [b["id"] for b in split_headed(text)] == ["CQ1", "LLM2"] and len(split_blocks(text)) == 2
    g = triples(spark, [("http://e/A", SUBCLASS, iri("http://e/B")), ("_:x", SUBCLASS, iri("http://e/B"))])
    assert dot_edges(g, {"e": "http://e/"}, {"e": "red"}).count() == 3
    assert markdown(spark.createDataFrame([("a|b", None)], "x string, y string")).first()[0] == "| a\\|b |  |"
    m = spark.createDataFrame([("s", "k", 1.5)], "section string, metric string, value double")
    assert nested_report(m).first()[0] == '{"s":{"k":"1.5"}}'


def test_sanitise(spark):
    g = triples(spark, [("a", "u", iri("http://x")), ("a", "d", literal("P15D")), ("a", "d", literal("soon")), ("a", "d", literal("P1Y", XSD + "duration"))])
    assert {(r.o, r.o_kind, r.o_dt) for r in sanitise(g, ["u"], "d").collect()} == {("http://x", "literal", XSD + "string"), ("P15D", "literal", XSD + "duration"), ("soon", "literal", None), ("P1Y", "literal", XSD + "duration")}
