import random

from loomspan.functions import text as x
from loomspan.operators import completer, doctree, matching, rules, wiring
from loomspan.operators.graphs import merge
from loomspan.plans.tbox import tbox
from loomspan.terms import TYPE, duration_parts, encode_for_uri, iri, triples
from pyspark.sql import functions as F

NS = "http://e#"


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


def test_text_functions(spark):
    assert one(spark, "a  b\n ", x.normalize_text) == "a b"
    assert one(spark, "Title `` ", x.clean_extracted) == "Title"
    assert one(spark, "ok  Generated by CLaiRK, edited by us. ", x.filter_summary) == "ok"
    assert one(spark, "one two three", lambda v: x.truncate(v, 9)) == "one two…"
    assert one(spark, "abcd", lambda v: x.truncate(v, 4)) == "abcd"
    assert one(spark, "within 15 days; No later than 24 hours", x.deadlines) == ["P15D", "PT24H"]
    assert one(spark, "up to EUR 35 000 000 or 15000 EUR", x.fines) == ["35000000"]
    assert one(spark, "7,5 % and 3 % of the total worldwide annual turnover", x.fine_ratios) == [0.03]
    assert one(spark, "Article 5 and article 6, Article 5, Article 12 3", lambda v: x.article_refs(v, F.lit(6))) == [5]
    assert one(spark, "Regulation (EU) 2024/1689, Regulation (EC) No 765/2008, Directive 2014/90/EU", lambda v: x.legislation_refs(v, "32024R1689")) == ["32008R0765", "32014L0090"]
    assert one(spark, "so 1. Aa then 12. Bb", x.embedded_number) == "12"
    assert one(spark, "no", x.embedded_number) is None
    assert one(spark, "```json\n{}\n```", x.unfenced) == "{}"
    assert [tuple(e) for e in one(spark, "Article 5(1) and ARTICLE 5(1) pay 7 %", x.entities)] == [("Article 5(1)", "REGULATION_REF"), ("7 %", "MONEY")]
    assert one(spark, "P12M", duration_parts).months == 12 and one(spark, "PT24H", duration_parts).seconds == 86400
    assert one(spark, "P", duration_parts) is None and one(spark, "soon", duration_parts) is None
    assert one(spark, "a~b*c d/é", encode_for_uri) == "a~b%2Ac%20d%2F%C3%A9"


def article_machine(rows):
    """The state machine that the windows stand for."""
    import re

    out, label, number = [], None, {}
    for unit, cont, pos, text in rows:
        m = re.fullmatch(r"\(([A-Za-z0-9ivxlcdmIVXLCDM]+)\)", text)
        if m:
            label = m[1]
            continue
        n = re.match(r"^(\d+)\.\s+(.*)$", text)
        own = n[1] if n else None
        if own and cont:
            number[cont] = own
        out.append((pos, f"({label}) {text}" if label else text, number.get(cont) if cont else own, label))
        label = None
    return out


def test_article_items_match_a_state_machine(spark):
    rng = random.Random(5)
    rows = [("7", rng.choice([None, "001.001", "001.002"]), i, rng.choice(["(a)", "(b)", "1. One", "2. Two", "body", "more"])) for i in range(300)]
    got = doctree.article_items(spark.createDataFrame(rows, "unit string, container_id string, pos int, text string")).orderBy("pos").collect()
    assert [(r.pos, r.text, r.paragraph_number, r.list_label) for r in got] == article_machine(rows)


def test_annex_sections_reset_numbers_not_labels(spark):
    rows = [("IV", i, t) for i, t in enumerate(["1. First", "(a)", "Section B", "body", "2. Second", "rest"])]
    got = doctree.annex_items(spark.createDataFrame(rows, "unit string, pos int, text string")).orderBy("pos").collect()
    assert [(r.section, r.paragraph_number, r.list_label) for r in got] == [(None, "1", None), ("B", None, "a"), ("B", "2", None), ("B", "2", None)]


def test_annex_items_by_hand(spark):
    """Headings in any case, letters at a start, markers put in front, numbers within a text."""
    lines = ["1. First", "(a)", "labelled", "(b) inline", "SECTION b", "(c)", "Section C", "(d) both", "preamble 3. One and 4. Two", "rest"]
    got = doctree.annex_items(spark.createDataFrame([("VIII", i, t) for i, t in enumerate(lines)], "unit string, pos int, text string")).orderBy("pos").collect()
    assert [(r.text, r.section, r.paragraph_number, r.list_label) for r in got] == [
        ("1. First", None, "1", None), ("(a) labelled", None, "1", "a"), ("(b) inline", None, "1", "b"), ("(c) (d) both", "C", None, "c"), ("preamble 3. One and 4. Two", "C", "4", None), ("rest", "C", "4", None),
    ]
    assert got[2].reference == "Annex VIII(1)(b)" and got[3].reference == "Annex VIII(C)(c)"


def test_annexes_without_items_are_cut_out_of_their_text(spark):
    texts = [("viii", "Head Section A 1. one (a) first; more (b) second 2. two Section B tail 1. again; (c) third  "), ("IV", "no number"), ("VI", None), ("VII", "1. has items")]
    have = spark.createDataFrame([("VII", 1, "kept", "1", None, "Annex VII(1)")], ITEMS)
    got = doctree.with_synthetic(have, spark.createDataFrame(texts, "unit string, text string")).orderBy("unit", "pos").collect()
    assert [(r.unit, r.section, r.paragraph_number, r.list_label, r.reference, r.text) for r in got] == [
        ("VII", None, "1", None, "Annex VII(1)", "kept"),
        ("viii", "A", "1", None, "Annex VIII(A)(1)", "1. one (a) first; more (b) second"), ("viii", "A", "1", "a", "Annex VIII(A)(1)(a)", "(a) first"), ("viii", "A", "1", "b", "Annex VIII(A)(1)(b)", "(b) second"),
        ("viii", "B", "2", None, "Annex VIII(B)(2)", "2. two"),
        ("viii", "B", "1", None, "Annex VIII(B)(1)", "1. again; (c) third"), ("viii", "B", "1", "c", "Annex VIII(B)(1)(c)", "(c) third"),
    ]


ITEMS = "unit string, pos int, text string, paragraph_number string, list_label string, reference string"


def test_rules(spark):
    art = spark.createDataFrame([("5", 1, "bad", "1", "a", "Article 5(1)(a)"), ("5", 2, "again", "1", "a", "Article 5(1)(a)"), ("5", 3, "bio", "1", "h", "Article 5(1)(h)"), ("5", 4, "no", "1", "i", "x"), ("14", 5, "see", "4", "b", "Article 14(4)(b)")], ITEMS)
    ann = spark.createDataFrame([("IV", 1, "Section 1", None, None, "r0"), ("IV", 2, "x", "1", None, "Annex IV(1)"), ("VI", 3, "short", None, None, "Annex VI")], ITEMS)
    out = rules.extract_all(art, ann)
    n = {r.name: r.n for r in rules.summary(out).where("by = 'rule'").collect()}
    assert n == {"annex_iii_sectors": 8, "notified_body_requirements": 12, "article_5_practices": 2, "article_14_risk_controls": 1, "annex_iv_components": 1}
    g = wiring.rule_triples(out, NS)
    assert g.where(f"s = '{NS}documentation_component_anniv_1' and p = '{NS}hasComponentOf'").count() == 1
    assert g.where(f"s = '{NS}ProcessRequirement'").count() == 0 and g.where(f"s = '{NS}NotifiedBody_Demo' and p = '{NS}meetsRequirement'").count() == 12
    assert g.where(f"p = '{NS}hasParagraphReference' and o = '{NS}Paragraph_Article_5_1_a'").count() == 1
    systems = wiring.paired_systems(out.where("type = 'AreaOfApplication'"), out.where("type = 'RiskControl'"), out.where("1 = 0"), NS)
    assert systems.where(f"p = '{wiring.AIRO}hasRiskControl'").count() == 8


def test_model_triples(spark):
    rows = [
        ("one", "obligation", "s", None, 5, None, ["CQ1"], "e"), ("two", " CE Marking ", "s", "Article 9(2)", 5, None, [], None), ("box", "AIRegulatorySandbox", "why", None, 57, None, None, None),
        ("", "Requirement", "s", None, 5, None, [], None), ("three", "ProviderIncidentReport", None, None, None, "IV", ["CQ2"], " because "),
    ]
    df = spark.createDataFrame(rows, "uri_suffix string, type string, summary string, paragraph_ref string, source_article int, source_annex string, cq_targets array<string>, evidence_text string")
    g = {(r.s[len(NS):], r.p.split("#")[-1], r.o.split("#")[-1]) for r in wiring.model_triples(df, NS).collect()}
    assert ("two", "hasArticleReference", "Article_9") in g and ("three", "hasAnnexReference", "Annex_IV") in g
    assert ("AIRegulatorySandboxInstance", "hasSummary", "why") in g and not any(s == "one" for s, _, _ in g)
    assert ("three", "comment", "evidence: because") in g and ("three", "hasReportingTarget", "MarketSurveillanceAuthority") in g and ("ProviderStakeholder", "hasObligation", "three") in g


def test_enrichment(spark):
    known = triples(spark, [(NS + "a", TYPE, iri(NS + "K"))])
    rows = [("a", None, "hasDeadline", "P1D", "xsd:duration"), ("zz", None, "hasDeadline", "P1D", "xsd:duration"), ("a", "instance", "cites", "Legislation_32016R0679", None), ("m", "instance", "hasFine", "5", "xsd:decimal"), ("Article_9", "article", "hasArticleReference", "Article_2", None), ("a", None, "odd", "x", None)]
    rec = spark.createDataFrame(rows, "subject string, subject_type string, predicate string, object string, object_datatype string")
    names = spark.createDataFrame([("m", NS + "mapped")], "suffix string, s string")
    got = {(r.s[len(NS):], r.p.split("#")[-1], r.o) for r in wiring.enrichment_triples(rec, known, NS, names).collect()}
    assert got == {
        ("a", "hasDeadline", "P1D"), ("a", "cites", NS + "Legislation_32016R0679"), ("mapped", "hasFine", "5"), ("Article_9", "hasArticleReference", NS + "Article_2"),
        ("Legislation_32016R0679", "type", NS + "EULegislation"), ("Legislation_32016R0679", "label", "EU legislation 32016R0679"), ("Legislation_32016R0679", "hasCELEXNumber", "32016R0679"),
    }


def test_greedy_matching(spark):
    gold = spark.createDataFrame([(1, "M", 1, "7 %"), (1, "M", 2, "EUR 5"), (2, "D", 1, "x")], "sentence int, type string, pos int, text string")
    pred = spark.createDataFrame([(1, "M", 1, "7 %."), (1, "M", 2, "7"), (3, "D", 1, "y")], "sentence int, type string, pos int, text string")
    got = {(r.sentence, r.type): (r.tp, r.fp, r.fn) for r in matching.match_entities(gold, pred).collect()}
    assert got == {(1, "M"): (1, 1, 1), (2, "D"): (0, 0, 1), (3, "D"): (0, 1, 0)}
    assert matching.combined(gold, gold).count() == 3


def test_completer_and_gaps(spark):
    g = tbox(spark, NS)
    prompts = spark.createDataFrame([("p1",), ("p2",)], "prompt string")
    rec = prompts.limit(1).select(completer.prompt_key(F.col("prompt")).alias("prompt_key"), F.lit('```json\n{"components": [{"uri_suffix": "n 1"}, {"uri_suffix": "n 1"}, {"uri_suffix": "Article"}, {"uri_suffix": ""}]}\n```').alias("answer"))
    ans = completer.replay(prompts, rec)
    assert completer.new_components(ans, g, NS, "components", "DocumentationComponent", "TD", "Annex_IV").select("s").where(f"s = '{NS}n_1'").distinct().count() == 1
    called = completer.call_model(prompts, lambda p: 1 / 0 if p == "p1" else "ok", pause=0).orderBy("prompt").collect()
    assert called[0].answer == "{}" and called[0].error.startswith("ZeroDivisionError") and all((r.answer, r.error) == ("ok", None) for r in called[1:])
    n = spark.createDataFrame([("a", '{"fine_eur": 5.5}'), ("b", '{"fine_eur": -1}'), ("c", "no"), ("d", '{"ratio": 0.03}'), ("e", '{"deadline": "15 days"}'), ("f", '{"deadline": "P15D"}')], "s string, answer string")
    assert [r.o for r in completer.fine_triples(n, NS).collect()] == ["5"]
    assert [r.o for r in completer.ratio_triples(n, NS).collect()] == ["0.03"]
    assert [r.s for r in completer.deadline_triples(n, NS).collect()] == ["f"]
    a = spark.createDataFrame([('{"areas": [{"sector_key": "Justice!", "label": "J"}, {"sector_key": "space"}]}',)], "answer string")
    s = spark.createDataFrame([(NS + "x_justice",), (NS + "a_justice",)], "s string")
    assert completer.area_triples(a, s, NS, [r[0] for r in rules.AREAS], NS + "link").where("p like '%link'").first().s == NS + "a_justice"
    rows = spark.createDataFrame([("q", i, f"r{i}") for i in range(17)], "id string, pos int, text string")
    assert completer.verbalised_rows(rows).first().context.endswith("15. r14\n... and 2 more")


def test_tbox_merges_once(spark):
    assert merge(tbox(spark, NS), tbox(spark, NS)).count() == tbox(spark, NS).count() > 300


def test_stream(spark, tmp_path):
    from loomspan.streaming.ingest import event_triples, read_stream, start

    spark.range(20).selectExpr("id as event_id", "timestamp'2024-01-01' as ts", "id % 3 as user_id", "'view' as event_type", "1.0D as value", "'{\"k\": 1}' as props").write.parquet(str(tmp_path / "in"))
    q = start(event_triples(read_stream(spark, str(tmp_path / "in")), NS), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 80


def test_what_the_schema_says_of_its_properties(spark):
    """Facts of the schema triple by triple, written out here and not taken from the module's own tables."""
    from loomspan.plans.relational import EX
    from loomspan.plans.tbox import tbox
    from loomspan.terms import OWL, RDFS, TYPE, XSD

    g = {(r.s.removeprefix(EX), r.p, r.o.removeprefix(EX)) for r in tbox(spark, EX).collect()}
    assert {s for s, p, o in g if (p, o) == (TYPE, OWL + "FunctionalProperty")} == {"hasReportingTarget", "hasDeadline"}
    assert {(s, o) for s, p, o in g if p == OWL + "inverseOf"} == {("hasComponentOf", "hasRequiredComponent")}
    ranges = {"hasDeadline": XSD + "duration", "hasComplianceDeadline": XSD + "date", "hasProvisionDate": XSD + "date", "hasFine": XSD + "decimal", "hasSummary": XSD + "string", "hasReportingTarget": "https://w3id.org/dpv#Authority", "hasArticleReference": "Article"}
    assert {k: {o for s, p, o in g if (s, p) == (k, RDFS + "range")} for k in ranges} == {k: {v} for k, v in ranges.items()}
    assert {("hasArticleReference", RDFS + "subPropertyOf", "hasReference"), ("hasReportingTarget", RDFS + "domain", "IncidentReportingObligation"), ("hasRequiredComponent", RDFS + "range", "RequiredComponent")} <= g
