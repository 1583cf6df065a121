from loomspan.operators import wiring
from loomspan.plans import construction as c

D = "/root/testdata/sf0.001"
NS = "http://n/"


def plan(df, word):
    return df._jdf.queryExecution().optimizedPlan().toString().count(word)


def test_a_layer_is_made_distinct_once(spark):
    g = wiring.model_triples(c.instances(spark, D), NS, "x")
    assert plan(g, "Aggregate [") == 1 and plan(wiring.model_triples(c.instances(spark, D), NS, "x", repeats=True), "Aggregate [") == 0
    assert g.count() == g.distinct().count()


def test_enrichments_are_looked_up_in_one_pass(spark):
    known = spark.createDataFrame([(NS + "a_b",), (NS + "a_b",), (NS + "instance",)], "s string")
    names = spark.createDataFrame([("item-1", NS + "one")], "suffix string, s string")
    law = "Legislation_32016R0679"
    rows = [
        ("item-1", "instance", "cites", law, None), ("item-1", "instance", "cites", law, None), ("a-b", None, "cites", law, None), ("ghost", "instance", "cites", "Legislation_1", None), ("Article_3", "article", "hasArticleReference", "Article_4", None),
        ("a-b", "instance", "hasDeadline", "Legislation_9", "xsd:duration"), ("item-1", "instance", "hasFine", None, None), ("item-1", "instance", "knows", "x", None), (None, "article", "hasFine", "1", None), ("a-b", "instance", "hasFine", "1", "xsd:int"),
    ]
    rec = spark.createDataFrame(rows, "subject string, subject_type string, predicate string, object string, object_datatype string")
    for parts in (None, 7):
        g = wiring.enrichment_triples(rec, known, NS, names, parts=parts)
        assert plan(g, "Join LeftOuter") == 2
        got = [(r.s[len(NS) :], r.p.split("/")[-1].split("#")[-1], r.o.removeprefix(NS), r.o_kind, (r.o_dt or "").split("#")[-1]) for r in g.collect()]
        want = {
            ("one", "cites", law, "iri", ""), ("a_b", "cites", law, "iri", ""), (law, "type", "EULegislation", "iri", ""), (law, "label", "EU legislation 32016R0679", "literal", ""), (law, "hasCELEXNumber", "32016R0679", "literal", "string"),
            ("Article_3", "hasArticleReference", "Article_4", "iri", ""), ("a_b", "hasDeadline", "Legislation_9", "literal", "duration"), ("a_b", "hasFine", "1", "literal", "string"),
        }
        assert len(got) == len(want) and set(got) == want


def test_one_file_of_many_rows_is_dealt_to_tasks(spark, monkeypatch):
    plain = {f: sorted(map(str, f(spark, D).collect())) for f in (c.modelled, c.enriched)}
    monkeypatch.setattr(c, "SHARE", 20)
    monkeypatch.setattr(c, "TRIPLES", 100)
    assert c.instances(spark, D).selectExpr("spark_partition_id() as i").distinct().count() > 4
    for f, rows in plain.items():
        g = f(spark, D)
        assert g.rdd.getNumPartitions() > 4 and sorted(map(str, g.collect())) == rows
