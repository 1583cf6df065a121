"""Readers and writers over the test tables: what goes out comes back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import text as x
from loomspan.operators import doctree, profile
from loomspan.plans.registry import query
from loomspan.plans.relational import EX, duck_triples, table, triples_of
from loomspan.session import scratch
from loomspan.sources import json_io, reports, turtle, xml
from loomspan.terms import SUBCLASS, XSD, iri, triples

_TABLES = ("nation", "region", "supplier")


@query("turtle_round_trip", f"select s, p, o, o_kind, o_dt from ({duck_triples(*_TABLES)})")
def turtle_round_trip(spark, d):
    path = scratch(spark, "turtle")
    turtle.write_turtle(triples_of(spark, d, *_TABLES), path, {"ex": EX, "xsd": XSD})
    return turtle.read_turtle(spark, f"{path}/*.txt").select("s", "p", "o", "o_kind", "o_dt")


@query("ntriples_round_trip", f"select s, p, o, o_kind, o_dt from ({duck_triples('part')})")
def ntriples_round_trip(spark, d):
    path = scratch(spark, "ntriples")
    turtle.write_ntriples(triples_of(spark, d, "part"), path)
    return turtle.read_ntriples(spark, path).select("s", "p", "o", "o_kind", "o_dt")


@query("optional_merge", f"select layer, n from (select 'there' as layer, count(*) as n from ({duck_triples('nation')}) union all select 'missing', 0)")
def optional_merge(spark, d):
    path = scratch(spark, "turtle")
    turtle.write_turtle(triples_of(spark, d, "nation"), path)
    there, missing = turtle.read_turtle(spark, f"{path}/*.txt"), turtle.read_turtle(spark, path + "/none.ttl", missing_ok=True)
    count = lambda name, g: g.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n")
    return count("there", there).unionByName(count("missing", missing))


@query("json_round_trip", "select c_custkey as k, c_name as name, [c_mktsegment, null] as tags from customer union all select 0, 'none', [null, null] where 1 = 0")
def json_round_trip(spark, d):
    path = scratch(spark, "json")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.array("c_mktsegment", F.lit(None).cast("string")).alias("tags"))
    json_io.write_json(rows, path)
    back = spark.read.schema("k long, name string, tags array<string>").json(path)
    return back.unionByName(json_io.read_json(spark, path + "/none.json", "k long, name string, tags array<string>", missing_ok=True))


@query(
    "xml_metadata",
    """select '3' || n_nationkey as celex, 'http://c/' || n_nationkey as cellar, 'eli/' || n_nationkey as eli, '2026-08-' || (10 + n_nationkey % 10) as day, case when n_nationkey = 5 then '5' else n_nationkey || ',5' end as refs,
    'L' || n_regionkey || ',-' as cites, 'http://c/x' || n_nationkey as loose, n_name as maker, 1 as makers from nation""",
)
def xml_metadata(spark, d):
    """A WORK element for each nation: the last celex counts, of two links of one celex the first, of empty creators none."""
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    same = lambda kind, v: F.concat(F.lit(f"<SAMEAS><URI><TYPE>{kind}</TYPE><IDENTIFIER>"), v, F.lit("</IDENTIFIER></URI></SAMEAS>"))
    link = F.concat(F.lit("<WORK_CITES_WORK>"), same("celex", F.concat(F.lit("L"), r)), F.lit("</WORK_CITES_WORK>"))
    parts = [
        F.lit("<WORK><URI><VALUE>http://c/"), k, F.lit("</VALUE></URI>"), same("celex", F.concat(F.lit("old"), k)), same("celex", F.concat(F.lit("3"), k)), same("eli", F.concat(F.lit("eli/"), k)),
        F.lit("<RESOURCE_LEGAL_DATE_DEADLINE><VALUE>2026-08-"), (10 + F.col("n_nationkey") % 10).cast("string"), F.lit("</VALUE><ANNOTATION><TEXT>{ART} "), k, F.lit(" AR 5.1 ART "), k, F.lit("</TEXT></ANNOTATION></RESOURCE_LEGAL_DATE_DEADLINE>"),
        link, link, F.lit("<WORK_CITES_WORK><URI><VALUE>http://c/x"), k, F.lit("</VALUE></URI></WORK_CITES_WORK>"), F.lit("<CREATED_BY><PREFLABEL>"), F.col("n_name"), F.lit("</PREFLABEL></CREATED_BY><CREATED_BY><OTHER>1</OTHER></CREATED_BY></WORK>"),
    ]
    path = scratch(spark, "xml")
    works = table(spark, d, "nation").agg(F.array_join(F.collect_list(F.concat(*parts)), "").alias("all"))
    works.select(F.concat(F.lit("<NOTICE>"), "all", F.lit("</NOTICE>")).alias("value")).write.text(path)
    m = xml.metadata(xml.read_works(spark, path))
    first = lambda c: F.get(c, F.lit(0))
    dash = F.array_join(F.transform("cites", lambda c: c["celex"]), ",", "-")
    return m.select(
        F.col("regulation.celex").alias("celex"), F.col("regulation.cellar_uri").alias("cellar"), F.col("regulation.eli").alias("eli"), first("deadlines")["date"].alias("day"), F.array_join(first("deadlines")["article_references"], ",").alias("refs"),
        dash.alias("cites"), F.get("cites", F.lit(1))["cellar_uri"].alias("loose"), first("created_by")["label"].alias("maker"), F.size("created_by").alias("makers"),
    )


@query("text_report", "select rpad(cast(n_nationkey as varchar), 6, ' ') || ' | ' || rpad(n_name, 12, ' ') as value from nation union all select '| ' || r_regionkey || ' | ' || r_name || ' |' from region")
def text_report(spark, d):
    return reports.fixed_width(table(spark, d, "nation"), {"n_nationkey": 6, "n_name": 12}).unionByName(reports.markdown(table(spark, d, "region").select("r_regionkey", "r_name")))


@query("dot_lines", """select distinct '  "k:nation/' || n_nationkey || '" -> "k:region/' || n_regionkey || '";' as value from nation union select '  "k:nation/' || n_nationkey || '" [style=filled, fillcolor="red"];' from nation union select '  "k:region/' || n_regionkey || '" [style=filled, fillcolor="red"];' from nation""")
def dot_lines(spark, d):
    g = triples_of(spark, d, "nation").where(F.col("p") == EX + "partOf").withColumn("p", F.lit(SUBCLASS))
    return reports.dot_edges(g.unionByName(triples(spark, [("_:b", SUBCLASS, iri(EX + "x"))])), {"k": EX}, {"k": "red"})


@query(
    "query_files",
    """select 'CQ' || o_orderkey as id, 'Order ' || o_orderkey as title, 'SELECT ?x WHERE { ?x ?p ' || o_orderkey || ' }' as body, 2 as blocks from orders
    union all select 'LLM' || o_orderkey, 'Its customer', 'CONSTRUCT { ?x ?p ?o } WHERE { ?x ?p ?o }', 2 from orders where o_orderstatus <> 'P'""",
)
def query_files(spark, d):
    """A landed file for each order with queries under headers, one of them without its prefix where the status is P."""
    k = F.col("o_orderkey").cast("string")
    second = F.when(F.col("o_orderstatus") != "P", F.lit("PREFIX a: <b>\n")).otherwise("")
    text = F.concat(F.lit("# CQ"), k, F.lit(" — Order "), k, F.lit("\n# note\nPREFIX a: <b>\nSELECT ?x WHERE { ?x ?p "), k, F.lit(" }\n# ---\n# LLM"), k, F.lit(" — Its customer\n"), second, F.lit("CONSTRUCT { ?x ?p ?o } WHERE { ?x ?p ?o }\n# ---\n\n"))
    files = table(spark, d, "orders").select(k.alias("file"), text.alias("text"))
    q = reports.headed_queries(files)
    return q.select("id", "title", F.element_at(F.split("sparql", "\n"), 2).alias("body"), "blocks")


@query(
    "stage_profile",
    """select 'read' as stage, 'done' as status, count(*) as rows_read, 0 as shuffle_rows from orders union all select 'dealt', 'done', count(*), count(*) from lineitem union all select 'broken', 'failed', 0, 0""",
)
def stage_profile(spark, d):
    """What the executors read and shuffled in each stage, by their own counts."""
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    stages = [("read", lambda: noop(table(spark, d, "orders").select("o_orderkey"))), ("dealt", lambda: noop(table(spark, d, "lineitem").select("l_orderkey").repartition(8, "l_orderkey"))), ("broken", lambda: noop(spark.read.parquet(f"{d}/none.parquet")))]
    return profile.profiled(spark, stages).select("stage", "status", "rows_read", "shuffle_rows")


@query(
    "annex_sections",
    r"""with p as (select conv_id as unit, turn as pos, case (conv_id + turn) % 8 when 0 then 'SECTION ' || chr(cast(65 + turn % 26 as int)) || ' of it' when 1 then turn || '. Body' when 2 then '(' || chr(cast(97 + turn % 26 as int)) || ')'
        when 3 then '(' || chr(cast(97 + conv_id % 26 as int)) || ') inline' when 4 then 'run on ' || (turn + 1) || '. Item and ' || (turn + 2) || '. Other' when 5 then 'Section b here' else 'more of ' || turn end as text from conversations),
    m as (select *, nullif(regexp_extract(text, '^\(([A-Za-z0-9]+)\)$', 1), '') as mark, upper(nullif(regexp_extract(text, '^section\s+([a-z])\b', 1, 'i'), '')) as s,
        coalesce(nullif(regexp_extract(text, '^(\d+)\.\s', 1), ''), regexp_extract_all(text, '(?:^|\s)(\d+)\.\s+[A-Z]', 1)[-1]) as own from p),
    r as (select *, count(s) over w as run, last_value(s ignore nulls) over w as section from m window w as (partition by unit order by pos)),
    l as (select *, lag(mark) over (partition by unit order by pos) as before from r where s is null),
    k as (select *, last_value(own ignore nulls) over (partition by unit, run order by pos) as number, coalesce(before, nullif(regexp_extract(text, '^\(([a-z])\)\s', 1), '')) as label from l where mark is null)
    select unit, pos, section, number as paragraph_number, label as list_label, 'Annex ' || unit || coalesce('(' || section || ')', '') || coalesce('(' || number || ')', '') || coalesce('(' || label || ')', '') as reference,
        coalesce('(' || before || ') ', '') || text as text from k""",
)
def annex_sections(spark, d):
    turn, kind = F.col("turn"), (F.col("conv_id") + F.col("turn")) % 8
    letter = lambda base, c: F.char(base + c % 26)
    n = lambda c: c.cast("string")
    text = (
        F.when(kind == 0, F.concat(F.lit("SECTION "), letter(65, turn), F.lit(" of it")))
        .when(kind == 1, F.concat(n(turn), F.lit(". Body")))
        .when(kind == 2, F.concat(F.lit("("), letter(97, turn), F.lit(")")))
        .when(kind == 3, F.concat(F.lit("("), letter(97, F.col("conv_id")), F.lit(") inline")))
        .when(kind == 4, F.concat(F.lit("run on "), n(turn + 1), F.lit(". Item and "), n(turn + 2), F.lit(". Other")))
        .when(kind == 5, "Section b here")
        .otherwise(F.concat(F.lit("more of "), n(turn)))
    )
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("unit"), turn.alias("pos"), text.alias("text"))
    items = doctree.annex_items(rows.withColumn("unit", F.col("unit").cast("string")))
    return items.select(F.col("unit").cast("long").alias("unit"), "pos", "section", "paragraph_number", "list_label", "reference", "text")


@query(
    "annex_texts",
    r"""with p as (select o_orderkey as unit, 'Head ' || o_orderstatus || case when o_orderkey % 3 = 0 then ' Section C' else '' end || ' 1. first of ' || o_custkey || ' (a) one; rest (b) two of it; Section ' || case when o_orderkey % 2 = 0 then 'B' else 'b' end || ' more 2. last; (c) three' as text from orders),
    q as (select unit, case when text like '%Section C%' then 'C' end as s0, case when text like '%Section B%' then 'B' end as s1, nullif(regexp_extract(text, 'first of (\d+)', 1), '') as cust from p),
    r as (select *, case when s1 is null then '; Section b more' else ';' end as rest from q)
    select unit, 1 as pos, 0 as sub, coalesce(s1, s0) as section, '1' as paragraph_number, cast(null as varchar) as list_label, '1. first of ' || cust || ' (a) one; rest (b) two of it' || rest as text from r
    union all select unit, 1, 1, coalesce(s1, s0), '1', 'a', '(a) one' from r union all select unit, 1, 2, coalesce(s1, s0), '1', 'b', '(b) two of it' from r
    union all select unit, 2, 0, coalesce(s1, s0), '2', null, '2. last; (c) three' from r union all select unit, 2, 1, coalesce(s1, s0), '2', 'c', '(c) three' from r""",
)
def annex_texts(spark, d):
    """A text for each order, cut into items: sections before and within items, lettered parts."""
    n = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("Head "), "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, " Section C").otherwise(""), F.lit(" 1. first of "), n("o_custkey"), F.lit(" (a) one; rest (b) two of it; Section "), F.when(F.col("o_orderkey") % 2 == 0, "B").otherwise("b"), F.lit(" more 2. last; (c) three"))
    out = doctree.synthetic_annex_items(table(spark, d, "orders").select(n("o_orderkey").alias("unit"), text.alias("text")))
    return out.select(F.col("unit").cast("long").alias("unit"), "pos", "sub", "section", "paragraph_number", "list_label", "text")


@query(
    "unit_titles",
    """with p as (select conv_id as unit, turn as pos, case conv_id % 3 when 0 then 'chapter' when 1 then 'article' else 'annex' end as kind, case when conv_id % 3 = 2 and turn = 0 then 'ANNEX IV' else 'line ' || turn end as text from conversations)
    select unit, kind, case when kind = 'article' then arg_max(text, pos) else arg_min(text, pos) end as title from p where not (kind = 'annex' and text = 'ANNEX IV') group by 1, 2""",
)
def unit_titles(spark, d):
    k = F.col("conv_id") % 3
    kind = F.when(k == 0, "chapter").when(k == 1, "article").otherwise("annex")
    text = F.when((k == 2) & (F.col("turn") == 0), "ANNEX IV").otherwise(F.concat(F.lit("line "), F.col("turn").cast("string")))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("unit"), F.col("turn").alias("pos"), kind.alias("kind"), F.lit("title").alias("class"), text.alias("text"))
    return doctree.titles(rows)


@query(
    "text_helpers",
    r"""select doc_id, substr(trim(text), 1, 200) as clamped, text like '%fine%' or text like '%EUR%' or text like '%penalt%' as money, case when source like 'w%' then 'w:' || substr(source, 2) else source end as short from documents""",
)
def text_helpers(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", x.clamp(t).alias("clamped"), x.money_prefilter(t).alias("money"), x.namespace_prefix(F.col("source"), {"w": "w"}).alias("short"))


@query("evidence_of_matches", "select s_suppkey, s_name || ' pays 7 % and then ' || s_suppkey || ' %' as text, ['7 %', s_suppkey || ' %'] as matches, substr(s_name || ' pays ', -6) || '7 % and' as first from supplier")
def evidence_of_matches(spark, d):
    text = F.concat("s_name", F.lit(" pays 7 % and then "), F.col("s_suppkey").cast("string"), F.lit(" %"))
    got = table(spark, d, "supplier").select("s_suppkey", text.alias("text")).withColumn("e", x.snippets(F.col("text"), r"\d+ %", 6, 4))
    return got.select("s_suppkey", "text", F.transform("e", lambda p: p["match"]).alias("matches"), F.concat(F.lit(" "), F.get("e", F.lit(0))["evidence"]).alias("first"))
