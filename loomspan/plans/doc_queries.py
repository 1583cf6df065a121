"""Ordered rows: carried values, pending markers, first-wins rules, JSON and rules, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import doctree as t
from loomspan.operators import rules
from loomspan.plans.registry import query
from loomspan.plans.relational import EX, table
from loomspan.terms import TYPE


@query("carried_role", "select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn) as last_user from conversations")
def carried_role(spark, d):
    rows = table(spark, d, "conversations").withColumn("u", F.when(F.col("role") == "user", F.col("turn")))
    return t.carry_forward(rows, "u", "last_user", ["conv_id"], "turn").select("conv_id", "turn", "last_user")


# turns as a document: even turns of threes are bare markers, others paragraphs

SYNTHETIC = "case when turn % 3 = 0 then '(' || chr(97 + cast(turn % 26 as int)) || ')' when turn % 3 = 1 then turn || '. Body ' || conv_id else 'More of ' || conv_id end"


def _paragraphs(spark, d):
    n = F.col("turn").cast("string")
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("("), F.chr(F.lit(97) + F.col("turn") % 26), F.lit(")"))).when(F.col("turn") % 3 == 1, F.concat(n, F.lit(". Body "), F.col("conv_id").cast("string"))).otherwise(F.concat(F.lit("More of "), F.col("conv_id").cast("string")))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("unit"), F.lit("001.001").alias("container_id"), F.col("turn").alias("pos"), text.alias("text"))


@query(
    "content_items",
    f"""with p as (select conv_id as unit, turn as pos, {SYNTHETIC} as text from conversations),
    m as (select *, nullif(regexp_extract(text, '^\\(([A-Za-z0-9]+)\\)$', 1), '') as mark, nullif(regexp_extract(text, '^(\\d+)\\.\\s+(.*)$', 1), '') as own from p),
    l as (select *, lag(mark) over (partition by unit order by pos) as label from m),
    k as (select *, last_value(own ignore nulls) over (partition by unit order by pos) as number from l where mark is null)
    select unit, pos, coalesce('(' || label || ') ', '') || text as text, number as paragraph_number, label as list_label,
    'Article ' || unit || coalesce('(' || number || ')', '') || coalesce('(' || label || ')', '') as reference from k""",
)
def content_items(spark, d):
    return t.article_items(_paragraphs(spark, d)).select("unit", "pos", "text", "paragraph_number", "list_label", "reference")


@query("first_document_per_text", "select min(doc_id) as doc_id, md5(text) as digest from documents group by text")
def first_document_per_text(spark, d):
    rows = table(spark, d, "documents").withColumn("digest", F.md5("text"))
    return t.first_wins(rows, ["digest"], ["doc_id"]).select("doc_id", "digest")


@query("one_per_unit", "select o_orderkey from (select *, row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey) as n from orders) where o_orderstatus <> 'P' or n = 1")
def one_per_unit(spark, d):
    return t.one_per_unit(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "P", "o_orderkey").select("o_orderkey")


@query("event_json_triples", f"""select distinct s, p, o from (select '{EX}event/' || event_id as s, '{TYPE}' as p, '{EX}Event' as o from events union all select '{EX}event/' || event_id, '{EX}kind', event_type from events
    union all select '{EX}event/' || event_id, '{EX}by', '{EX}user/' || user_id from events union all select '{EX}event/' || event_id, '{EX}k', json_extract_string(props, '$.k') from events) where o is not null""")  # fmt: skip
def event_json_triples(spark, d):
    from loomspan.streaming.ingest import event_triples

    return event_triples(table(spark, d, "events"), EX).select("s", "p", "o")


@query("capped_pairs", """with a as (select n_regionkey as article, n_name as obligation, row_number() over (partition by n_regionkey order by n_name) as k from nation),
    b as (select n_regionkey as article, s_name as control, row_number() over (partition by n_regionkey order by s_name) as k from supplier join nation on s_nationkey = n_nationkey)
    select a.article, obligation, control from a join b on a.article = b.article where a.k <= 3 and b.k <= 2 order by 1, 2, 3 limit 15""")  # fmt: skip
def capped_pairs(spark, d):
    from loomspan.operators.completer import control_pairs
    from loomspan.operators.graphs import merge
    from loomspan.terms import construct, term_struct

    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    both = s.join(n, s.s_nationkey == n.n_nationkey)
    one = construct(n, term_struct(F.col("n_name"), TYPE, F.lit("AnObligation"), "iri"), term_struct(F.col("n_name"), "x:hasArticleReference", F.col("n_regionkey"), "iri"))
    two = construct(both, term_struct(F.col("s_name"), TYPE, F.lit("Control"), "iri"), term_struct(F.col("s_name"), "x:hasArticleReference", F.col("n_regionkey"), "iri"))
    return control_pairs(merge(one, two), "x:", "Control").select(F.col("article").cast("int").alias("article"), "obligation", "control")


@query("lacking_property", f"select '{EX}doc/' || d.doc_id as s from documents d left join labels l on d.doc_id = l.doc_id where l.doc_id is null order by 1 limit 14")
def lacking_property(spark, d):
    from loomspan.operators.completer import lacking
    from loomspan.plans.relational import triples_of

    return lacking(triples_of(spark, d, "documents", "labels"), [EX + "Document"], EX + "quality", 14)


@query("static_rules")
def static_rules(spark, d):
    return rules.summary(rules.areas(spark).unionByName(rules.requirements(spark)))


@query("schema_graph")
def schema_graph(spark, d):
    from loomspan.plans.tbox import tbox

    return tbox(spark, EX)


@query("schema_counts", "select * from (values ('Class', 47), ('ObjectProperty', 19), ('DatatypeProperty', 12), ('FunctionalProperty', 2), ('NamedIndividual', 16), ('subClassOf', 44), ('hasValue', 13)) v(what, n)")
def schema_counts(spark, d):
    """What the schema declares, by kind; restrictions and subclass axioms by their predicates."""
    from loomspan.plans.tbox import tbox
    from loomspan.terms import OWL, RDFS, TYPE, local_name

    g = tbox(spark, EX)
    kinds = g.where((F.col("p") == TYPE) & F.col("o").isin([OWL + k for k in ("Class", "ObjectProperty", "DatatypeProperty", "FunctionalProperty", "NamedIndividual")]) & (F.col("s_kind") == "iri")).select(local_name(F.col("o")).alias("what"))
    axioms = g.where(F.col("p").isin(RDFS + "subClassOf", OWL + "hasValue")).select(local_name(F.col("p")).alias("what"))
    return kinds.unionByName(axioms).groupBy("what").agg(F.count("*").alias("n"))


@query("replayed_model", "select o_orderkey as id, case when o_orderkey % 2 = 0 then '{\"fine_eur\": ' || cast(o_orderkey as varchar) || '}' else '{}' end as answer from orders")
def replayed_model(spark, d):
    from loomspan.operators.completer import prompt_key, replay

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("What fine for "), F.col("o_orderkey").cast("string")).alias("prompt"))
    rec = o.where("id % 2 = 0").select(prompt_key(F.col("prompt")).alias("prompt_key"), F.concat(F.lit('{"fine_eur": '), F.col("id").cast("string"), F.lit("}")).alias("answer"))
    return replay(o, rec).select("id", "answer")


# answers of a model, made from the customers, and the triples that gap fillers take from them


def _answers(spark, d, text):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(F.concat(F.lit(EX + "item_"), k.cast("string")).alias("s"), text(k).alias("answer"))


def _small(g):
    return g.select(F.replace("s", F.lit(EX), F.lit("")).alias("s"), F.replace("p", F.lit(EX), F.lit("")).alias("p"), F.replace("o", F.lit(EX), F.lit("")).alias("o"), F.regexp_replace("o_dt", "^.*#", "").alias("dt"))


@query("gap_fines", "select 'item_' || c_custkey as s, 'hasFine' as p, cast(c_custkey % 7 - 1 as varchar) as o, 'decimal' as dt from customer where c_custkey % 7 >= 1")
def gap_fines(spark, d):
    from loomspan.operators.completer import fine_triples

    return _small(fine_triples(_answers(spark, d, lambda k: F.concat(F.lit('{"fine_eur": '), F.when(k % 7 == 0, "-1").otherwise((k % 7 - 1).cast("string")), F.lit(".5}"))), EX))


@query("gap_ratios", "select 'item_' || c_custkey as s, 'hasMaximumFineRatio' as p, case when c_custkey % 13 = 10 then '1.0' else '0.' || (c_custkey % 13) end as o, 'decimal' as dt from customer where c_custkey % 13 between 1 and 10")
def gap_ratios(spark, d):
    from loomspan.operators.completer import ratio_triples

    return _small(ratio_triples(_answers(spark, d, lambda k: F.concat(F.lit('```json\n{"ratio": '), ((k % 13) / 10).cast("decimal(4,1)").cast("string"), F.lit("}\n```"))), EX))


@query("gap_deadlines", "select 'item_' || c_custkey as s, 'hasDeadline' as p, 'P' || (c_custkey % 40) || 'D' as o, 'duration' as dt from customer where c_custkey % 3 = 0")
def gap_deadlines(spark, d):
    from loomspan.operators.completer import deadline_triples

    return _small(deadline_triples(_answers(spark, d, lambda k: F.concat(F.lit('{"deadline": "'), F.when(k % 3 == 0, "P").otherwise(""), (k % 40).cast("string"), F.lit('D"}'))), EX))


_ANNEX4 = "TechnicalDocumentation_Annex_IV"


@query("gap_components", f"""with n as (select distinct 'part_' || (p_partkey % 50) as s, p_partkey % 50 as k from part), f as (select s, (select arg_min('size ' || p_size, p_partkey) from part where p_partkey % 50 = n.k) as text from n)
    select s, 'type' as p, 'DocumentationComponent' as o, cast(null as varchar) as dt from n union all select s, 'label', s, null from n union all select s, 'hasSummary', text, 'string' from f union all select s, 'hasAnnexReference', 'Annex_IV', null from n
    union all select '{_ANNEX4}', 'hasRequiredComponent', s, null from n union all select s, 'hasComponentOf', '{_ANNEX4}', null from n""")  # fmt: skip
def gap_components(spark, d):
    """Every part is a component of some answer; of those of one name the first counts."""
    from loomspan.operators.completer import new_components
    from loomspan.plans.tbox import tbox

    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.struct(k.alias("k"), F.struct(F.concat(F.lit("part_"), (k % 50).cast("string")).alias("uri_suffix"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("summary")).alias("c")).alias("x"))
    one = rows.agg(F.array_sort(F.collect_list("x")).alias("all")).select(F.concat(F.lit('{"components": '), F.to_json(F.transform("all", lambda x: x["c"])), F.lit("}")).alias("answer"))
    out = new_components(one, tbox(spark, EX), EX, "components", "DocumentationComponent", _ANNEX4, "Annex_IV")
    return _small(out).withColumn("p", F.element_at(F.split("p", "#"), -1)).withColumn("p", F.regexp_replace("p", "^.*/", ""))


@query("gap_obligations", """with n as (select distinct case when n_nationkey % 2 = 0 then 'code_art56_' || n_nationkey else 'code_' || n_nationkey || '_art56' end as s, n_nationkey as k from nation)
    select s, 'GPAIObligation' as o from n union all select 'ProviderStakeholder', s from n union all select 'GPAIModelInstance', s from n union all select 'GPAISystemicRiskModelInstance', s from n union all select s, 'Article_56' from n""")  # fmt: skip
def gap_obligations(spark, d):
    from loomspan.operators.completer import new_obligations

    k = F.col("n_nationkey")
    name = F.concat(F.lit("code "), F.when(k % 2 == 0, "art56 ").otherwise(""), k.cast("string"))
    ans = table(spark, d, "nation").select(F.concat(F.lit('{"obligations": [{"uri_suffix": "'), name, F.lit('"}]}')).alias("answer"))
    out = new_obligations(ans, EX, "art56", "Article_56", ["ProviderStakeholder", "GPAIModelInstance", "GPAISystemicRiskModelInstance"])
    return _small(out.where("o_kind = 'iri'")).select("s", "o")


@query("gap_areas", """with a as (select * from (values ('justice'), ('education'), ('migration')) v(k)) select 'AreaOfApplication_' || k as s, 'Annex_III' as o from a union all select 'AreaOfApplication_' || k, 'AreaOfApplication' from a
    union all select (select min('sys_' || n_nationkey || '_' || k) from nation where n_nationkey % 3 = case k when 'justice' then 0 when 'education' then 1 else 2 end), 'AreaOfApplication_' || k from a""")  # fmt: skip
def gap_areas(spark, d):
    from loomspan.operators import completer, rules

    keys = [r[0] for r in rules.AREAS]
    word = F.get(F.array(F.lit("justice"), F.lit("education"), F.lit("migration")), (F.col("n_nationkey") % 3).cast("int"))
    systems = table(spark, d, "nation").select(F.concat(F.lit(EX + "sys_"), F.col("n_nationkey").cast("string"), F.lit("_"), word).alias("s"))
    ans = table(spark, d, "nation").select(F.concat(F.lit('{"areas": [{"sector_key": " '), F.upper(word), F.lit('!"}, {"sector_key": "space"}]}')).alias("answer"))
    return _small(completer.area_triples(ans, systems, EX, keys, EX + "hasAreaOfApplication").where("o_kind = 'iri'")).select("s", "o")


@query("retrieved_context", """with a as (select p_partkey % 113 + 1 as n, min(p_name) as t from part group by 1) select c_custkey as id, coalesce(case when c_custkey % 2 = 0 then (select substr(t, 1, 12) from a where n = c_custkey % 130) else (select substr(min(s_name), 1, 12) from supplier where s_suppkey % 13 = c_custkey % 13) end, '') as context from customer""")
def retrieved_context(spark, d):
    """Texts of articles by number and of annexes by numeral, in any case, cut to a length."""
    from loomspan.operators.completer import retrieved
    from loomspan.plans import construction as c

    k = F.col("c_custkey")
    numeral = F.get(F.array(*[F.lit(r.lower()) for r in c.ROMAN]), (k % 13).cast("int"))
    asked = table(spark, d, "customer").select(k.alias("id"), F.when(k % 2 == 0, k % 130).cast("int").alias("article"), F.when(k % 2 == 1, numeral).alias("annex"))
    arts = c.article_items(spark, d).select("number", "text")
    return retrieved(asked, arts, c.annexes(spark, d), 12).select("id", "context")


@query("windowed_events", "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def windowed_events(spark, d):
    from loomspan.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, d, "events")).select("start", "event_type", "n")
