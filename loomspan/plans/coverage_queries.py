"""Operators that no other query shows, over whole tables: scoring against gold, completions, summaries, texts, the indexed store, splits of Turtle."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import text as x
from loomspan.operators import completer, matching, metrics, wiring
from loomspan.operators.store import build_store
from loomspan.plans.patterns import PREFIXES
from loomspan.plans.registry import ORACLE, query
from loomspan.plans.relational import EX, duck_triples, table, triples_of
from loomspan.session import scratch
from loomspan.sources import turtle
from loomspan.terms import LABEL, OWL, TYPE, XSD, construct, iri, term_struct, triples

_S = "cast({} as varchar)"


def s(c: str):
    return F.col(c).cast("string")


# gold and predictions: every line's part is gold; lines with an odd number are predicted in other writing, returned ones wrongly

_GOLD = "select l_orderkey as sentence, l_returnflag as type, '#' || l_partkey || '#' as t, count(*) as n from lineitem group by all"
_MADE = "select l_orderkey as sentence, l_returnflag as type, case when l_returnflag = 'R' then '?' || l_partkey || '?' else '#' || l_partkey || '#' end as t, count(*) as n from lineitem where l_linenumber % 2 = 1 group by all"


def _gold(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sentence"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").cast("int").alias("pos"), F.concat(F.lit("Part #"), s("l_partkey"), F.lit("#.")).alias("text"))


def _predicted(spark, d):
    rows = table(spark, d, "lineitem").where("l_linenumber % 2 = 1")
    mark = F.when(F.col("l_returnflag") == "R", "?").otherwise("#")
    return rows.select(F.col("l_orderkey").alias("sentence"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").cast("int").alias("pos"), F.concat(F.lit("PART  "), mark, s("l_partkey"), mark, F.lit(" ;")).alias("text"))


_COUNTED = f"""with g as ({_GOLD}), p as ({_MADE}), b as (select coalesce(g.sentence, p.sentence) as sentence, coalesce(g.type, p.type) as type, least(coalesce(g.n, 0), coalesce(p.n, 0)) as tp, coalesce(g.n, 0) as gold, coalesce(p.n, 0) as made
    from g full join p on g.sentence = p.sentence and g.type = p.type and g.t = p.t),
    c as (select sentence, type, sum(tp)::bigint as tp, (sum(made) - sum(tp))::bigint as fp, (sum(gold) - sum(tp))::bigint as fn from b group by 1, 2)"""


@query("entity_matches", f"{_COUNTED} select * from c")
def entity_matches(spark, d):
    return matching.match_entities(_gold(spark, d), _predicted(spark, d))


@query(
    "entity_scores",
    f"""{_COUNTED}, a as (select type, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from c group by 1 union all select 'overall', sum(tp)::bigint, sum(fp)::bigint, sum(fn)::bigint from c)
    select *, round(tp / nullif(tp + fp, 0)::double, 3) as precision, round(tp / nullif(tp + fn, 0)::double, 3) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 3) as f1 from a""",
)
def entity_scores(spark, d):
    return metrics.precision_recall(matching.match_entities(_gold(spark, d), _predicted(spark, d)))


@query(
    "combined_predictions",
    """with r as (select l_orderkey as sentence, l_returnflag as type, l_linenumber as pos, 'part ' || l_partkey as t, 'Part ' || l_partkey || '.' as text, 0 as sys from lineitem where l_linenumber > 2
        union all select l_orderkey, l_returnflag, l_linenumber, 'part ' || l_partkey, 'PART  ' || l_partkey || ' ', 1 from lineitem)
    select sentence, type, pos, text from (select *, row_number() over (partition by sentence, type, t order by sys, pos) as k from r) where k = 1""",
)
def combined_predictions(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sentence"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("pos"), "l_partkey")
    first = rows.where("pos > 2").select("sentence", "type", "pos", F.concat(F.lit("Part "), s("l_partkey"), F.lit(".")).alias("text"))
    second = rows.select("sentence", "type", "pos", F.concat(F.lit("PART  "), s("l_partkey"), F.lit(" ")).alias("text"))
    return matching.combined(first, second)


@query(
    "summary_layer",
    f"""select '{EX}Article_' || p_partkey as s, p, case p when '{EX}hasSummary' then p_name else 'http://p/' || p_partkey end as o from part, (values ('{EX}hasSummary'), ('{EX}hasSourceURL')) v(p) where p_size % 5 > 0
    union select '{EX}Annex_' || s_suppkey, p, case p when '{EX}hasSummary' then s_name else 'http://s/' || s_suppkey end from supplier, (values ('{EX}hasSummary'), ('{EX}hasSourceURL')) v(p)""",
)
def summary_layer(spark, d):
    """Summaries of parts and suppliers; a size that five divides has a blank one, which adds nothing."""
    a = table(spark, d, "part").select(F.col("p_partkey").alias("number"), F.when(F.col("p_size") % 5 > 0, F.col("p_name")).otherwise("  ").alias("summary"), F.concat(F.lit("http://p/"), s("p_partkey")).alias("source_url"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("number"), F.col("s_name").alias("summary"), F.concat(F.lit("http://s/"), s("s_suppkey")).alias("source_url"))
    return wiring.summary_triples(a, b, EX).select("s", "p", "o")


@query("accepted_controls", f"select distinct '{EX}order/' || o_orderkey as s, '{EX}requiresControl' as p, '{EX}control/' || o_custkey as o from orders where o_orderstatus = 'F'")
def accepted_controls(spark, d):
    """An answer for each order: accepted, refused, in a fence, or no JSON."""
    answer = F.when(F.col("o_orderstatus") == "F", '```json\n{"requires": true, "reason": "x"}\n```').when(F.col("o_orderstatus") == "O", '{"requires": false}').otherwise("no json")
    rows = table(spark, d, "orders").select(F.concat(F.lit(EX + "order/"), s("o_orderkey")).alias("obligation"), F.concat(F.lit(EX + "control/"), s("o_custkey")).alias("control"), answer.alias("answer"))
    return completer.accepted_pairs(rows, EX).select("s", "p", "o")


@query("single_literals", f"select '{EX}order/' || o_orderkey as s, '{EX}hasOJReference' as p, 'OJ ' || o_orderkey as o from orders where o_orderstatus <> 'P'")
def single_literals(spark, d):
    """A reference for each order, padded; a blank one for those of status P."""
    value = F.when(F.col("o_orderstatus") == "P", F.lit("  ")).otherwise(F.concat(F.lit(" OJ "), s("o_orderkey"), F.lit(" ")))
    rows = table(spark, d, "orders").select(F.concat(F.lit(EX + "order/"), s("o_orderkey")).alias("s"), F.to_json(F.struct(value.alias("oj_reference"))).alias("answer"))
    return completer.single_literal(rows, EX, "oj_reference", "hasOJReference").select("s", "p", "o")


def _fields(name: str, once: bool, cls: str, parent: str, reference: str) -> None:
    repeats = "" if once else " union select 'f' || n_regionkey, 'again ' || n_regionkey from nation where n_nationkey < 0"
    kept = "arg_min(n_name, n_nationkey)" if once else "unnest(list(distinct n_name))"
    sql = f"""with f as (select 'field ' || n_regionkey as suffix, {kept} as summary from nation where n_regionkey > 0 group by n_regionkey{repeats}), g as (select *, '{EX}' || replace(suffix, ' ', '_') as s from f)
    select s, '{TYPE}' as p, '{EX}{cls}' as o from g union select s, '{LABEL}', suffix from g union select s, '{EX}hasSummary', summary from g union select s, '{EX}hasAnnexReference', '{EX}{reference}' from g
    union select '{EX}{parent}', '{EX}hasRequiredComponent', s from g union select s, '{EX}hasComponentOf', '{EX}{parent}' from g"""

    @query(name, sql)
    def run(spark, d):
        """Fields that answers list: one is in the graph already, one has no name, others repeat."""
        suffix = F.when(F.col("n_regionkey") == 0, F.lit("known")).otherwise(F.concat(F.lit("field "), s("n_regionkey")))
        one = F.struct(suffix.alias("uri_suffix"), F.lit("1").alias("paragraph"), F.lit(None).cast("string").alias("section"), F.col("n_name").alias("summary"))
        blank = F.struct(F.lit(" ").alias("uri_suffix"), F.lit("1").alias("paragraph"), F.lit(None).cast("string").alias("section"), F.lit("none").alias("summary"))
        # the first answer of a name counts by its place in its list, so each list holds its region's nations in order
        lists = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("i")))).alias("l"))
        rows = lists.select(F.to_json(F.struct(F.array_append(F.transform("l", lambda i: i["i"]), blank).alias("fields"))).alias("answer"))
        known = triples(spark, [(EX + "known", TYPE, iri(EX + cls))])
        return completer.new_components(rows, known, EX, "fields", cls, parent, reference, once).select("s", "p", "o")


_fields("gap_registration_fields", True, "RegistrationField", "RegistrationRecord_Annex_VIII", "Annex_VIII")
_fields("gap_testing_fields", False, "TestingPlanField", "TestingPlan_Annex_IX", "Annex_IX")


@query("prompt_examples", f"select '{EX}part/' || p_partkey as s from part order by s limit 5")
def prompt_examples(spark, d):
    return completer.examples(triples_of(spark, d, "part"), EX + "Part", EX).select("s")


@query(
    "rescoped_usage",
    f"""with own as (select distinct '{EX}' || p_type as element from part where p_size > 25), declared as (select distinct '{EX}' || p_type as element from part union select '{EX}Unused')
    select 'some' as scope, element from declared join own using (element) union all select 'all', element from declared""",
)
def rescoped_usage(spark, d):
    """Part types as declared elements, scoped to those that a graph declares; a graph without declarations leaves all."""
    kind = F.concat(F.lit(EX), F.col("p_type"))
    part = table(spark, d, "part")
    declared = part.select(kind.alias("element")).distinct().unionByName(spark.range(1).select(F.lit(EX + "Unused").alias("element")))
    g = construct(part.where("p_size > 25"), term_struct(kind, TYPE, F.lit(OWL + "Class"), "iri"), term_struct(kind, LABEL, F.col("p_brand")))
    scoped = lambda name, h: metrics.rescoped(declared, h, [OWL + "Class"]).select(F.lit(name).alias("scope"), "element")
    return scoped("some", g).unionByName(scoped("all", g.where(F.col("p") == LABEL)))


@query(
    "cleaned_texts",
    r"""select c_custkey as k, c_name || ' x' as extracted, c_name || ' costs 5 € ... end' as summary, lower(c_name) || ' seg' as entity, case when c_custkey % 3 = 0 then ['CQ' || c_custkey, 'LLM2'] else ['LLM2'] end as targets,
    left(c_name || repeat('y', c_custkey % 300), 200) as clamped, c_custkey % 4 < 3 as body, case when c_custkey % 2 = 0 then cast(c_custkey as varchar) end as number,
    'types: A, B; label: ' || c_name || case when c_custkey % 2 = 0 then '; summary: ' || c_mktsegment else '' end as said, '{"a": ' || c_custkey || '}' as unfenced from customer""",
)
def cleaned_texts(spark, d):
    """The helpers of texts on every customer's, with no-break spaces, mangled characters, closing notes, fences and odd classes."""
    k, name = s("c_custkey"), F.col("c_name")
    even = F.col("c_custkey") % 2 == 0
    cls = F.get(F.array(F.lit("oj-normal"), F.lit("oj-ti-grseq-7"), F.lit("oj-table-cell-2"), F.lit("oj-other")), (F.col("c_custkey") % 4).cast("int"))
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("k"),
        x.clean_extracted(F.concat(F.lit(" Â"), name, F.lit("   Âx``"))).alias("extracted"),
        x.filter_summary(F.concat(name, F.lit("  costs 5 â‚¬ â€¦\nend  Generated by  CLaiRK, any\ttext"))).alias("summary"),
        x.normalise_entity(F.concat(F.lit("  "), name, F.lit("\tSEG.,!?"))).alias("entity"),
        x.normalise_targets(F.array(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("c q "), k)).otherwise("other"), F.lit("llm 2"))).alias("targets"),
        x.clamp(F.concat(F.lit("  "), name, F.repeat(F.lit("y"), (F.col("c_custkey") % 300).cast("int")))).alias("clamped"),
        x.annex_body_class(cls).alias("body"),
        x.embedded_number(F.when(even, F.concat(F.lit("see 7. One and "), k, F.lit(". Two, 9. three"))).otherwise("none 1. here")).alias("number"),
        x.verbalise(F.array(F.lit("A"), F.lit("B")), name, F.when(even, F.col("c_mktsegment")), F.array().cast("array<string>")).alias("said"),
        x.unfenced(F.concat(F.lit("```json\n{\"a\": "), k, F.lit("}\n```"))).alias("unfenced"),
    )


@query(
    "baseline_recall",
    """with a as (select 'llm_only' as condition, 0.5 as recall, case when o_orderkey % 2 = 0 then 1 else 0 end as out_of_range from orders
        union all select 'graph', case when o_orderstatus = 'F' then 1.0 else 0.5 end, 0 from orders)
    select condition, round(avg(recall), 3)::double as recall, sum(out_of_range)::bigint as out_of_range from a group by 1""",
)
def baseline_recall(spark, d):
    """A question for each order under two conditions: prompts, replayed answers, recall of keywords and its mean."""
    o = table(spark, d, "orders")
    questions = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("What of order "), s("o_orderkey"), F.lit("?")).alias("question"), F.array(s("o_orderkey"), F.lit("Delivered")).alias("keywords"))
    contexts = o.select(F.col("o_orderkey").alias("id"), F.lit("graph").alias("condition"), F.concat(F.lit("status "), "o_orderstatus").alias("context"))
    prompts = completer.baseline_prompts(questions, contexts)
    said = F.when((F.col("condition") == "graph") & F.col("prompt").endswith("status F"), F.concat(F.lit("DELIVERED order "), s("id"))).when((F.col("condition") == "llm_only") & (F.col("id") % 2 == 0), F.concat(F.lit("Article 999 of order "), s("id"))).otherwise(F.concat(F.lit("order "), s("id")))
    recorded = prompts.select(completer.prompt_key(F.col("prompt")).alias("prompt_key"), said.alias("answer"))
    return metrics.mean_recall(metrics.recall_of_keywords(completer.replay(prompts, recorded)))


@query(
    "extracted_instances",
    """with i as (select o_custkey as source_article, 'Obligation' as type, 'order_' || o_orderkey || '_art' as uri_suffix from orders where o_orderstatus <> 'P'
        union all select o_custkey, 'AIRegulatorySandbox', 'box_' || min(o_orderkey) || '_art' from orders where o_orderstatus = 'P' group by 1) select * from i""",
)
def extracted_instances(spark, d):
    """An answer for each customer with their orders as instances: suffixes get the tag, one sandbox an article stays."""
    sandbox = F.col("o_orderstatus") == "P"
    one = F.struct(F.concat(F.when(sandbox, "box ").otherwise("order "), s("o_orderkey")).alias("uri_suffix"), F.when(sandbox, "AIRegulatorySandbox").otherwise("Obligation").alias("type"))
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("i")))).alias("l"))
    rows = per.select(F.col("o_custkey").alias("source_article"), F.lit(None).cast("string").alias("source_annex"), F.lit("art").alias("tag"), F.to_json(F.struct(F.transform("l", lambda i: i["i"]).alias("instances"))).alias("answer"))
    return completer.extracted(rows).select("source_article", "type", "uri_suffix")


# the indexed store answers what the plain engine does


def _stored(name: str, like: str, tables: tuple[str, ...], text: str) -> None:
    @query(name, ORACLE[like])
    def run(spark, d):
        return build_store(triples_of(spark, d, *tables, repeats=True)).sparql(PREFIXES + text)


_stored(
    "store_chain", "five_pattern_chain", ("lineitem", "orders", "customer", "nation", "supplier"),
    """SELECT DISTINCT ?from ?to WHERE { ?l ex:ofOrder ?o ; ex:suppliedBy ?s ; ex:quantity ?q . FILTER(?q >= 50)
       ?o ex:placedBy ?c . ?c ex:locatedIn ?a . ?s ex:locatedIn ?b . ?a rdfs:label ?to . ?b rdfs:label ?from }""",
)
_stored("store_star", "star_bag", ("customer",), "SELECT ?segment ?nation WHERE { ?c a ex:Customer ; ex:segment ?segment ; ex:locatedIn ?nation }")
_stored(
    "store_closure", "path_closure_count", ("supplier", "nation", "region"),
    """SELECT ?place (COUNT(DISTINCT ?s) AS ?n) WHERE { ?s a ex:Supplier ; ex:locatedIn ?at . ?at ex:partOf* ?place } GROUP BY ?place""",
)


@query("characteristic_sets", f"""with t as ({duck_triples("part", "documents", "labels")}), c as (select s, string_agg(distinct p, ' ' order by p) as names from t group by s) select names, count(*) as n from c group by 1""")
def characteristic_sets(spark, d):
    """The sets of predicates that subjects have, and how many subjects have each, from a store's statistics."""
    store = build_store(triples_of(spark, d, "part", "documents", "labels", repeats=True))
    return spark.read.parquet(f"{store.folder}/sets").select(F.array_join(F.array_sort("names"), " ").alias("names"), "n")


@query("turtle_splits", f"select s, p, o, o_kind, o_dt from ({duck_triples('customer')})")
def turtle_splits(spark, d):
    """Customers written as Turtle and read again in splits."""
    path = scratch(spark, "turtle")
    turtle.write_turtle(triples_of(spark, d, "customer"), path, {"ex": EX, "xsd": XSD})
    return turtle.read_turtle(spark, f"{path}/*.txt", split=True).select("s", "p", "o", "o_kind", "o_dt")


def _answered(prompt: str) -> str:
    """A recorded model: orders of status P fail, of status O answer no JSON."""
    _, key, status = prompt.split(" ")
    if status == "P":
        raise OSError("no answer")
    return "none" if status == "O" else '{"instances": [{"uri_suffix": "order_' + key + '", "type": "Order"}, {"type": "Nothing"}]}'


@query(
    "instances_in_sql",
    """select o_orderkey as id, case when o_orderstatus = 'F' then 'order_' || o_orderkey end as uri_suffix, case o_orderstatus when 'P' then 'OSError: no answer' when 'O' then 'no answer' end as error from orders""",
)
def instances_in_sql(spark, d):
    """A prompt for each order through a table function; failures are rows."""
    from loomspan.operators.table_functions import instance_function

    spark.udtf.register("loomspan_instances", instance_function(_answered, pause=0))
    prompts = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", F.lit("order"), s("o_orderkey"), "o_orderstatus").alias("prompt"))
    found = spark.sql("SELECT p.id, i.uri_suffix, i.error FROM {prompts} p, LATERAL loomspan_instances(p.prompt) i", prompts=prompts)
    return found.select("id", "uri_suffix", F.regexp_replace("error", "^no answer: .*", "no answer").alias("error"))


@query(
    "suffix_matches",
    """with k as (select distinct right(c_name, 3) as key from customer union select distinct right(c_name, 5) from customer where c_custkey % 2 = 0), m as (select s_suppkey, arg_min(key, (length(key), key)) as key from supplier join k on ends_with(s_name, key) group by 1)
    select s_suppkey, m.key from supplier left join m using (s_suppkey)""",
)
def suffix_matches(spark, d):
    """Suppliers by the ends of customers' names: the shortest that fits, then the first."""
    c = table(spark, d, "customer")
    ends = c.select(F.right("c_name", F.lit(3)).alias("key")).unionByName(c.where("c_custkey % 2 = 0").select(F.right("c_name", F.lit(5)).alias("key")))
    names = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return matching.suffix_join(names, ends.select("key", F.length("key").alias("pos")), "s_name").select("s_suppkey", "key")


# whole documents with odd writing put among their words: no-break spaces, line breaks, commas in amounts, mixed case

_SP = r"[\s\x{00A0}]"
_ODD = r"""coalesce(text, '') || E' WITHIN\n' || (doc_id % 300 + 1) || chr(160) || 'Days; fines up to' || chr(160) || (doc_id % 900 + 100) || ',000 eur, or ' || (doc_id % 9 + 1) || E' %\tof its total  WORLDWIDE annual\nturnover. article ' || (doc_id % 113 + 1) || ' and Article' || chr(160) || (doc_id % 50 + 1) || ', regulation (EU) 20' || (doc_id % 10 + 10) || ' / ' || (doc_id % 3000 + 1)"""


@query(
    "extracted_from_documents",
    rf"""with t as (select doc_id, {_ODD} as t from documents),
    m as (select doc_id, regexp_extract_all(t, '(?i)(?:within|no{_SP}+later{_SP}+than|not{_SP}+later{_SP}+than){_SP}+(\d{{1,4}}){_SP}+(?:day|week|month|year|hour)s?', 1) as n,
        regexp_extract_all(t, '(?i)(?:within|no{_SP}+later{_SP}+than|not{_SP}+later{_SP}+than){_SP}+\d{{1,4}}{_SP}+(day|week|month|year|hour)s?', 1) as u,
        regexp_extract_all(t, '(?i)(?:EUR{_SP}+)?(\d{{1,3}}(?:(?:{_SP}|,)\d{{3}}){{1,3}}){_SP}*(?:EUR|euros?|€)', 1) as f,
        regexp_extract_all(t, '(?i)(\d+(?:\.\d+)?){_SP}*%{_SP}*(?:[\w,()]+{_SP}+){{0,8}}?(?:total{_SP}+)?worldwide{_SP}+annual{_SP}+turnover', 1) as r,
        regexp_extract_all(t, '(?i)\barticle{_SP}+(\d+)', 1) as a,
        regexp_extract_all(t, '(?i)regulation{_SP}*\(EU\){_SP}*(20\d{{2}}){_SP}*/{_SP}*(\d{{1,4}})', 1) as y, regexp_extract_all(t, '(?i)regulation{_SP}*\(EU\){_SP}*(20\d{{2}}){_SP}*/{_SP}*(\d{{1,4}})', 2) as k from t)
    select doc_id, array_to_string([case when lower(x[2]) = 'hour' then 'PT' || x[1] || 'H' else 'P' || x[1] || upper(x[2][1]) end for x in list_zip(n, u)], ' ') as durations,
        array_to_string([regexp_replace(x, '[\s\x{{00A0}},]', '', 'g') for x in f], ' ') as fines, array_to_string([round(x::double / 100, 4) for x in r], ' ') as ratios,
        array_to_string(case when len(a) = 2 and a[1] = a[2] then [a[1]] else a end, ' ') as articles, array_to_string(['3' || x[1] || 'R' || lpad(x[2], 4, '0') for x in list_zip(y, k)], ' ') as laws from m""",
)
def extracted_from_documents(spark, d):
    n = lambda mod, add: (F.col("doc_id") % mod + add).cast("string")
    odd = F.concat(
        F.coalesce("text", F.lit("")), F.lit(" WITHIN\n"), n(300, 1), F.lit("\u00a0Days; fines up to\u00a0"), n(900, 100), F.lit(",000 eur, or "), n(9, 1), F.lit(" %\tof its total  WORLDWIDE annual\nturnover. article "),
        n(113, 1), F.lit(" and Article\u00a0"), n(50, 1), F.lit(", regulation (EU) 20"), n(10, 10), F.lit(" / "), n(3000, 1),
    )
    t = table(spark, d, "documents").select("doc_id", odd.alias("t"))
    plain = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    return t.select("doc_id", plain(x.deadlines(F.col("t"))).alias("durations"), plain(x.fines(F.col("t"))).alias("fines"), plain(x.fine_ratios(F.col("t"))).alias("ratios"), plain(x.article_refs(F.col("t"))).alias("articles"), plain(x.legislation_refs(F.col("t"))).alias("laws"))
