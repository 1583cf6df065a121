"""Graph-pattern queries over the test tables: scans, joins, filters, bindings, unions, paths, groups, order."""

from __future__ import annotations

from loomspan.operators.sparql import sparql
from loomspan.plans.registry import query
from loomspan.plans.relational import EX, duck_triples, triples_of

PREFIXES = f"PREFIX ex: <{EX}>\nPREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>\n"
E = EX


def pattern(name: str, tables: tuple[str, ...], text: str, sql: str) -> None:
    """Register a SPARQL text over some tables' triples and its SQL over the tables."""
    query(name, sql.replace("@", E))(lambda spark, d: sparql(triples_of(spark, d, *tables), PREFIXES + text))


pattern(
    "chain_optional_distinct", ("orders", "customer", "nation"),
    """SELECT DISTINCT ?nation ?name ?segment WHERE { ?o a ex:Order ; ex:status "F" ; ex:placedBy ?c . ?c ex:locatedIn ?nation .
       OPTIONAL { ?nation rdfs:label ?name } OPTIONAL { ?c ex:segment ?segment } } ORDER BY ?nation""",
    """select distinct '@nation/' || c_nationkey as nation, n_name as name, c_mktsegment as segment from orders
       join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey where o_orderstatus = 'F'""",
)
pattern(
    "star_bag", ("customer",),
    "SELECT ?segment ?nation WHERE { ?c a ex:Customer ; ex:segment ?segment ; ex:locatedIn ?nation } ORDER BY ?area",
    "select c_mktsegment as segment, '@nation/' || c_nationkey as nation from customer",
)
pattern(
    "optional_miss", ("documents", "labels"),
    "SELECT ?d ?lang ?q WHERE { ?d a ex:Document ; ex:lang ?lang . OPTIONAL { ?d ex:quality ?q } }",
    "select '@doc/' || d.doc_id as d, lang, cast(quality as varchar) as q from documents d left join labels l on d.doc_id = l.doc_id",
)
pattern(
    "optional_inner_filter", ("documents", "labels"),
    "SELECT ?d ?q WHERE { ?d ex:lang \"de\" . OPTIONAL { ?d ex:quality ?q . FILTER(?q >= 1) } }",
    "select '@doc/' || d.doc_id as d, cast(quality as varchar) as q from documents d left join labels l on d.doc_id = l.doc_id and quality >= 1 where lang = 'de'",
)
pattern(
    "filter_decimal_bind", ("lineitem",),
    "SELECT DISTINCT ?part ?pct WHERE { ?l ex:discount ?d ; ex:ofPart ?part . FILTER(?d >= 0.09) BIND(?d * 100 AS ?pctRaw) BIND(STR(?d) AS ?pct) }",
    "select distinct '@part/' || l_partkey as part, cast(cast(l_discount as decimal(18,2)) as varchar) as pct from lineitem where cast(l_discount as decimal(18,2)) >= 0.09",
)
pattern(
    "filter_in", ("orders",),
    'SELECT ?o ?s WHERE { ?o ex:status ?s ; ex:priority ?p . FILTER(?s IN ("F", "P")) FILTER(?p NOT IN ("1-URGENT")) }',
    "select '@order/' || o_orderkey as o, o_orderstatus as s from orders where o_orderstatus in ('F','P') and o_orderpriority not in ('1-URGENT')",
)
pattern(
    "filter_regex", ("part",),
    'SELECT DISTINCT ?p ?name WHERE { ?p a ex:Part ; rdfs:label ?name . FILTER(REGEX(STR(?name), "ring|blue", "i")) } ORDER BY ?brand',
    "select distinct '@part/' || p_partkey as p, p_name as name from part where regexp_matches(p_name, 'ring|blue', 'i')",
)
pattern(
    "filter_iri_equality", ("nation", "region"),
    "SELECT ?n WHERE { ?n ex:partOf ?r . FILTER(?r = ex:region/1) FILTER(?n != <@nation/99>) }".replace("ex:region/1", "<@region/1>").replace("@", E),
    "select '@nation/' || n_nationkey as n from nation where n_regionkey = 1",
)
pattern(
    "bind_constant", ("customer",),
    "SELECT DISTINCT ?kind ?segment WHERE { ?c ex:segment ?segment . BIND(ex:Customer AS ?kind) ?c a ?kind }",
    "select distinct '@Customer' as kind, c_mktsegment as segment from customer",
)
pattern(
    "bind_functions", ("orders",),
    """SELECT ?o ?id WHERE { ?o ex:orderDate ?d ; ex:status ?s . FILTER(?s = "P")
       BIND(IRI(CONCAT(STR(ex:day_), REPLACE(STR(?d), "-", ""), "_", ENCODE_FOR_URI(COALESCE(?s, ?d)))) AS ?id) }""",
    "select '@order/' || o_orderkey as o, '@day_' || strftime(o_orderdate, '%Y%m%d') || '_' || o_orderstatus as id from orders where o_orderstatus = 'P'",
)
pattern(
    "union_then_optional", ("part",),
    """SELECT DISTINCT ?x ?name ?size WHERE { { ?x ex:brand "Brand#11" } UNION { ?x ex:size ?s . FILTER(?s IN (1, 50)) }
       OPTIONAL { ?x rdfs:label ?name } OPTIONAL { ?x ex:size ?size } }""",
    "select distinct '@part/' || p_partkey as x, p_name as name, cast(p_size as varchar) as size from part where p_brand = 'Brand#11' or p_size in (1, 50)",
)
pattern(
    "path_closure_count", ("supplier", "nation", "region"),
    """SELECT ?place (COUNT(DISTINCT ?s) AS ?n) WHERE { ?s a ex:Supplier ; ex:locatedIn ?at . ?at ex:partOf* ?place }
       GROUP BY ?place ORDER BY DESC(?n) ?place""",
    """with recursive edge as (select '@nation/' || n_nationkey as low, '@region/' || n_regionkey as high from nation union select '@region/' || r_regionkey, '@world' from region),
       walk as (select '@nation/' || n_nationkey as begun, '@nation/' || n_nationkey as place from nation union select begun, high from walk join edge on place = low)
       select place, cast(count(distinct s_suppkey) as varchar) as n from supplier join walk on begun = '@nation/' || s_nationkey group by place""",
)
pattern(
    "path_to_constant", ("nation", "region"),
    "SELECT ?x WHERE { ?x ex:partOf+ ex:world }",
    "select '@nation/' || n_nationkey as x from nation union select '@region/' || r_regionkey from region",
)
pattern(
    "distinct_hidden_sort", ("customer", "nation"),
    "SELECT DISTINCT ?segment ?name WHERE { ?c ex:segment ?segment ; ex:locatedIn ?n . ?n rdfs:label ?name } ORDER BY ?c",
    "select distinct c_mktsegment as segment, n_name as name from customer join nation on c_nationkey = n_nationkey",
)
pattern(
    "distinct_hidden_sort_desc", ("part",),
    "SELECT DISTINCT ?brand WHERE { ?p ex:brand ?brand ; ex:size ?z } ORDER BY DESC(?z) ?brand",
    "select distinct p_brand as brand from part",
)
pattern(
    "group_aggregates", ("orders",),
    "SELECT ?status (COUNT(?o) AS ?n) (MAX(?t) AS ?top) WHERE { ?o ex:status ?status ; ex:total ?t } GROUP BY ?status",
    "select o_orderstatus as status, cast(count(*) as varchar) as n, regexp_replace(cast(max(cast(o_totalprice as decimal(18,2))) as varchar), '\\.?0+$', '') as top from orders group by 1",
)
pattern(
    "five_pattern_chain", ("lineitem", "orders", "customer", "nation", "supplier"),
    """SELECT DISTINCT ?from ?to WHERE { ?l ex:ofOrder ?o ; ex:suppliedBy ?s ; ex:quantity ?q . FILTER(?q >= 50)
       ?o ex:placedBy ?c . ?c ex:locatedIn ?a . ?s ex:locatedIn ?b . ?a rdfs:label ?to . ?b rdfs:label ?from }""",
    """select distinct b.n_name as "from", a.n_name as "to" from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
       join nation a on a.n_nationkey = c_nationkey join supplier on l_suppkey = s_suppkey join nation b on b.n_nationkey = s_nationkey where cast(l_quantity as decimal(18,2)) >= 50""",
)
pattern(
    "variable_predicate", ("nation",),
    "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p",
    f"select p, cast(count(*) as varchar) as n from ({duck_triples('nation')}) group by p",
)
pattern(
    "all_optionals_projected", ("documents", "labels"),
    "SELECT DISTINCT ?q ?t WHERE { ?d a ex:Document ; ex:lang ?l . OPTIONAL { ?d ex:quality ?q } OPTIONAL { ?d ex:toxic ?t } }",
    "select distinct cast(quality as varchar) as q, cast(toxic as varchar) as t from documents d left join labels l on d.doc_id = l.doc_id",
)
pattern(
    "construct_rows", ("customer", "nation"),
    "CONSTRUCT { ?c ex:livesIn ?name ; a ex:Person . ?n ex:hasResident ?c . ?c ex:note ?missing } WHERE { ?c ex:locatedIn ?n . OPTIONAL { ?n rdfs:label ?name . FILTER(?name = \"NATION_1\" || STRSTARTS(?name, \"A\")) } OPTIONAL { ?c ex:nothing ?missing } }",
    """with t as (select '@customer/' || c_custkey as c, '@nation/' || n_nationkey as n, case when n_name = 'NATION_1' or starts_with(n_name, 'A') then n_name end as name from customer join nation on c_nationkey = n_nationkey)
       select c as s, 'iri' as s_kind, '@livesIn' as p, name as o, 'literal' as o_kind, cast(null as varchar) as o_dt, cast(null as varchar) as o_lang from t where name is not null
       union select c, 'iri', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '@Person', 'iri', null, null from t
       union select n, 'iri', '@hasResident', c, 'iri', null, null from t""",
)
pattern(
    "bind_product", ("lineitem",),
    "SELECT DISTINCT ?part ?pct ?left WHERE { ?l ex:discount ?d ; ex:ofPart ?part . FILTER(?d >= 0.05) BIND(?d * 100 AS ?pct) BIND(1 - ?d AS ?left) }",
    """select distinct '@part/' || l_partkey as part, cast(cast(round(cast(l_discount as decimal(18,2)) * 100) as integer) as varchar) as pct, rtrim(rtrim(cast(1 - cast(l_discount as decimal(18,2)) as varchar), '0'), '.') as "left"
       from lineitem where cast(l_discount as decimal(18,2)) >= 0.05""",
)
pattern(
    "optional_outer_filter", ("documents", "labels"),
    "SELECT ?d ?q ?t WHERE { ?d ex:quality ?q . OPTIONAL { ?d ex:toxic ?t . FILTER(?t < ?q) } }",
    """select '@doc/' || doc_id as d, cast(quality as varchar) as q, case when toxic < quality then cast(toxic as varchar) end as t from (select distinct doc_id, quality, toxic from labels) where quality is not null""",
)
pattern(
    "optional_shared_variable", ("customer", "supplier", "nation"),
    """SELECT DISTINCT ?x ?name WHERE { ?x ex:locatedIn ?n . OPTIONAL { ?x ex:segment ?seg . ?x rdfs:label ?name } OPTIONAL { ?n rdfs:label ?name . FILTER(STRSTARTS(?name, "NATION_1") || STRSTARTS(?name, "A")) } }""",
    """select '@customer/' || c_custkey as x, c_name as name from customer
       union select '@supplier/' || s_suppkey, case when n_name like 'NATION_1%' or n_name like 'A%' then n_name end from supplier join nation on s_nationkey = n_nationkey""",
)
pattern(
    "extremes_of_text", ("customer", "orders"),
    "SELECT ?segment (MIN(?name) AS ?first) (MAX(?name) AS ?last) (MAX(?day) AS ?latest) WHERE { ?c ex:segment ?segment ; rdfs:label ?name . ?o ex:placedBy ?c ; ex:orderDate ?day } GROUP BY ?segment",
    """select c_mktsegment as segment, min(c_name) as first, max(c_name) as last, strftime(max(o_orderdate), '%Y-%m-%d') as latest from customer join orders on o_custkey = c_custkey group by 1""",
)
pattern(
    "patterns_out_of_order", ("orders", "customer", "nation"),
    """SELECT DISTINCT ?name ?status WHERE { ?n rdfs:label ?name . ?o ex:status ?status . ?c ex:locatedIn ?n . ?o ex:placedBy ?c }""",
    "select distinct n_name as name, o_orderstatus as status from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
)
pattern(
    "construct_typed_literal", ("orders",),
    'CONSTRUCT { ?o ex:day ?typed } WHERE { ?o ex:orderDate ?d ; ex:status "P" . BIND(STRDT(STR(?d), <http://www.w3.org/2001/XMLSchema#date>) AS ?typed) }',
    """select '@order/' || o_orderkey as s, 'iri' as s_kind, '@day' as p, strftime(o_orderdate, '%Y-%m-%d') as o, 'literal' as o_kind, 'http://www.w3.org/2001/XMLSchema#date' as o_dt, cast(null as varchar) as o_lang from orders where o_orderstatus = 'P'""",
)
pattern(
    "path_from_bound", ("customer", "nation", "region"),
    'SELECT DISTINCT ?segment ?up WHERE { ?c ex:segment ?segment ; ex:locatedIn ?n . ?n ex:partOf+ ?up }',
    """select distinct c_mktsegment as segment, unnest(['@region/' || n_regionkey, '@world']) as up from customer join nation on c_nationkey = n_nationkey""",
)
