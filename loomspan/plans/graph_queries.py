"""Merging, changing and measuring graphs made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import graphs as g
from loomspan.operators import metrics as m
from loomspan.plans.registry import query
from loomspan.plans.relational import EX, duck_triples, table, triples_of
from loomspan.terms import TYPE, XSD

TRIPLE_SQL = "with t as (@T) "


def duck(sql: str, *names: str) -> str:
    return sql.replace("@T", duck_triples(*names)).replace("@", EX)


@query("merged_layers", duck("select s, p, o, o_kind, o_dt from (select * from (@T) a union select * from (@U) b)".replace("@U", duck_triples("nation")), "nation", "region"))
def merged_layers(spark, d):
    return g.merge(triples_of(spark, d, "nation", "region"), triples_of(spark, d, "nation")).select("s", "p", "o", "o_kind", "o_dt")


@query("layer_counts", duck(TRIPLE_SQL + ", n as (@N) select 'nation' as layer, count(*) as triples from n union all select 'both', count(*) from t union all select 'merged', count(*) from (select * from t union select * from n)".replace("@N", duck_triples("nation")), "nation", "customer"))
def layer_counts(spark, d):
    return g.layer_counts({"nation": triples_of(spark, d, "nation"), "both": triples_of(spark, d, "nation", "customer")})


DELETED = ["nation/3", "region/2", "customer/7"]
_gone = "(" + ", ".join(f"'{EX}{x}'" for x in DELETED) + ")"


def _manifest(spark):
    return spark.createDataFrame([(EX + x, x.split("/")[0]) for x in DELETED], "uri string, kind string")


@query("deleted_nodes", duck(TRIPLE_SQL + f"select s, p, o from t where s not in {_gone} and (o_kind = 'literal' or o not in {_gone})", "nation", "region", "customer"))
def deleted_nodes(spark, d):
    return g.delete_nodes(triples_of(spark, d, "nation", "region", "customer"), _manifest(spark)).select("s", "p", "o")


@query("deletion_counts", duck(TRIPLE_SQL + f"select split_part(replace(s, '@', ''), '/', 1) as kind, count(*) as subjects from t where s in {_gone} group by 1", "nation", "region", "customer"))
def deletion_counts(spark, d):
    return g.deletion_counts(triples_of(spark, d, "nation", "region", "customer"), _manifest(spark))


@query("sanitised_terms", duck(TRIPLE_SQL + f"select distinct s, p, o, case when p = '@partOf' then 'literal' else o_kind end as o_kind, case when p = '@partOf' then '{XSD}string' else o_dt end as o_dt from t", "nation", "region"))
def sanitised_terms(spark, d):
    return g.sanitise(triples_of(spark, d, "nation", "region"), [EX + "partOf"], EX + "duration").select("s", "p", "o", "o_kind", "o_dt")


@query("sanitised_counts", duck(TRIPLE_SQL + "select p as predicate, count(*) as changed from t where p = '@partOf' group by 1", "nation", "region"))
def sanitised_counts(spark, d):
    return g.sanitise_counts(triples_of(spark, d, "nation", "region"), [EX + "partOf"], EX + "duration")


@query("pre_post_variants", duck(TRIPLE_SQL + f"select 'pre' as variant, count(*) as n from t union all select 'post', (select count(*) from (select s, p, o from t union select '@extra', '{TYPE}', '@thing') x where s not in {_gone} and o not in {_gone})", "nation", "region"))
def pre_post_variants(spark, d):
    from loomspan.terms import iri, triples

    base = triples_of(spark, d, "nation", "region")
    pre, post = g.build_variants(base, base, triples(spark, [(EX + "extra", TYPE, iri(EX + "thing"))]), _manifest(spark), [EX + "nothing"], EX + "duration")
    count = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("variant"), "n")
    return count(pre, "pre").unionByName(count(post, "post"))


# all line items as a graph of parts and suppliers
EDGE_SQL = "e as (select distinct 'p' || l_partkey as src, 's' || l_suppkey as dst from lineitem)"
#: The smallest node reachable, by rounds in which every node takes the least of its neighbours' names: as many as the graph is wide.
ROUNDS = 14
LABEL_SQL = (
    f"{EDGE_SQL}, u as (select src as a, dst as b from e union select dst, src from e), c0 as (select distinct a as node, a as component from u), "
    + ", ".join(f"c{k} as (select node, least(min(component), min(other)) as component from (select x.node, x.component, y.component as other from c{k - 1} x join u on u.a = x.node join c{k - 1} y on y.node = u.b) group by node)" for k in range(1, ROUNDS + 1))
    + f", c as (select * from c{ROUNDS})"
)


def _edges(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()


@query("node_degrees", f"with {EDGE_SQL} select node, count(*) as degree from (select src as node from e union all select dst from e) x group by 1")
def node_degrees(spark, d):
    return g.degrees(_edges(spark, d))


@query("graph_components", f"with {LABEL_SQL} select node, component from c")
def graph_components(spark, d):
    return g.components(_edges(spark, d))


@query("component_sizes", f"with {LABEL_SQL} select component, count(*) as size from c group by 1")
def component_sizes(spark, d):
    return g.component_sizes(_edges(spark, d))


# suppliers who shared an order; no SQL, as its joins are too slow on whole tables: a test compares with brute force
@query("clustering_coefficients")
def clustering_coefficients(spark, d):
    # dealt by order once, for both sides of the join
    x = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey").distinct()
    return g.clustering(x.alias("a").join(x.alias("b"), "l_orderkey").where("a.l_suppkey < b.l_suppkey").select(F.col("a.l_suppkey").alias("src"), F.col("b.l_suppkey").alias("dst")).distinct())


# the graph has two kinds of nodes and edges between the kinds only, so it has no triangle
@query(
    "connectivity_summary",
    f"""with {LABEL_SQL}, d as (select node, count(*) as degree from (select src as node from e union all select dst from e) x group by 1), z as (select component, count(*) as size from c group by 1)
    select (select count(*) from d) as nodes, (select count(*) from e) as edges, (select round(avg(degree), 4) from d) as avg_degree, (select max(degree) from d) as max_degree,
    (select list(degree order by degree)[count(*) // 2 + 1] from d) as median_degree,
    round((select count(*) from e) / ((select count(*) from d) * ((select count(*) from d) - 1.0::double)), 6) as density, 0.0::double as clustering,
    (select count(*) from z) as components, round((select max(size) from z) / (select count(*) from d)::double, 4) as largest_share""",
)
def connectivity_summary(spark, d):
    return m.connectivity(_edges(spark, d))


@query("subclass_pairs", duck("""with recursive t as (@T), e as (select s, o from t where p = '@partOf'), n as (select s as x from e union select o from e),
    w as (select x as sub, x as super from n union select w.sub, e.o from w join e on w.super = e.s) select sub, super from w""", "nation", "region"))  # fmt: skip
def subclass_pairs(spark, d):
    return g.subclass_closure(triples_of(spark, d, "nation", "region"), EX + "partOf")


@query("reply_depth", """with recursive w as (select conv_id, turn, 1 as depth from conversations where turn = 0 union all select c.conv_id, c.turn, depth + 1 from w join conversations c on c.conv_id = w.conv_id and c.turn = w.turn + 1) select max(depth) as depth from w""")
def reply_depth(spark, d):
    c = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("src"), F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("dst"), "turn").where("turn > 0")
    return spark.createDataFrame([(g.max_depth(c),)], "depth int")


@query("individuals", duck(TRIPLE_SQL + f"select distinct s from t where p = '{TYPE}' and starts_with(s, '@') and s not in (select s from t where p = '{TYPE}' and o in ('@Region', '@World'))", "nation", "region"))
def individuals(spark, d):
    return g.individuals(triples_of(spark, d, "nation", "region"), EX, [EX + "Region", EX + "World"])


# completeness measures; some declared elements are not used

DECLARED = ["Order", "Customer", "Nation", "Unused", "placedBy", "status", "neverUsed", "locatedIn"]


@query("schema_usage", duck(TRIPLE_SQL + f", u as (select o as x from t where p = '{TYPE}' union select p from t), d as (select '@' || unnest({DECLARED!r}) as x) select (select count(*) from d) as declared, count(*) as used, round(count(*) / (select count(*) from d)::double, 4) as ratio from d where x in (select x from u)", "orders", "customer"))
def schema_usage(spark, d):
    declared = spark.createDataFrame([(EX + x,) for x in DECLARED], "element string")
    return m.schema_usage(triples_of(spark, d, "orders", "customer"), declared)


DOMAINS = [("quality", "Document"), ("toxic", "Document"), ("lang", "Document"), ("ghost", "Ghost")]
_dom = " union all ".join(f"select '{EX}{p}' as property, '{EX}{c}' as domain" for p, c in DOMAINS)
PROPERTY_SQL = TRIPLE_SQL + f", d as ({_dom}), i as (select property, s from d join t on t.p = '{TYPE}' and t.o = d.domain), v as (select distinct s, p from t), r as (select d.property, count(i.s) as instances, count(v.s) as valued from d left join i on d.property = i.property left join v on v.s = i.s and v.p = i.property group by 1), q as (select property, instances, valued, case when instances > 0 then round(valued / instances::double, 4) end as ratio from r) "


def _domains(spark):
    return spark.createDataFrame([(EX + p, EX + c) for p, c in DOMAINS], "property string, domain string")


@query("property_completeness", duck(PROPERTY_SQL + "select * from q", "documents", "labels"))
def property_completeness(spark, d):
    return m.property_completeness(triples_of(spark, d, "documents", "labels"), _domains(spark))


@query("property_mean", duck(PROPERTY_SQL + "select round(avg(ratio), 4) as mean from q", "documents", "labels"))
def property_mean(spark, d):
    return m.mean_ratio(m.property_completeness(triples_of(spark, d, "documents", "labels"), _domains(spark)))


EXPECTED = [("Nation", 27), ("Region", 5), ("Ghost", 8)]


@query("population_ratios", duck(TRIPLE_SQL + ", e as (select * from (values ('@Nation', 27), ('@Region', 5), ('@Ghost', 8)) v(class, expected)), n as (select o, count(distinct s) as k from t where p = '" + TYPE + "' group by 1) select class, expected, coalesce(k, 0) as found, round(coalesce(k, 0) / expected::double, 4) as ratio from e left join n on n.o = class", "nation", "region"))
def population_ratios(spark, d):
    expected = spark.createDataFrame([(EX + c, n) for c, n in EXPECTED], "class string, expected int")
    return m.population(triples_of(spark, d, "nation", "region"), expected)


@query("interlinking", duck(TRIPLE_SQL + f", i as (select distinct s from t where p = '{TYPE}'), l as (select s as x from t where o_kind = 'iri' and p <> '{TYPE}' union select o from t where o_kind = 'iri' and p <> '{TYPE}') select count(*) as individuals, count(*) filter (where s in (select x from l)) as linked, round(count(*) filter (where s in (select x from l)) / count(*)::double, 4) as ratio from i", "nation", "region", "part"))
def interlinking(spark, d):
    t = triples_of(spark, d, "nation", "region", "part")
    return m.interlinking(t, t.where(F.col("p") == TYPE).select("s"))


@query("top_classes", duck(TRIPLE_SQL + f"select o as class, count(*) as triples from t where p = '{TYPE}' group by 1 order by 2 desc, 1 limit 3", "nation", "region", "part", "supplier"))
def top_classes(spark, d):
    return m.top_classes(triples_of(spark, d, "nation", "region", "part", "supplier"), 3)


@query("tagged_class_counts", duck(TRIPLE_SQL + ", g as (select * from (values ('@Nation', '+R', '+I', '-D'), ('@Ghost', '~R', '+I', '+D')) v(class, rigidity, identity, dependence)) select g.*, (select count(distinct s) from t where p = '" + TYPE + "' and o = g.class) as instances from g", "nation"))
def tagged_class_counts(spark, d):
    tags = spark.createDataFrame([(EX + "Nation", "+R", "+I", "-D"), (EX + "Ghost", "~R", "+I", "+D")], "class string, rigidity string, identity string, dependence string")
    return m.tagged_counts(triples_of(spark, d, "nation"), tags)


@query(
    "extraction_scores",
    r"""with c as (select 'email' as type, regexp_matches(text, '@mail') as p, toxic = 1 as y from documents d join labels l on d.doc_id = l.doc_id
      union all select 'symbols', regexp_matches(text, '###|\$\$\$|%%%'), quality = 0 from documents d join labels l on d.doc_id = l.doc_id),
    k as (select type, count(*) filter (where p and y) as tp, count(*) filter (where p and not y) as fp, count(*) filter (where not p and y) as fn from c group by 1),
    b as (select * from k union all select 'overall', sum(tp)::bigint, sum(fp)::bigint, sum(fn)::bigint from k)
    select type, tp, fp, fn, case when tp + fp > 0 then round(tp / (tp + fp)::double, 3) end as precision, case when tp + fn > 0 then round(tp / (tp + fn)::double, 3) end as recall, case when 2 * tp + fp + fn > 0 then round(2 * tp / (2 * tp + fp + fn)::double, 3) end as f1 from b""",
)
def extraction_scores(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    one = lambda n, p, y: rows.select(F.lit(n).alias("type"), p.alias("p"), y.alias("y"))
    c = one("email", F.col("text").rlike("@mail"), F.col("toxic") == 1).unionByName(one("symbols", F.col("text").rlike(r"###|\$\$\$|%%%"), F.col("quality") == 0))
    p, y = F.col("p"), F.col("y")
    return m.precision_recall(c.select("type", (p & y).cast("long").alias("tp"), (p & ~y).cast("long").alias("fp"), (~p & y).cast("long").alias("fn")))


@query("metric_deltas", "with a as (select o_orderstatus as metric, round(avg(cast(o_totalprice as decimal(18,2)))::double, 2) as pre from orders where o_orderpriority similar to '[12]-.*' group by 1), b as (select o_orderstatus as metric, round(avg(cast(o_totalprice as decimal(18,2)))::double, 2) as post from orders where not coalesce(o_orderpriority similar to '[12]-.*', false) group by 1) select coalesce(a.metric, b.metric) as metric, pre, post, round(post - pre, 4) as delta from a full join b on a.metric = b.metric")
def metric_deltas(spark, d):
    """Mean prices of each status, of the two highest priorities (pre) and of all other orders (post): every order counts on one side."""
    o = table(spark, d, "orders")
    mean = lambda df: df.groupBy(F.col("o_orderstatus").alias("metric")).agg(F.round(F.avg(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("value"))
    first = F.coalesce(F.col("o_orderpriority").rlike("^[12]-"), F.lit(False))
    return m.deltas(mean(o.where(first)), mean(o.where(~first)))


@query("worst_ratios", duck(PROPERTY_SQL + "select * from q where ratio is not null order by ratio, property limit 2", "documents", "labels"))
def worst_ratios(spark, d):
    return m.worst(m.property_completeness(triples_of(spark, d, "documents", "labels"), _domains(spark)), 2)


@query("seeded_sample")
def seeded_sample(spark, d):
    return m.seeded_sample(triples_of(spark, d, "nation", "region"))
