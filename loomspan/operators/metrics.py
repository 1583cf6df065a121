"""Completeness, connectivity and evaluation measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.graphs import clustering, component_sizes, degrees
from loomspan.terms import OWL, RDFS, TYPE

#: Predicates that don't link individuals.
NOT_LINKS = [TYPE, RDFS + "label", RDFS + "comment", RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range", OWL + "inverseOf", OWL + "disjointWith", OWL + "equivalentClass"]


def used_elements(g: DataFrame) -> DataFrame:
    """(element): classes with an instance and predicates with a triple."""
    classes = g.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri")).select(F.col("o").alias("element"))
    return classes.unionByName(g.select(F.col("p").alias("element"))).distinct()


def schema_usage(g: DataFrame, declared: DataFrame) -> DataFrame:
    """(declared, used, ratio): CM1, the share of declared elements that the graph uses."""
    d = declared.select("element").distinct()
    hit = d.join(used_elements(g), "element", "left_semi")
    total, used = d.agg(F.count("*").alias("declared")), hit.agg(F.count("*").alias("used"))
    return total.crossJoin(used).withColumn("ratio", F.when(F.col("declared") > 0, F.round(F.col("used").cast("double") / F.col("declared"), 4)))


def property_completeness(g: DataFrame, domains: DataFrame) -> DataFrame:
    """(property, instances, valued, ratio): CM2; domains has property and domain. Direct types only; a domain without instances has no ratio."""
    inst = g.where(F.col("p") == TYPE).select("s", F.col("o").alias("domain")).distinct()
    members = domains.select("property", "domain").distinct().join(inst, "domain").select("property", "s").distinct()
    has = g.select("s", F.col("p").alias("property")).distinct().withColumn("v", F.lit(1))
    per = members.join(has, ["s", "property"], "left").groupBy("property").agg(F.count("*").alias("instances"), F.count("v").alias("valued"))
    out = domains.select("property").distinct().join(per, "property", "left")
    out = out.select("property", F.coalesce("instances", F.lit(0)).alias("instances"), F.coalesce("valued", F.lit(0)).alias("valued"))
    return out.withColumn("ratio", F.when(F.col("instances") > 0, F.round(F.col("valued").cast("double") / F.col("instances"), 4)))


def mean_ratio(ratios: DataFrame) -> DataFrame:
    """The mean of ratios that are already rounded."""
    return ratios.agg(F.round(F.avg("ratio"), 4).alias("mean"))


def worst(ratios: DataFrame, n: int = 5, by: str = "property") -> DataFrame:
    """The n lowest ratios, then by name; those without a ratio are left out."""
    return ratios.where("ratio is not null").orderBy("ratio", by).limit(n)


def rescoped(declared: DataFrame, g: DataFrame, kinds: list[str]) -> DataFrame:
    """Declared elements (element) that g itself still declares under one of the kinds; all of them if it declares nothing."""
    still = g.where((F.col("p") == TYPE) & F.col("o").isin(kinds)).select(F.col("s").alias("element")).distinct()
    some = still.limit(1).select(F.lit(True).alias("_some"))
    marked = declared.join(still.withColumn("_kept", F.lit(True)), "element", "left").join(F.broadcast(some), F.lit(True), "left")
    return marked.where("_kept or _some is null").select(declared.columns)


def population(g: DataFrame, expected: DataFrame) -> DataFrame:
    """(class, expected, found, ratio): CM3; a class that is missing has 0."""
    n = g.where(F.col("p") == TYPE).groupBy(F.col("o").alias("class")).agg(F.countDistinct("s").alias("found"))
    out = expected.join(n, "class", "left").select("class", "expected", F.coalesce("found", F.lit(0)).alias("found"))
    return out.withColumn("ratio", F.round(F.col("found").cast("double") / F.col("expected"), 4))


def interlinking(g: DataFrame, members: DataFrame, without: list[str] | None = None) -> DataFrame:
    """(individuals, linked, ratio): CM4, the share of individuals s with an edge to or from a node."""
    links = g.where((F.col("o_kind") == "iri") & ~F.col("p").isin(without if without is not None else NOT_LINKS))
    touched = links.select("s").unionByName(links.select(F.col("o").alias("s"))).distinct()
    m = members.select("s").distinct()
    total, hit = m.agg(F.count("*").alias("individuals")), m.join(touched, "s", "left_semi").agg(F.count("*").alias("linked"))
    return total.crossJoin(hit).withColumn("ratio", F.when(F.col("individuals") > 0, F.round(F.col("linked").cast("double") / F.col("individuals"), 4)))


def top_classes(g: DataFrame, n: int = 15) -> DataFrame:
    """(class, triples): the classes with most type triples, then by name."""
    return g.where(F.col("p") == TYPE).groupBy(F.col("o").alias("class")).agg(F.count("*").alias("triples")).orderBy(F.desc("triples"), "class").limit(n)


def connectivity(e: DataFrame) -> DataFrame:
    """One row: nodes, edges, average, largest and upper-median degree, density, mean clustering, components, largest share.

    The median is the element at half the number of nodes in ascending order,
    found by running counts over the distinct degrees.
    """
    from pyspark.sql import Window

    from loomspan.session import written

    e = written(e.distinct(), "connectivity-edges")  # five measures read it
    deg = written(degrees(e), "connectivity-degrees")
    hist = deg.groupBy("degree").agg(F.count("*").alias("n"))
    run = hist.withColumn("upto", F.sum("n").over(Window.orderBy("degree")))  # a row for each distinct degree
    total = deg.agg(F.count("*").alias("nodes"), F.round(F.avg("degree"), 4).alias("avg_degree"), F.max("degree").alias("max_degree"))
    median = run.crossJoin(total.select("nodes")).where("upto > floor(nodes / 2)").agg(F.min("degree").alias("median_degree"))
    count = e.agg(F.count("*").alias("edges"))
    mean = clustering(e).agg(F.avg("coefficient").alias("c"), F.count("*").alias("k"))
    size = component_sizes(e).agg(F.count("*").alias("components"), F.max("size").alias("largest"))
    out = total.crossJoin(count).crossJoin(median).crossJoin(mean).crossJoin(size)
    density = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1.0)))
    return out.select("nodes", "edges", "avg_degree", "max_degree", "median_degree", F.round(density, 6).alias("density"), F.round(F.col("c") * F.col("k") / F.col("nodes"), 4).alias("clustering"), "components", F.round(F.col("largest") / F.col("nodes"), 4).alias("largest_share"))


def precision_recall(counts: DataFrame, by: str = "type") -> DataFrame:
    """(type, tp, fp, fn, precision, recall, f1) and a row ``overall``; a measure without a denominator is null."""
    per = counts.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    both = per.unionByName(per.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumn(by, F.lit("overall")))
    ratio = lambda a, b: F.when(b > 0, F.round(a.cast("double") / b, 3))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return both.select(by, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def deltas(pre: DataFrame, post: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """(metric, pre, post, delta), the delta rounded and null if either side is."""
    a, b = pre.select(key, F.col(value).alias("pre")), post.select(key, F.col(value).alias("post"))
    return a.join(b, key, "full").withColumn("delta", F.round(F.col("post") - F.col("pre"), 4))


def recall_of_keywords(answers: DataFrame) -> DataFrame:
    """answers (id, condition, answer, keywords) with the share of keywords in the answer and references out of range."""
    text = F.lower(F.coalesce("answer", F.lit("")))
    hit = F.size(F.filter("keywords", lambda k: text.contains(F.lower(k))))
    total = F.size("keywords")
    articles = F.filter(F.regexp_extract_all(text, F.lit(r"article (\d+)"), 1), lambda x: ~x.cast("int").between(1, 113))
    annexes = F.filter(F.regexp_extract_all(text, F.lit(r"annex (\d+)"), 1), lambda x: x.cast("int") > 13)
    return answers.withColumn("recall", F.when(total > 0, F.round(hit.cast("double") / total, 3)).otherwise(0.0)).withColumn("out_of_range", F.size(articles) + F.size(annexes))


def mean_recall(scored: DataFrame) -> DataFrame:
    return scored.groupBy("condition").agg(F.round(F.avg("recall"), 3).alias("recall"), F.sum("out_of_range").alias("out_of_range"))


def seeded_sample(g: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """n triples by a seeded hash; the same at any partitioning."""
    return g.orderBy(F.xxhash64("s", "p", "o", F.lit(seed)), "s", "p", "o").limit(n)


def tagged_counts(g: DataFrame, tags: DataFrame) -> DataFrame:
    """OntoClean-style tags of classes with their instance counts, 0 where there are none."""
    n = g.where(F.col("p") == TYPE).groupBy(F.col("o").alias("class")).agg(F.countDistinct("s").alias("instances"))
    return tags.join(n, "class", "left").withColumn("instances", F.coalesce("instances", F.lit(0)))
