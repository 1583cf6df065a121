"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import written


#: Edges from which on a part of them is connected first.
LARGE = 1_000_000


def _flat(e: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: no u has two of them or is a v."""
    ends = e.select(F.inline(F.array(F.struct("u", F.lit(1).alias("n")), F.struct(F.col("v").alias("u"), F.lit(0).alias("n")))))
    # a node of stars has either one row that counts or none
    per = ends.groupBy("u").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    return per.where("n > 1 or (n = 1 and least = 0)").isEmpty()


def _stars(e: DataFrame, max_rounds: int) -> DataFrame:
    """(node, component) of distinct edges with u > v; every round keeps that order."""
    for _ in range(max_rounds):
        # a node's smaller neighbours are those of its edges as u, so its least is found without turning the edges round
        least = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = e.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc-round")
        if _flat(e):
            break
    else:
        raise RuntimeError("connected_components did not converge")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, large: int = LARGE) -> DataFrame:
    """(node, component): component is the smallest node reachable.

    Alternating large-star and small-star steps over the distinct edges. Every
    step hangs a node's neighbours on its smallest neighbour, so stars flatten
    in about log rounds; each round is written to the shared folder, which cuts
    the lineage. Of more than ``large`` edges each node's first and last are
    connected so, if these are at most half of all; then all edges are read once
    more, and those between the components found are connected. A hub's
    neighbours meet only as rows of a join or of a partial minimum, never as
    one collected group. Nulls and self-loops are dropped; an empty table gives
    an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "cc-edges")
    many = e.count()
    if many <= large:
        return _stars(e, max_rounds)
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    ends = both.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select("u", F.explode(F.array("lo", "hi")).alias("v"))
    some = written(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-some")
    if some.count() * 2 > many:
        return _stars(e, max_rounds)
    part = written(_stars(some, max_rounds), "cc-part")
    side = lambda x: part.select(F.col("node").alias(x), F.col("component").alias("c" + x))
    across = e.join(side("u"), "u").join(side("v"), "v").where("cu <> cv").select(F.greatest("cu", "cv").alias("u"), F.least("cu", "cv").alias("v")).distinct()
    across = written(across, "cc-across")
    if across.isEmpty():
        return part
    rest = _stars(across, max_rounds).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return part.join(rest, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))


def with_edges(part: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of what part (node, component) and the edges (a, b) connect together.

    Only the edges are connected, each end as the component that it is in or as
    itself, so the work follows them and not all that part was made of.
    """
    side = lambda x: part.select(F.col("node").alias(x), F.col("component").alias("c" + x))
    across = edges.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    rest = connected_components(across)
    old = part.join(rest.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return old.unionByName(rest.join(part, "node", "left_anti"))
