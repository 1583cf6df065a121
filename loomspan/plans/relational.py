"""The test tables as a graph: one set of triples for each table, and the same as DuckDB text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.terms import COLUMNS, LABEL, TYPE, XSD, construct, term_struct

EX = "http://example.org/kg#"
DEC = XSD + "decimal"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, *keys: str) -> Column:
    return F.concat(F.lit(f"{EX}{kind}/"), F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


#: table: (subject kind, keys, class, [(predicate, target)]); a target is (kind, key) for a node, else (column, datatype).
MAPPING = {
    "region": ("region", ["r_regionkey"], "Region", [(LABEL, ("r_name", None))]),
    "nation": ("nation", ["n_nationkey"], "Nation", [(LABEL, ("n_name", None)), (EX + "partOf", ("region", "n_regionkey", 0))]),
    "supplier": ("supplier", ["s_suppkey"], "Supplier", [(LABEL, ("s_name", None)), (EX + "locatedIn", ("nation", "s_nationkey", 0)), (EX + "balance", ("s_acctbal", DEC))]),
    "customer": ("customer", ["c_custkey"], "Customer", [(LABEL, ("c_name", None)), (EX + "locatedIn", ("nation", "c_nationkey", 0)), (EX + "segment", ("c_mktsegment", None))]),
    "part": ("part", ["p_partkey"], "Part", [(LABEL, ("p_name", None)), (EX + "brand", ("p_brand", None)), (EX + "kind", ("p_type", None)), (EX + "size", ("p_size", XSD + "integer")), (EX + "price", ("p_retailprice", DEC))]),
    "orders": ("order", ["o_orderkey"], "Order", [(EX + "placedBy", ("customer", "o_custkey", 0)), (EX + "status", ("o_orderstatus", None)), (EX + "priority", ("o_orderpriority", None)), (EX + "total", ("o_totalprice", DEC)), (EX + "orderDate", ("o_orderdate", XSD + "date"))]),
    "lineitem": ("line", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "Line", [(EX + "ofOrder", ("order", "l_orderkey", 0)), (EX + "ofPart", ("part", "l_partkey", 0)), (EX + "suppliedBy", ("supplier", "l_suppkey", 0)), (EX + "discount", ("l_discount", DEC)), (EX + "quantity", ("l_quantity", DEC))]),
    "documents": ("doc", ["doc_id"], "Document", [(EX + "lang", ("lang", None)), (EX + "source", ("source", None))]),
    "labels": ("doc", ["doc_id"], None, [(EX + "quality", ("quality", XSD + "integer")), (EX + "toxic", ("toxic", XSD + "integer"))]),
}


#: Tables whose keys are unique, so that no branch repeats a triple.
UNIQUE = {"region", "nation", "supplier", "customer", "part", "orders", "documents"}


def triples_of(spark: SparkSession, sf_dir: str, *names: str, repeats: bool = False) -> DataFrame:
    """Triples of the named tables. Each predicate is a branch that reads only its columns and names the predicate as a constant, so that a pattern's filter leaves no other branch.

    With repeats a triple may come more than once, and a table is one branch that is read once: for a store, which takes all and makes them distinct by ids.
    """
    parts = []
    for name in names:
        kind, keys, cls, props = MAPPING[name]
        s = node(kind, *keys)
        rows = table(spark, sf_dir, name)
        made = [term_struct(s, TYPE, F.lit(EX + cls), "iri")] if cls else []
        for p, target in props:
            if len(target) == 3:
                made.append(term_struct(s, p, node(target[0], target[1]), "iri"))
            else:
                col, dt = target
                value = money(col) if dt == DEC else F.date_format(col, "yyyy-MM-dd") if dt == XSD + "date" else F.col(col).cast("string")
                made.append(term_struct(s, p, value, "literal", dt))
        if repeats:
            parts.append(construct(rows, *made, repeats=True))
            continue
        for t in made:
            branch = rows.select(t.alias("t")).select("t.*").where("s is not null and o is not null").select(*COLUMNS)
            parts.append(branch if name in UNIQUE else branch.distinct())
    if "region" in names:
        world = spark.range(1).select(F.lit(EX + "world").alias("w"))
        parts.append(construct(world, term_struct(F.col("w"), TYPE, F.lit(EX + "World"), "iri")))
        up = table(spark, sf_dir, "region")
        parts.append(construct(up, term_struct(node("region", "r_regionkey"), EX + "partOf", F.lit(EX + "world"), "iri")))
    return reduce(DataFrame.unionByName, parts)


def _duck(name: str) -> list[str]:
    kind, keys, cls, props = MAPPING[name]
    s = f"'{EX}{kind}/' || " + " || '-' || ".join(f"cast({k} as varchar)" for k in keys)
    rows = [(f"'{TYPE}'", f"'{EX}{cls}'", "'iri'", "null")] if cls else []
    for p, target in props:
        if len(target) == 3:
            rows.append((f"'{p}'", f"'{EX}{target[0]}/' || cast({target[1]} as varchar)", "'iri'", "null"))
        else:
            col, dt = target
            v = f"cast(cast({col} as decimal(18,2)) as varchar)" if dt == DEC else f"strftime({col}, '%Y-%m-%d')" if dt == XSD + "date" else f"cast({col} as varchar)"
            rows.append((f"'{p}'", v, "'literal'", f"'{dt}'" if dt else "null"))
    return [f"select {s} as s, {p} as p, {o} as o, {k} as o_kind, {dt} as o_dt from {name} where ({o}) is not null" for p, o, k, dt in rows]


def duck_triples(*names: str) -> str:
    """The same triples as the body of a DuckDB CTE: columns s, p, o, o_kind, o_dt."""
    parts = [x for n in names for x in _duck(n)]
    if "region" in names:
        parts.append(f"select '{EX}world' as s, '{TYPE}' as p, '{EX}World' as o, 'iri' as o_kind, null as o_dt")
        parts.append(f"select '{EX}region/' || cast(r_regionkey as varchar), '{EX}partOf', '{EX}world', 'iri', null from region")
    return "select distinct * from (" + " union all ".join(parts) + ")"
