"""JSON in and out, optional inputs, and JSON records as triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.operators.graphs import merge
from loomspan.terms import LABEL, OWL, TYPE, XSD, construct, creator_name, date_name, legislation_name, term_struct

AUTHORITY = "https://w3id.org/dpv#Authority"
_REF = "array<struct<cellar_uri:string,celex:string,eli:string,article_references:array<string>,modified_location:string>>"
_DATE = "array<struct<date:string,article_references:array<string>>>"
METADATA = f"""source string, source_file string, regulation struct<celex:string,eli:string,oj:string,cellar_uri:string,eli_canonical:string>,
deadlines {_DATE}, entry_into_force {_DATE}, created_by array<struct<label:string,identifier:string,uri:string>>, cites {_REF}, amends {_REF}"""


def existing(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Those of the paths that are there, in any store that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in [paths] if isinstance(paths, str) else paths:
        h = jvm.org.apache.hadoop.fs.Path(p)
        if h.getFileSystem(conf).exists(h):
            out.append(p)
    return out


def read_json(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """Whole JSON files under a schema; a missing file is an empty table if that is allowed."""
    if missing_ok and not existing(spark, path):
        return spark.createDataFrame([], T._parse_datatype_string(schema))
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def nested_report(metrics: DataFrame, section: str = "section", key: str = "metric", value: str = "value") -> DataFrame:
    """A long table of metrics as one JSON text."""
    per = metrics.groupBy(section).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).cast("string").alias("v"))))).alias("m"))
    part = F.concat(F.lit('"'), F.col(section), F.lit('":'), F.to_json("m"))
    return per.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(part)), ","), F.lit("}")).alias("json"))


def slots(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One row for each element of an array column, with its place."""
    return df.select(*keys, F.posexplode(column).alias("slot", "item"))


def metadata_triples(meta: DataFrame, ns: str, root: str, title: str | None = None) -> DataFrame:
    """The graph of metadata records about one law: one branch for each array instead of their product.

    A record without celex or cellar_uri gives nothing. Dates need a date,
    creators a label, laws a celex; what is missing beside these leaves its
    triple out. Two deadlines of one date share a node and their references. An
    article's number is what digits its reference has.
    """
    ok = meta.where("regulation.celex is not null and regulation.cellar_uri is not null")
    law = F.lit(ns + root)
    out = [
        construct(
            ok, term_struct(law, TYPE, F.lit(OWL + "NamedIndividual"), "iri"), term_struct(law, TYPE, F.lit(ns + "AIActRegulation"), "iri"), term_struct(law, LABEL, F.lit(title or root), lang="en"),
            term_struct(law, ns + "hasCELEXNumber", F.col("regulation.celex")), term_struct(law, ns + "hasCellarURI", F.col("regulation.cellar_uri")),
        )
    ]
    for field, kind, cls, label, has, when in (
        ("deadlines", "ComplianceDeadline", "ComplianceDeadlineProvision", "Compliance deadline ", "hasProvisionDate", "hasComplianceProvision"),
        ("entry_into_force", "EntryIntoForce", "EntryIntoForceDate", "Entry into force ", "hasEffectiveDate", "hasEntryIntoForceProvision"),
    ):
        rows = ok.select(F.explode(field).alias("i")).select("i.date", F.explode_outer("i.article_references").alias("ref")).where("date is not null")
        s = F.concat(F.lit(ns), date_name(kind, F.col("date")))
        article = F.concat(F.lit(ns + "Article_"), F.regexp_replace("ref", "[^0-9]", ""))
        out.append(construct(rows, term_struct(s, TYPE, F.lit(ns + cls), "iri"), term_struct(s, LABEL, F.concat(F.lit(label), "date")), term_struct(s, ns + has, F.col("date"), dt=XSD + "date"), term_struct(law, ns + when, s, "iri"), term_struct(s, ns + "hasArticleReference", article, "iri")))
    makers = ok.select(F.explode("created_by").alias("i")).select("i.*").where("label is not null")
    s = F.concat(F.lit(ns), creator_name(F.col("identifier"), F.col("label")))
    out.append(construct(makers, term_struct(s, TYPE, F.lit(AUTHORITY), "iri"), term_struct(s, LABEL, F.col("label")), term_struct(law, ns + "createdBy", s, "iri")))
    for field in ("amends", "cites"):
        rows = ok.select(F.explode(field).alias("i")).select("i.*").where("celex is not null")
        s = F.concat(F.lit(ns), legislation_name(F.col("celex")))
        where = F.col("modified_location") if field == "amends" else F.lit(None).cast("string")
        out.append(construct(rows, term_struct(s, TYPE, F.lit(ns + "EULegislation"), "iri"), term_struct(s, LABEL, F.concat(F.lit("EU Legislation "), "celex")), term_struct(s, ns + "hasCELEXNumber", F.col("celex")), term_struct(s, ns + "hasModifiedLocation", where), term_struct(law, ns + field, s, "iri")))
    return merge(*out)
