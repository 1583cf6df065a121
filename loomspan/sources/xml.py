"""Metadata XML to records, with Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_URI = "struct<VALUE:string,TYPE:string,IDENTIFIER:string>"
_SAME = f"array<struct<URI:{_URI}>>"
_DATE = "array<struct<VALUE:string,ANNOTATION:array<struct<`COMMENT_ON_LEGAL_RELATION`:string,ARTICLE:string,TEXT:string>>>>"
_LINK = f"array<struct<URI:{_URI},SAMEAS:{_SAME},ANNOTATION:array<struct<ARTICLE:string,TEXT:string,LOCATION:string>>>>"
SCHEMA = f"""SAMEAS {_SAME}, URI {_URI}, RESOURCE_LEGAL_ELI struct<VALUE:string>,
`RESOURCE_LEGAL_DATE_DEADLINE` {_DATE}, `RESOURCE_LEGAL_DATE_ENTRY-INTO-FORCE` {_DATE},
CREATED_BY array<struct<URI:{_URI},PREFLABEL:string,IDENTIFIER:string>>,
WORK_CITES_WORK {_LINK}, RESOURCE_LEGAL_AMENDS_RESOURCE_LEGAL {_LINK}"""
ARTICLE = r"(?:ART|AR)\}?\s*(\d+)(?:\.\d+)?"


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """One row for each WORK element."""
    return spark.read.format("xml").option("rowTag", "WORK").schema(SCHEMA).load(path)


def identifier(same: Column, kind: str) -> Column:
    """The last identifier of a kind among SAMEAS elements."""
    hits = F.filter(same, lambda s: F.lower(s["URI"]["TYPE"]) == kind)
    return F.try_element_at(F.transform(hits, lambda s: F.coalesce(s["URI"]["IDENTIFIER"], s["URI"]["VALUE"])), F.lit(-1))


def article_numbers(x: Column) -> Column:
    """Articles that a text names, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(ARTICLE), 1))


def _notes(a: Column) -> Column:
    return F.concat_ws(" ", F.flatten(F.transform(F.coalesce(a, F.array()), lambda n: F.array(n["ARTICLE"], n["TEXT"]))))


def _dates(c: str) -> Column:
    item = lambda d: F.struct(d["VALUE"].alias("date"), F.nullif(article_numbers(_notes(d["ANNOTATION"])), F.array().cast("array<string>")).alias("article_references"))
    return F.transform(F.col(f"`{c}`"), item)


def _links(c: str) -> Column:
    item = lambda w: F.struct(w["URI"]["VALUE"].alias("cellar_uri"), identifier(w["SAMEAS"], "celex").alias("celex"), identifier(w["SAMEAS"], "eli").alias("eli"), article_numbers(_notes(w["ANNOTATION"])).alias("article_references"), F.try_element_at(F.transform(w["ANNOTATION"], lambda n: n["LOCATION"]), F.lit(1)).alias("modified_location"))
    return first_by_celex(F.transform(F.col(c), item))


def first_by_celex(links: Column) -> Column:
    """Of links with one celex the first; those without are kept if they have an address."""
    ids = F.transform(links, lambda x: x["celex"])
    return F.filter(links, lambda x, i: F.when(x["celex"].isNull(), x["cellar_uri"].isNotNull()).otherwise(F.array_position(ids, x["celex"]) == i + 1))


def metadata(works: DataFrame) -> DataFrame:
    """Metadata records, shaped as json_io.METADATA, of WORK rows."""
    maker = lambda c: F.struct(c["PREFLABEL"].alias("label"), F.coalesce(c["IDENTIFIER"], c["URI"]["IDENTIFIER"]).alias("identifier"), c["URI"]["VALUE"].alias("uri"))
    made = F.filter(F.transform("CREATED_BY", maker), lambda c: c["label"].isNotNull() | c["identifier"].isNotNull() | c["uri"].isNotNull())
    reg = F.struct(identifier(F.col("SAMEAS"), "celex").alias("celex"), identifier(F.col("SAMEAS"), "eli").alias("eli"), identifier(F.col("SAMEAS"), "oj").alias("oj"), F.col("URI.VALUE").alias("cellar_uri"), F.col("RESOURCE_LEGAL_ELI.VALUE").alias("eli_canonical"))
    return works.select(F.lit("xml").alias("source"), F.lit(None).cast("string").alias("source_file"), reg.alias("regulation"), _dates("RESOURCE_LEGAL_DATE_DEADLINE").alias("deadlines"), _dates("RESOURCE_LEGAL_DATE_ENTRY-INTO-FORCE").alias("entry_into_force"), made.alias("created_by"), _links("WORK_CITES_WORK").alias("cites"), _links("RESOURCE_LEGAL_AMENDS_RESOURCE_LEGAL").alias("amends"))
