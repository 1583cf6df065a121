"""Terms and triples, and the rules by which identifiers are made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE, LABEL, SUBCLASS = RDF + "type", RDFS + "label", RDFS + "subClassOf"

#: The seven columns are a triple's identity.
TRIPLE = T.StructType([T.StructField(c, T.StringType(), c in ("o_dt", "o_lang")) for c in ("s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")])
COLUMNS = TRIPLE.names


def triples(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A triple table from (s, p, o) with o a term of iri(), bnode() or literal(); a string subject that starts with _: is a blank node."""
    out = [(s, "bnode" if s.startswith("_:") else "iri", p, *o) for s, p, o in rows]
    return spark.createDataFrame(out, TRIPLE)


def iri(x: str) -> tuple:
    return (x, "iri", None, None)


def bnode(x: str) -> tuple:
    return (x, "bnode", None, None)


def literal(x: str, dt: str | None = None, lang: str | None = None) -> tuple:
    return (x, "literal", dt, lang)


def _o(o: Column, kind: str, dt: str | None, lang: str | None) -> list[Column]:
    return [o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"), F.lit(lang).cast("string").alias("o_lang")]


def term_struct(s: Column, p: str | Column, o: Column, kind: str = "literal", dt: str | None = None, lang: str | None = None) -> Column:
    """One triple as a struct column, to be collected in an array and exploded."""
    p = F.lit(p) if isinstance(p, str) else p
    return F.struct(s.alias("s"), F.lit("iri").alias("s_kind"), p.alias("p"), *_o(o, kind, dt, lang))


def construct(df: DataFrame, *templates: Column, repeats: bool = False) -> DataFrame:
    """Triples of a template for every row; those with an unbound part are left out, and repeats merge, unless they may stay for a later merge."""
    each = df.select(F.explode(F.array(*templates)).alias("t")).select("t.*")
    made = each.where("s is not null and p is not null and o is not null").select(*COLUMNS)
    return made if repeats else made.distinct()


def normalise_plain(g: DataFrame) -> DataFrame:
    """A plain literal and one typed as string become one term."""
    return g.withColumn("o_dt", F.when(F.col("o_dt") == XSD + "string", None).otherwise(F.col("o_dt"))).distinct()


def local_name(x: Column) -> Column:
    """What follows the last #, or else the last slash."""
    return F.when(x.contains("#"), F.element_at(F.split(x, "#"), -1)).otherwise(F.element_at(F.split(x, "/"), -1))


def _stripped(x: Column, mark: str = "_") -> Column:
    return F.regexp_replace(x, f"^{mark}+|{mark}+$", "")


def slug(x: Column) -> Column:
    return _stripped(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"))


def annex_slug(ref: Column) -> Column:
    """"Annex IV(1)(a)" becomes anniv_1_a; nothing becomes unknown."""
    short = F.regexp_replace(F.lower(ref), r"^annex\s+", "ann")
    out = _stripped(F.regexp_replace(short, "[^a-z0-9]+", "_"))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("unknown"))


def safe_suffix(x: Column) -> Column:
    """Other characters become one underscore each; nothing becomes instance."""
    return F.coalesce(F.nullif(F.regexp_replace(x, "[^A-Za-z0-9_]", "_"), F.lit("")), F.lit("instance"))


def tagged_suffix(x: Column, tag: Column) -> Column:
    """The slug, with the source tag behind it unless it is in it somewhere."""
    s = slug(x)
    return F.when(s.contains(tag), s).otherwise(F.concat(s, F.lit("_"), tag))


def paragraph_name(ref: Column) -> Column:
    return F.concat(F.lit("Paragraph_"), _stripped(F.regexp_replace(ref, "[^A-Za-z0-9]+", "_")))


def celex(year: Column, number: Column, sector: str = "R") -> Column:
    """3, the year, R or L, and the number in four digits or more."""
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return F.concat(F.lit("3"), year, F.lit(sector), padded)


def legislation_name(celex_id: Column) -> Column:
    return F.concat(F.lit("Legislation_"), F.translate(celex_id, "/()", "___"))


def date_name(prefix: str, date: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.replace(date, F.lit("-"), F.lit("")))


def encode_for_uri(x: Column) -> Column:
    out = F.url_encode(x)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def creator_name(identifier: Column, label: Column) -> Column:
    return F.concat(F.lit("Creator_"), encode_for_uri(F.coalesce(identifier, F.replace(label, F.lit(" "), F.lit("_")))))


#: Annex numerals.
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII")


def roman_number(x: Column) -> Column:
    """Annex numeral to number; null beyond XIII."""
    return F.nullif(F.array_position(F.array(*[F.lit(r) for r in ROMAN]), F.upper(x)), F.lit(0)).cast("int")


def duration_parts(x: Column) -> Column:
    """struct<months, seconds> of an ISO duration such as P15D, PT24H or P12M; null if it is none."""
    n = lambda unit, part: F.coalesce(F.nullif(F.regexp_extract(part, rf"(\d+){unit}", 1), F.lit("")).cast("long"), F.lit(0))
    date, time = F.substring_index(x, "T", 1), F.when(x.contains("T"), F.substring_index(x, "T", -1)).otherwise("")
    months = (12 * n("Y", date) + n("M", date)).cast("int")
    seconds = 86400 * (7 * n("W", date) + n("D", date)) + 3600 * n("H", time) + 60 * n("M", time) + n("S", time)
    return F.when(x.rlike(r"^P(\d+[YMWD])*(T(\d+[HMS])+)?$") & (F.length(x) > 1), F.struct(months.alias("months"), seconds.alias("seconds")))
