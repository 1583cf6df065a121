"""Ordered paragraph events to content items, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import annex_reference, article_reference

MARKER = r"^\(([A-Za-z0-9]+)\)$"
NUMBERED = r"^(\d+)\.\s+(.*)$"


def _found(x: Column, pattern: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, i), F.lit(""))


def carry_forward(df: DataFrame, value: str, out: str, by: list[str], order: str) -> DataFrame:
    """The last non-null value up to each row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def first_wins(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by a partial aggregate: a key that most rows share is no burden to one task. Of rows that are equal in order the least is taken."""
    row = F.struct(*df.columns)
    first = df.groupBy(*by).agg(F.min_by(row, F.struct(*order, F.xxhash64(row))).alias("_row"))
    return first.select("_row.*")


def pending_labels(df: DataFrame, unit: list[str], order: str = "pos", text: str = "text") -> DataFrame:
    """List markers on their own become list_label of the body row behind them; of markers in a row the last counts."""
    w = Window.partitionBy(*unit).orderBy(order)
    marked = df.withColumn("_m", _found(F.col(text), MARKER))
    marked = marked.withColumn("list_label", F.lag("_m").over(w))
    return marked.where("_m is null").drop("_m")


def _labelled(label: Column | str, text: Column | str) -> Column:
    """A body with the marker that stood before it in front; without one as it is."""
    label, text = (F.col(c) if isinstance(c, str) else c for c in (label, text))
    return F.coalesce(F.concat(F.lit("("), label, F.lit(") "), text), text)


def article_items(p: DataFrame) -> DataFrame:
    """Content items of articles from rows (unit, container_id, pos, text): number carried on in a container, labels, reference.

    The text keeps its number; a label that stood before it as a marker is put in front.
    """
    items = pending_labels(p, ["unit"])
    items = items.withColumn("_own", _found(F.col("text"), NUMBERED))
    w = Window.partitionBy("unit", "container_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    number = F.when(F.col("container_id").isNull(), F.col("_own")).otherwise(F.last("_own", ignorenulls=True).over(w))
    items = items.withColumn("paragraph_number", number).withColumn("text", _labelled("list_label", "text"))
    return items.withColumn("reference", article_reference(F.col("unit"), F.col("paragraph_number"), F.col("list_label"))).drop("_own")


def annex_items(p: DataFrame) -> DataFrame:
    """Content items of annexes: a section heading, in any case, starts a run in which numbers begin anew; labels pass over headings.

    A letter in parentheses at a text's start is its label unless a marker stood
    before it, which is then put in front of the text.
    """
    order = Window.partitionBy("unit").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = p.withColumn("_m", _found(F.col("text"), MARKER)).withColumn("_s", F.upper(_found(F.col("text"), r"(?i)^Section\s+([A-Z])\b")))
    marked = marked.withColumn("_run", F.count("_s").over(upto)).withColumn("section", F.last("_s", ignorenulls=True).over(upto))
    items = marked.where("_s is null").withColumn("_before", F.lag("_m").over(order)).where("_m is null")
    own = F.coalesce(_found(F.col("text"), NUMBERED), F.try_element_at(F.regexp_extract_all("text", F.lit(r"(?:^|\s)(\d+)\.\s+[A-Z]"), 1), F.lit(-1)))
    run = Window.partitionBy("unit", "_run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    items = items.withColumn("_own", own).withColumn("paragraph_number", F.last("_own", ignorenulls=True).over(run))
    items = items.withColumn("list_label", F.coalesce("_before", _found(F.col("text"), r"^\(([a-z])\)\s+"))).withColumn("text", _labelled("_before", "text"))
    items = items.withColumn("reference", annex_reference(F.col("unit"), F.col("section"), F.col("paragraph_number"), F.col("list_label")))
    return items.drop("_m", "_s", "_run", "_own", "_before")


def titles(p: DataFrame) -> DataFrame:
    """(unit, kind, title): a chapter's first title line, an article's last, an annex's first line that is not its number."""
    line = p.where("class = 'title'").where(~((F.col("kind") == "annex") & F.col("text").rlike(r"ANNEX\W*[A-Z]+")))
    first, last = F.min_by("text", "pos"), F.max_by("text", "pos")
    return line.groupBy("unit", "kind").agg(F.when(F.first("kind") == "article", last).otherwise(first).alias("title"))


def one_per_unit(df: DataFrame, unit: str, kind: str, only: str, order: str) -> DataFrame:
    """At most one row of kind ``only`` in a unit; others stay."""
    return df.where(~F.col(kind).eqNullSafe(F.lit(only))).unionByName(first_wins(df.where(F.col(kind) == only), [unit], [order]))


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def synthetic_annex_items(units: DataFrame) -> DataFrame:
    """Items of annexes (unit, text) that came as one text: (unit, pos, sub, section, paragraph_number, list_label, reference, text).

    An item begins at a number with a stop and space behind it; what stands
    before the first is none. A section named in an item's text is its section
    and that of the items behind it, and the item ends there; one named before
    the first item is that of the first. Lettered parts of an item follow it
    (sub from 1), each up to its first semicolon. Null and empty texts, and
    those without a number, have no items.
    """
    number, section, letter = r"(?:^|\s)(\d+)\.\s+", r"Section\s+([A-Z])", r"\(([a-z])\)\s+"
    every = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    body = F.split("text", number, -1)
    parts = units.select("unit", F.posexplode(F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), every("text", number)).alias("number"), body.alias("body"))).alias("pos", "x"))
    parts = parts.select("unit", "pos", F.col("x.number").alias("paragraph_number"), F.col("x.body").alias("body")).withColumn("section", _found(F.col("body"), section))
    parts = carry_forward(parts, "section", "section", ["unit"], "pos").where("paragraph_number is not null")
    items = parts.withColumn("head", F.get(F.split("body", section, 2), F.lit(0)))
    found = F.arrays_zip(every("head", letter).alias("label"), F.slice(F.split("head", letter, -1), 2, 1 << 30).alias("body"))
    lettered = F.transform(found, lambda x, i: F.struct((i + 1).alias("sub"), x["label"].alias("label"), _labelled(x["label"], _bare(F.get(F.split(x["body"], r";\s*", 2), F.lit(0)))).alias("text")))
    whole = F.struct(F.lit(0).alias("sub"), F.lit(None).cast("string").alias("label"), F.concat("paragraph_number", F.lit(". "), _bare(F.col("head"))).alias("text"))
    out = items.select("unit", F.col("pos").cast("int").alias("pos"), "section", "paragraph_number", F.explode(F.concat(F.array(whole), lettered)).alias("x"))
    reference = annex_reference(F.upper("unit"), F.col("section"), F.col("paragraph_number"), F.col("list_label"))
    return out.select("unit", "pos", "x.sub", "section", "paragraph_number", F.col("x.label").alias("list_label"), "x.text").withColumn("reference", reference)


def with_synthetic(items: DataFrame, annexes: DataFrame) -> DataFrame:
    """Annex items, and for annexes (unit, text) that have none those cut out of their text, at places pos and then sub."""
    cols = ["unit", "pos", "section", "paragraph_number", "list_label", "reference", "text"]
    lacking = annexes.join(items.select("unit").distinct(), "unit", "left_anti")
    made = synthetic_annex_items(lacking).withColumn("pos", F.col("pos") * 1000 + F.col("sub"))
    have = items.select(*[c if c in items.columns else F.lit(None).cast("string").alias(c) for c in cols])
    return have.unionByName(made.select(*cols))
