"""Scoring of predictions against gold annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import normalise_entity
from loomspan.operators.doctree import first_wins


def greedy_pairs(gold: Column, predicted: Column) -> Column:
    """How many of the predicted texts find a gold text of their own, in order, one text containing the other. Both are arrays."""
    fits = lambda p: lambda g: g.eqNullSafe(p) | ((p != "") & (g != "") & (p.contains(g) | g.contains(p)))

    def take(free: Column, p: Column) -> Column:
        # the position of the first free text that fits, from 1; null for none
        at = F.get(F.filter(F.transform(free, lambda g, i: F.when(fits(p)(g), i + 1)), lambda i: i.isNotNull()), F.lit(0))
        return F.when(at.isNull(), free).otherwise(F.filter(free, lambda _, i: i + 1 != at))

    return (F.size(gold) - F.size(F.aggregate(predicted, gold, take))).cast("long")


def match_entities(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(sentence, type, tp, fp, fn). gold and predicted have sentence, type, pos, text.

    The matching is greedy in order of position, then of text, so a sentence's
    entities of one type meet in one row; that is a sentence's size.
    """
    # a null position comes last
    entity = F.struct(F.col("pos").isNull().alias("late"), "pos", normalise_entity(F.col("text")).alias("text"))
    none = F.when(F.lit(False), entity)
    tag = lambda df, g, p: df.select("sentence", "type", g.alias("g"), p.alias("p"))
    both = tag(gold, entity, none).unionByName(tag(predicted, none, entity))
    met = both.groupBy("sentence", "type").agg(F.collect_list("g").alias("g"), F.collect_list("p").alias("p"))
    texts = lambda c: F.transform(F.sort_array(c), lambda e: e["text"])
    tp = met.select("sentence", "type", greedy_pairs(texts("g"), texts("p")).alias("tp"), F.size("g").cast("long").alias("ng"), F.size("p").cast("long").alias("np"))
    return tp.select("sentence", "type", "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"))


def combined(*predictions: DataFrame) -> DataFrame:
    """Predictions of several systems, each normalised text and type of a sentence once, earlier systems first."""
    out = None
    for n, p in enumerate(predictions):
        p = p.withColumn("_s", F.lit(n))
        out = p if out is None else out.unionByName(p)
    return first_wins(out.withColumn("_t", normalise_entity(F.col("text"))), ["sentence", "type", "_t"], ["_s", "pos"]).drop("_s", "_t")


def suffix_join(names: DataFrame, keys: DataFrame, name: str = "name", key: str = "key", pos: str = "pos", most: int = 1_000) -> DataFrame:
    """names with the first key, by pos and then by key, that the name ends with; null where none does.

    The keys' lengths are few, and a name is cut at each of them, so all keys are
    found by one equality join. More than ``most`` lengths raise ValueError.
    Repeated names stay; null names match nothing, null and empty keys nothing;
    an empty table on either side gives names without keys.
    """
    held = keys.where(F.length(key) > 0).groupBy(F.col(key).alias("_key")).agg(F.min(pos).alias("_pos"))
    lengths = [r[0] for r in held.select(F.length("_key")).distinct().limit(most + 1).collect()]
    if len(lengths) > most:
        raise ValueError(f"keys of more than {most} lengths")
    cut = F.transform(F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length("_name")), lambda n: F.right(F.col("_name"), n))
    each = names.select(F.col(name).alias("_name")).distinct().select("_name", F.explode(cut).alias("_key"))
    first = each.join(held, "_key").groupBy("_name").agg(F.min_by("_key", F.struct("_pos", "_key")).alias(key))
    return names.join(first, names[name] == first["_name"], "left").drop("_name")
