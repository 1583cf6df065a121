"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions alone.

A mask reads some of the words in a window and ignores the others, so a
substituted word under an ignored place leaves the seed's hash as it was. The
seeds of the documents meet those of the benchmark items by hash. A hit
fixes an alignment; around it the item and the document are compared word by
word, and a leak is a stretch of ``window`` item words of which at least
``share`` are the document's (of all the item's words, if it has fewer).

The masks depend on the item's length. With a window of 25 words and a share
of 0.8 every way to place the allowed substitutions leaves at least one seed
whole, so no alignment that the comparison would accept is without a hit.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import written

#: (mask, the item lengths in words that it serves); in a mask 1: the word counts, 0: it may differ. All begin with two ones.
MASKS = (
    ("111111", 25, None),
    ("11011011", 25, None),
    ("1100101011", 25, None),
    ("1111", 6, 24),
    ("11011", 5, 24),
    ("111", 5, 5),
    ("1111", 4, 4),
    ("111", 3, 3),
    ("11", 2, 2),
)
#: Bits of the map of the benchmark's word pairs, a constant size.
PAIR_BITS = 1 << 20


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _serves(mask: tuple) -> Column:
    low, high = mask[1:]
    return (F.size("words") >= low) & (F.size("words") <= high) if high else F.size("words") >= low


def _pair(h: Column, i: Column) -> Column:
    return F.xxhash64(F.get(h, i), F.get(h, i + 1)).bitwiseAND(F.lit(PAIR_BITS - 1))


def _places(h: Column) -> Column:
    """Places of all words but the last."""
    return F.when(F.size(h) > 1, F.sequence(F.lit(0), F.size(h) - 2)).otherwise(F.array().cast("array<int>"))


def _pairs(items: DataFrame) -> list[int]:
    """The benchmark's pairs of neighbouring words as a bitmap: no seed can hit that begins with another pair. The result has PAIR_BITS bits at any size of the benchmark."""
    places = lambda h: F.transform(_places(h), lambda i: _pair(h, i))
    at = items.select(F.explode_outer(_let(_hashes(), places)).alias("at")).where("at is not null")
    per = at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).collect()
    out = [0] * (PAIR_BITS >> 6)
    for r in per:
        out[r.i] = r.bits
    return out


def _seed(h: Column, i: Column, number: int, mask: str) -> Column:
    """struct<place, seed> of the seed that starts at word i, null where it does not fit."""
    places = [k for k, m in enumerate(mask) if m == "1"]
    made = F.xxhash64(F.lit(number), *[F.get(h, i + k) for k in places])
    return F.when(i + len(mask) <= F.size(h), F.struct(i.alias("place"), made.alias("seed")))


def _let(x: Column, f) -> Column:
    """f(x) with x computed once, whatever the optimizer makes of columns."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _hashes() -> Column:
    return F.transform("words", lambda w: F.xxhash64(w))


def _seeds_at(h: Column, starts: Column, masks: list[int]) -> Column:
    seeder = lambda k: lambda i: _seed(h, i, k, MASKS[k][0])
    return F.concat(*[F.transform(starts, seeder(k)) for k in masks])


def _exploded(rows: DataFrame, key: str, found: Column) -> DataFrame:
    # an outer explode: no filter is inferred that would compute the array a second time
    return rows.select(key, F.explode_outer(found).alias("x")).where("x is not null").select(key, "x.place", "x.seed")


def _every(k: int):
    return lambda h: _seeds_at(h, F.sequence(F.lit(0), F.size(h) - 1), [k])


def item_seeds(items: DataFrame, masks: list[int]) -> DataFrame:
    """(item, place, seed) of items (item, words), each by the masks for its length."""
    out = None
    for k in masks:
        found = _let(_hashes(), _every(k))
        some = _exploded(items.where(_serves(MASKS[k])), "item", found)
        out = some if out is None else out.unionByName(some)
    return out


def text_seeds(rows: DataFrame, masks: list[int], pairs: list[int]) -> DataFrame:
    """(row, place, seed) of rows (row, words): seeds whose first two words are a pair of the benchmark."""
    # one constant, not an expression of as many parts as it has longs
    table = F.from_json(F.lit(json.dumps(pairs)), "array<bigint>")

    def known(h: Column):
        def hit(i: Column) -> Column:
            at = _pair(h, i)
            return F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

        return hit

    found = _let(_hashes(), lambda h: _let(F.filter(_places(h), known(h)), lambda starts: _seeds_at(h, starts, masks)))
    return _exploded(rows, "row", found)


def _leak(doc: Column, item: Column, shift: Column, window: int, share: float) -> Column:
    """Whether some window of item words agrees with the document at this alignment."""
    # a place before the text or behind it has no word
    same = F.transform(item, lambda w, j: F.when((j + shift >= 0) & (F.get(doc, j + shift) == w), 1).otherwise(0))
    size = F.least(F.size(item), F.lit(window))
    starts = F.sequence(F.lit(1), F.size(item) - size + 1)
    agree = lambda s: F.aggregate(F.slice(same, s, size), F.lit(0), lambda a, x: a + x)
    return F.exists(starts, lambda s: agree(s) >= F.lit(share) * size)


def _row(key: Column, text: Column) -> Column:
    """A 128-bit name of a key and its text."""
    return F.md5(F.concat(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("")), F.lit("\0"), F.coalesce(text.cast("string"), F.lit(""))))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", window: int = 25, share: float = 0.8, most_seeds: int = 1_000_000, least_words: int = 2, block: int = 256) -> DataFrame:
    """(row, items): documents that hold benchmark items, by a digest of key and text, with the sorted ids of the items.

    The benchmark's seeds are broadcast while they are at most most_seeds, by
    count; beyond that the two sides are shuffled by seed, where a seed that many
    documents share is split by the adaptive skew join. The hits of a text are
    compared in blocks of about ``block``, so that a text with any number of
    them takes a bounded row. Items of one word name nothing, nor do those of
    fewer than least_words. The masks are complete for a window of 25 words or
    more and a share of 0.8 or more; others raise ValueError. Null texts are
    empty and hold nothing; equal rows count once; benchmark rows that repeat
    count once, those without an id or words not at all; an empty table on
    either side gives an empty result.
    """
    if window < 25 or not 0.8 <= share <= 1:
        raise ValueError("the masks find all leaks of a window of at least 25 words and a share of at least 0.8")
    held = docs.select(_row(F.col(key), F.col(text)).alias("row"), F.col(text).cast("string").alias("text"))
    items = benchmark.select("item_id", words(F.col("text").cast("string")).alias("words")).where(F.col("item_id").isNotNull() & (F.size("words") >= max(least_words, 2))).distinct()
    items = written(items.withColumn("item", F.md5(F.concat_ws("\0", F.col("item_id").cast("string"), F.array_join("words", " ")))), "decontaminate-items")
    have = items.agg(*[F.coalesce(F.max(_serves(m)), F.lit(False)).alias(str(k)) for k, m in enumerate(MASKS)]).first()
    masks = [k for k in range(len(MASKS)) if have[k]] or [0]
    wanted = written(item_seeds(items, masks).withColumnRenamed("place", "item_place"), "decontaminate-seeds")
    if wanted.count() <= most_seeds:
        wanted = F.broadcast(wanted)
    mine = text_seeds(held.select("row", words(F.col("text")).alias("words")), masks, _pairs(items))
    hits = mine.join(wanted, "seed").select("row", "item", (F.col("place") - F.col("item_place")).alias("shift"))
    hits = written(hits.distinct(), "decontaminate-hits")
    # the hits of a text are one row, or one for each block of them, so that it is read and split as few times as can be
    rows = written(hits.groupBy("row").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks")), "decontaminate-rows")  # small as a rule, and then broadcast by its size
    dealt = hits.join(rows, "row").withColumn("block", F.pmod(F.xxhash64("item", "shift"), F.col("blocks")))
    near = dealt.join(items.select("item", "item_id", F.col("words").alias("item_words")), "item").groupBy("row", "block").agg(F.collect_list(F.struct("item_id", "item_words", "shift")).alias("hits"))
    texts = held.join(rows.select("row"), "row", "left_semi").dropDuplicates(["row"])
    good = lambda w: F.transform(F.filter("hits", lambda h: _leak(w, h["item_words"], h["shift"], window, share)), lambda h: h["item_id"])
    found = texts.join(near, "row").select("row", F.explode_outer(_let(words(F.col("text")), good)).alias("item_id")).where("item_id is not null")
    return found.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """docs with the columns leaked_items (sorted item ids, else empty) and contaminated.

    These two replace columns of their names; all others stay, whatever their
    names. A null or empty text is clean; equal rows get equal results, a null
    key its own; an empty table gives an empty result. See ``leaks``.
    """
    found = written(leaks(docs, benchmark, text, key, **how), "decontaminate-leaks")
    kind = found.schema["items"].dataType
    own = [c for c in docs.columns if c not in ("leaked_items", "contaminated")]
    held = docs.select(F.struct(*own).alias("_doc"), _row(F.col(key), F.col(text)).alias("row")).join(found, "row", "left")
    none = F.array().cast(kind)
    return held.select(*[F.col("_doc")[c].alias(c) for c in own], F.coalesce("items", none).alias("leaked_items"), F.col("items").isNotNull().alias("contaminated"))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, benchmark).select("doc_id", "contaminated", "leaked_items")
