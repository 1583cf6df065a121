"""Phrase collocations from count tries.

A shard of texts becomes a count trie for each language: words at depth 1,
pairs at depth 2, triples at depth 3, sorted, each with its occurrences. A trie
is serialised in pieces, one for each range of prefixes: a prefix of two words
with all below it lies in one range, and ranges are by hash, so a frequent word
is spread over all of them. The pieces of a range are merged as they stream
in, so what a task holds is the range's distinct nodes, however often a phrase
occurs. Words are told apart by their bytes: each piece carries its own sorted
vocabulary.

A walk down the merged trie gives a phrase's left parts. Its right parts are
the phrase's suffix links: nodes of another range, found by joins of the
frequent nodes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.packed import packed, packed_steps, restored, squeezed, unpacked, unpacked_steps
from loomspan.llm.textops import exact_words, lean, lowered, mixed, runs
from loomspan.session import written

BREAK = np.zeros(256, dtype=bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
BLANK = np.zeros(256, dtype=bool)
BLANK[list(b" \t")] = True
#: Language of texts without one.
UNKNOWN = "und"


@dataclass
class Trie:
    """Counts by depth, sorted by words: one (depth 1), pair and two (depth 2, as first * size + second word), parent (index of a pair), third and three (depth 3)."""

    words: pa.Array
    single: np.ndarray
    one: np.ndarray
    pair: np.ndarray
    two: np.ndarray
    parent: np.ndarray
    third: np.ndarray
    three: np.ndarray


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys ascending, their counts)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


def _sorted(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the distinct words in byte order, each one's rank)."""
    order = pc.array_sort_indices(words)
    rank = np.empty(len(words), np.int64)
    rank[order.to_numpy()] = np.arange(len(words))
    return words.take(order), rank


def counted(data: np.ndarray, at: np.ndarray) -> Trie:
    """The trie of a run of texts."""
    low = lowered(data)
    stop = BREAK[low]
    inside = ~(stop | BLANK[low])
    starts, ends = runs(inside, at)
    index, words = exact_words(low, inside, starts, ends)
    words, rank = _sorted(words)
    w, size = rank[index] if len(index) else np.zeros(0, np.int64), max(len(words), 1)
    # words of one piece: the same text, and no stop between
    piece = np.cumsum(stop)[starts] + (np.searchsorted(at, starts, side="right") << 40) if len(starts) else np.zeros(0, np.int64)
    near = piece[1:] == piece[:-1]
    pairs = (w[:-1] * size + w[1:])[near]
    single, one = _summed(w)
    pair, two = _summed(pairs)
    both = near[1:] & near[:-1]
    lead = np.searchsorted(pair, (w[:-2] * size + w[1:-1])[both])
    triple, three = _summed(lead * size + w[2:][both])
    return Trie(words, single, one, pair, two, triple // size, triple % size, three)


def merged(tries: list[Trie]) -> Trie:
    """One trie with the sums of all."""
    if len(tries) == 1:
        return tries[0]
    coded = pa.concat_arrays([t.words for t in tries]).dictionary_encode()
    words, rank = _sorted(coded.dictionary)
    places = rank[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    cut = np.cumsum([0, *(len(t.words) for t in tries)])
    size = max(len(words), 1)
    singles, pairs, leads, thirds = [], [], [], []
    for t, i, j in zip(tries, cut[:-1], cut[1:], strict=True):
        own, n = places[i:j], max(j - i, 1)
        singles.append(own[t.single])
        pairs.append(own[t.pair // n] * size + own[t.pair % n])
        leads.append(pairs[-1][t.parent])
        thirds.append(own[t.third])
    every = lambda name: np.concatenate([getattr(t, name) for t in tries])
    single, one = _summed(np.concatenate(singles), every("one"))
    pair, two = _summed(np.concatenate(pairs), every("two"))
    triple, three = _summed(np.searchsorted(pair, np.concatenate(leads)) * size + np.concatenate(thirds), every("three"))
    return Trie(words, single, one, pair, two, triple // size, triple % size, three)


def pieces(t: Trie, ranges: int) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """(range, vocabulary, arrays) of each range that the trie has nodes in."""
    size = max(len(t.words), 1)
    h = np.array([xxhash.xxh64_intdigest(w) for w in t.words.to_pylist()], np.uint64)
    r1 = (mixed(h[t.single]) % np.uint64(ranges)).astype(np.int64)
    r2 = (mixed(h[t.pair // size] * np.uint64(0x9FB21C651E98DF25) + h[t.pair % size]) % np.uint64(ranges)).astype(np.int64)
    o1, o2 = np.argsort(r1, kind="stable"), np.argsort(r2, kind="stable")
    b1, b2 = (np.searchsorted(r[o], np.arange(ranges + 1)) for r, o in ((r1, o1), (r2, o2)))
    first = np.searchsorted(t.parent, np.arange(len(t.pair) + 1))
    for r in range(ranges):
        s, p = o1[b1[r] : b1[r + 1]], o2[b2[r] : b2[r + 1]]
        if not len(s) + len(p):
            continue
        kids = first[p + 1] - first[p]
        k = np.repeat(first[p] - (np.cumsum(kids) - kids), kids) + np.arange(kids.sum())
        single, lead, second, third = t.single[s], t.pair[p] // size, t.pair[p] % size, t.third[k]
        own = np.unique(np.concatenate([single, lead, second, third]))
        place = lambda x: np.searchsorted(own, x).astype(np.uint32)  # noqa: E731, B023
        # words hold no line feed
        yield r, squeezed(b"\n".join(t.words.take(pa.array(own)).to_pylist())), [
            packed_steps(place(single)), packed(t.one[s]), packed_steps(place(lead)), packed(place(second)), packed(t.two[p]), packed(kids.astype(np.uint32)), packed(place(third)), packed(t.three[k]),
        ]


def read_piece(vocabulary: bytes, arrays: list[bytes]) -> Trie:
    words = pa.array(restored(vocabulary).split(b"\n"), pa.large_binary())
    single, lead = (unpacked_steps(arrays[i], np.uint32).astype(np.int64) for i in (0, 2))
    second, kids, third = (unpacked(arrays[i], np.uint32).astype(np.int64) for i in (3, 5, 6))
    one, two, three = (unpacked(arrays[i], np.int64) for i in (1, 4, 7))
    return Trie(words, single, one, lead * max(len(words), 1) + second, two, np.repeat(np.arange(len(kids)), kids), third, three)


def _shards(ranges: int, shard_bytes: int):
    """Pieces of the tries of runs of about shard_bytes of text."""

    def tries(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        for lang in table.column("lang").unique().to_pylist():
            texts = table.filter(pc.equal(table.column("lang"), lang)).column("text").cast(pa.large_string()).combine_chunks()
            _, offsets, data = texts.buffers()
            at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
            rows = list(pieces(counted(raw, at - at[0]), ranges))
            if rows:
                cols = [pa.array([lang] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.binary()))]
                yield pa.record_batch(cols, names=["lang", "range", "vocabulary", "arrays"])

    @lean
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in it:
            held.append(b)
            size += b.nbytes
            if size >= shard_bytes:
                yield from tries(held)
                held, size = [], 0
        if held:
            yield from tries(held)

    return work


NODES = "lang string, depth int, w1 string, w2 string, w3 string, a long, l long, longer long"


def _frequent(lang: str, t: Trie, least: int) -> pa.RecordBatch:
    """The nodes that occur often enough, triples with the count of their first two words, pairs with that of their most frequent triple; one row of depth 0 has the number of words."""
    size = max(len(t.words), 1)
    s, p, k = (np.flatnonzero(c >= least) for c in (t.one, t.two, t.three))
    best = np.zeros(len(t.pair), np.int64)
    np.maximum.at(best, t.parent[k], t.three[k])
    text = t.words.cast(pa.large_string())
    word = lambda *parts: pa.concat_arrays([pa.nulls(x, pa.large_string()) if isinstance(x, int) else text.take(pa.array(x)) for x in parts]).cast(pa.string())
    up = t.pair[t.parent[k]]
    n = 1 + len(s) + len(p) + len(k)
    number = lambda *parts: pa.array(np.concatenate([[parts[0]], *parts[1:]]).astype(np.int64))
    cols = {
        "lang": pa.array([lang] * n), "depth": pa.array(np.repeat(np.arange(4, dtype=np.int32), [1, len(s), len(p), len(k)])),
        "w1": word(1, t.single[s], t.pair[p] // size, up // size), "w2": word(1 + len(s), t.pair[p] % size, up % size), "w3": word(1 + len(s) + len(p), t.third[k]),
        "a": number(int(t.one.sum()), t.one[s], t.two[p], t.three[k]), "l": number(0, np.zeros(len(s)), np.zeros(len(p)), t.two[t.parent[k]]), "longer": number(0, np.zeros(len(s)), best[p], np.zeros(len(k))),
    }
    return pa.record_batch(list(cols.values()), names=list(cols))


def _merge(least: int, most: int):
    """Frequent nodes of each (lang, range) of rows sorted by them; pieces are merged whenever more than ``most`` nodes have come in."""

    @lean
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for b in it:
            for lang, r, vocabulary, arrays in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if (lang, r) != now:
                    if held:
                        yield _frequent(now[0], merged(held), least)
                    now, held, size = (lang, r), [], 0
                held.append(read_piece(vocabulary, arrays))
                size += len(held[-1].three)
                if size > most:
                    held = [merged(held)]
                    size = 0
        if held:
            yield _frequent(now[0], merged(held), least)

    return work


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of up to 37 digits; a count of 10**14 or more raises."""
    wide = lambda c: f"cast({c} as decimal(14, 0))"
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})")


def frequent_nodes(docs: DataFrame, text: str, lang: str, least: int, shard_bytes: int, most: int) -> DataFrame:
    """(lang, depth, w1, w2, w3, a, l, longer) of the merged tries, see ``_frequent``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    shards = rows.mapInArrow(_shards(2 * parts, shard_bytes), "lang string, range int, vocabulary binary, arrays array<binary>")
    shards = shards.repartition(parts, "lang", "range").sortWithinPartitions("lang", "range")
    return written(shards.mapInArrow(_merge(least, most), NODES), "phrase-nodes")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, inside: int = 50, top: int = 2000, shard_bytes: int = 16 << 20, most: int = 4_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of two or three words of each language.

    a, l and r count a phrase and the parts of its lowest-scoring cut (of equal
    scores the first cut), n all words of the language; the order is by score,
    then a, both descending, then the phrase's bytes. A phrase within a longer
    one of at least ``inside`` in a hundred of its occurrences is left out.
    Phrases occur ``least`` times or more, within pieces between stops.

    Null and empty texts have no words; a null language is ``und``; repeated
    rows count as often as they occur; extra columns are ignored; an empty table
    gives an empty result. Words are compared by their bytes, counts are whole
    numbers throughout.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = frequent_nodes(docs, text, lang, least, shard_bytes, most)
    words = nodes.where("depth = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    one = lambda w, c: nodes.where("depth = 1").select("lang", F.col("w1").alias(w), F.col("a").alias(c))
    two = nodes.where("depth = 2").select("lang", "w1", "w2", "a", "longer").join(one("w1", "l"), ["lang", "w1"]).join(one("w2", "r"), ["lang", "w2"])
    two = written(two.select("lang", "w1", "w2", "a", "longer", "l", "r"), "phrase-pairs")
    three = nodes.where("depth = 3").select("lang", "w1", "w2", "w3", "a", F.col("l").alias("l2"))
    head = two.select("lang", "w1", "w2", F.col("l").alias("l1"))
    tail = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    cuts = three.join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"]).withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    pick = lambda k: F.when(F.col("s1") <= F.col("s2"), F.col(f"{k}1")).otherwise(F.col(f"{k}2"))
    triples = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("l").alias("l"), pick("r").alias("r"), F.least("s1", "s2").alias("score"))
    after = three.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("a").alias("before"))
    longer = F.greatest("longer", F.coalesce("before", F.lit(0)))
    pairs = two.join(after, ["lang", "w1", "w2"], "left").where((longer == 0) | (100 * longer < inside * F.col("a")))
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each share of a language's phrases, then the best of those
    every = triples.unionByName(pairs).withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
with t as (select row_number() over () as d, coalesce(lang, 'und') as lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as pieces from documents),
p as (select d, lang, generate_subscripts(pieces, 1) as k, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') as words from t),
w as (select d, k, lang, generate_subscripts(words, 1) as i, unnest(words) as word from p),
g as (select lang, word as w1, lead(word) over x as w2, lead(word, 2) over x as w3 from w window x as (partition by d, k order by i)),
f1 as (select lang, w1, count(*) as a from g group by all),
f2 as (select lang, w1, w2, count(*) as a from g where w2 is not null group by all),
f3 as (select lang, w1, w2, w3, count(*) as a from g where w3 is not null group by all having count(*) >= 10),
n as (select lang, sum(a)::bigint as n from f1 group by lang),
c2 as (select f2.lang, f2.w1, f2.w2, f2.a, l.a as l, r.a as r, 1000000::hugeint * f2.a * f2.a // (l.a::hugeint * r.a) as score
       from f2 join f1 l on l.lang = f2.lang and l.w1 = f2.w1 join f1 r on r.lang = f2.lang and r.w1 = f2.w2 where f2.a >= 10),
c3 as (select f3.*, l1.a as l1, r1.a as r1, l2.a as l2, r2.a as r2, 1000000::hugeint * f3.a * f3.a // (l1.a::hugeint * r1.a) as s1, 1000000::hugeint * f3.a * f3.a // (l2.a::hugeint * r2.a) as s2
       from f3 join f1 l1 on l1.lang = f3.lang and l1.w1 = f3.w1 join f2 r1 on r1.lang = f3.lang and r1.w1 = f3.w2 and r1.w2 = f3.w3
               join f2 l2 on l2.lang = f3.lang and l2.w1 = f3.w1 and l2.w2 = f3.w2 join f1 r2 on r2.lang = f3.lang and r2.w1 = f3.w3),
c as (select lang, w1 || ' ' || w2 || ' ' || w3 as phrase, a, case when s1 <= s2 then l1 else l2 end as l, case when s1 <= s2 then r1 else r2 end as r, least(s1, s2) as score from c3
      union all
      select lang, w1 || ' ' || w2, a, l, r, score from c2
      where not exists (select 1 from f3 where f3.lang = c2.lang and f3.w1 = c2.w1 and f3.w2 = c2.w2 and 100 * f3.a >= 50 * c2.a)
        and not exists (select 1 from f3 where f3.lang = c2.lang and f3.w2 = c2.w1 and f3.w3 = c2.w2 and 100 * f3.a >= 50 * c2.a)),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from c)
select lang, rank, phrase, a, l, r, n, score::bigint as score from o join n using (lang) where rank <= 2000"""
