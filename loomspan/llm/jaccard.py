"""Near-duplicates by the exact Jaccard similarity of word shingles.

Two sets with a similarity of 4/5 or more share at least one of the first
n - ceil(4n/5) + 1 elements of each, n being the set's size, in any order that
is the same for all sets. So every pair that is to be linked meets at one of
these prefix elements and none is lost; the sets' sizes and the places where
they meet rule most other pairs out, and the similarity of the rest is counted
exactly. The order puts elements that a sample finds to be common last, which
makes the meetings few and has no part in the result.

A pair must moreover meet at several prefix elements, m: of what two such sets
share, at most n - k lies behind the prefix of k elements of the one whose
prefix ends first, so the rest is in both prefixes. Once it is known how many
sets have each prefix element, the m - 1 most common ones of a set's shared
elements need not bring it together with another: the rarest element at which
the two meet has m - 1 others behind it on either side. So passages that many
texts share make no pairs of texts that are otherwise different.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.textops import BASE, SPACE, count_in, lean, lowered, mixed, prefix_hash, runs, slices, stretch_hash
from loomspan.operators.components import connected_components, with_edges
from loomspan.session import written

#: The least similarity of a link, as a fraction.
LEAST = (4, 5)


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text; a text of fewer words is one shingle, a blank one has none.

    Words are what lies between ASCII white space, with A-Z lowered, as in op6.
    """
    low = lowered(data)
    starts, ends = runs(~SPACE[low], at)
    n = count_in(starts, at)
    h = stretch_hash(prefix_hash(low), starts, ends)
    first = np.concatenate([[0], np.cumsum(n)])
    base = np.uint64(BASE)
    every = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for k in range(words):
        every = every * base + h[k : k + len(every)]
    every = mixed(every)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(every[a : b - words + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                one = one * base + x
            out.append(mixed(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_name(s: np.ndarray) -> int:
    """A hash of a whole set, by which equal sets are one."""
    if not len(s):
        return 0
    place = mixed(np.arange(1, len(s) + 1, dtype=np.uint64))
    return int(mixed(np.array([np.sum(s * (place | np.uint64(1)), dtype=np.uint64)]))[0].view(np.int64))


def set_fingerprint(s: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes; zero for an empty set."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(s), 1 << 13):
        total += np.unpackbits(s[i : i + (1 << 13)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(s), bitorder="little").view(np.int64)[0])


def named(docs: DataFrame, text: str, key: str, words: int) -> DataFrame:
    """(key, text_hash, name, fp, size): a row for each row of docs; size is its set's."""

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, j, data, at in slices(b.column(2)):
                sets = shingle_sets(data, at, words)
                cols = [pa.array([f(s) for s in sets], pa.int64()) for f in (set_name, set_fingerprint, len)]
                yield pa.record_batch([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *cols], names=["key", "text_hash", "name", "fp", "size"])

    kind = docs.schema[key].dataType.simpleString()
    t = F.col(text).cast("string")
    return docs.select(F.col(key).alias("key"), text_hash(t).alias("text_hash"), t.alias("text")).mapInArrow(batches, f"key {kind}, text_hash long, name long, fp long, size long")


def text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _marks(needed: DataFrame, size: int = 1 << 22) -> bytes:
    """A bitmap of ``size`` bits, whatever the number of names, that has a bit for each name in needed: it spares work and decides nothing."""
    place = f"(name & {size - 1})"
    got = needed.groupBy(F.expr(f"shiftright({place}, 6)").alias("i")).agg(F.expr(f"bit_or(shiftleft(1L, cast({place} & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[got.column("i").to_numpy()] = got.column("bits").to_numpy()
    return out.tobytes()


def _sets(docs: DataFrame, text: str, words: int, marks: bytes | None = None) -> DataFrame:
    """(name, elements) of each row that has any and, if marks are given, whose name they have."""

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for _, _, data, at in slices(b.column(0)):
                sets = [s for s in shingle_sets(data, at, words) if len(s)]
                names = [set_name(s) for s in sets]
                if marks is not None:
                    packed = np.frombuffer(marks, np.uint8)
                    slots = np.array([n & (len(packed) * 8 - 1) for n in names], np.int64)
                    hit = packed[slots >> 3] >> (slots & 7).astype(np.uint8) & 1
                    sets, names = ([x for x, h in zip(part, hit, strict=True) if h] for part in (sets, names))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                elements = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
                yield pa.record_batch([pa.array(names, pa.int64()), elements], names=["name", "elements"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(batches, "name long, elements array<long>")


def _common(docs: DataFrame, text: str, words: int, sample: int, most: int) -> np.ndarray:
    """Shingles that recur in a sample of the texts, ascending by how often: (hash, count) columns, at most ``most``."""
    share = max(docs.count() // sample, 1)
    some = docs.where(F.pmod(text_hash(F.col(text).cast("string")), F.lit(share)) == 0)
    each = _sets(some, text, words).select(F.explode("elements").alias("x"))
    often = each.groupBy("x").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "x").limit(most)
    got = often.toArrow()
    return np.array([got.column("x").to_numpy().view(np.uint64), got.column("n").to_numpy().astype(np.uint64)]).reshape(2, -1)


def _prefixes(docs: DataFrame, text: str, words: int, common: np.ndarray) -> DataFrame:
    """(x, name, n, at): the elements of each row's prefix, their places from 0 and the set's size."""
    order = np.argsort(common[0])
    known, counts = common[0][order], common[1][order].astype(np.int64)
    top, whole = LEAST

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for _, _, data, at in slices(b.column(0)):
                xs, names, sizes, lengths = [], [], [], []
                for s in shingle_sets(data, at, words):
                    n = len(s)
                    if not n:
                        continue
                    if len(known):
                        i = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        ranked = s[np.lexsort((s, np.where(known[i] == s, counts[i], 0)))]
                    else:
                        ranked = s
                    k = n - (top * n + whole - 1) // whole + 1
                    xs.append(ranked[:k])
                    names.append(set_name(s))
                    sizes.append(n)
                    lengths.append(k)
                if not xs:
                    continue
                places = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
                yield pa.record_batch(
                    [pa.array(np.concatenate(xs).view(np.int64)), pa.array(np.repeat(np.array(names, np.int64), lengths)), pa.array(np.repeat(np.array(sizes, np.int32), lengths)), pa.array(places)],
                    names=["x", "name", "n", "at"],
                )

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(batches, "x long, name long, n int, at int")


def shared_only(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by x and name those whose x another name has too, each once. Only one row is held between batches."""
    last: pa.RecordBatch | None = None
    met = False
    for b in it:
        if not b.num_rows:
            continue
        if last is not None:
            b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
        x, name = b.column(0).to_numpy(), b.column(1).to_numpy()
        same = x[1:] == x[:-1]
        fresh = np.append(True, ~(same & (name[1:] == name[:-1])))
        b = b.filter(pa.array(fresh))
        x = x[fresh]
        same = x[1:] == x[:-1]
        before, after = np.append(met, same), np.append(same, False)
        hit = before | after
        hit[-1] = False  # its turn comes with the next batch
        met = bool(before[-1])
        last = b.slice(b.num_rows - 1)
        yield b.filter(pa.array(hit))
    if last is not None and met:
        yield last


def checked(pairs: DataFrame, docs: DataFrame, text: str, words: int) -> DataFrame:
    """Those of the pairs (a, b) of names whose sets have a similarity of LEAST or more."""
    top, whole = LEAST
    needed = written(pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct(), "jaccard-needed")
    sets = _sets(docs, text, words, _marks(needed)).join(needed, "name", "left_semi").dropDuplicates(["name"])
    sets = written(sets, "jaccard-sets")
    both = pairs.join(sets.select(F.col("name").alias("a"), F.col("elements").alias("ea")), "a").join(sets.select(F.col("name").alias("b"), F.col("elements").alias("eb")), "b")
    both = both.select("a", "b", (F.size("ea") + F.size("eb")).alias("n"), F.size(F.array_intersect("ea", "eb")).alias("same"))
    return both.where(F.col("same") * (top + whole) >= F.col("n") * top).select("a", "b")


def _may_link():
    """Whether two sets that meet at places ia and ib can have the similarity: by their sizes, and by what they can share before and after."""
    top, whole = LEAST
    sizes = (F.col("na") * whole >= F.col("nb") * top) & (F.col("nb") * whole >= F.col("na") * top)
    shared = F.least("ia", "ib") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    return sizes & (shared * (top + whole) >= (F.col("na") + F.col("nb")) * top) & (F.col("ca") != F.col("cb"))


def _meetings():
    """At how many prefix elements two sets of the similarity meet at least."""
    top, whole = LEAST
    both = F.ceil((F.col("na") + F.col("nb")) * top / F.lit(top + whole))
    behind = lambda n: F.ceil(F.col(n) * top / F.lit(whole)) - 1
    return both - F.greatest(behind("na"), behind("nb"))


def components(docs: DataFrame, text: str = "text", words: int = 5, links: DataFrame | None = None, sample: int = 20_000, most: int = 100_000, block: int = 1024, stars: int = 3, large: int = 2) -> DataFrame:
    """(node, component) of the names of sets, linked at a similarity of LEAST or more; a set without a link isn't among them.

    links (a, b), if given, are known links of that similarity. In ``stars``
    rounds, or fewer if one finds no link, the sets at each element of more than
    ``large`` meet one of them, a well-linked one, and each set is compared with
    that which it meets most often, if that is half as often as two linked sets
    meet. So a large group of near copies becomes one component in linear work
    and with few sets compared in vain. Then all pairs are compared that can meet often
    enough and aren't yet connected, so no link between components is missed.
    The members of an element that more than ``block`` sets share are dealt
    into blocks of about that size.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one shuffle by x finds the elements that several sets share; the rest ends there
    mine = _prefixes(docs, text, words, _common(docs, text, words, sample, most)).repartition(parts, "x").sortWithinPartitions("x", "name")
    held = written(mine.mapInArrow(lean(shared_only), "x long, name long, n int, at int"), "jaccard-shared")
    side = lambda k: [F.col("name").alias(k), F.col("n").alias("n" + k), F.col("at").alias("i" + k), F.col("c").alias("c" + k)]
    edges = links if links is not None else spark.createDataFrame([], "a long, b long")
    comp = written(connected_components(edges), "jaccard-components") if links is not None else spark.createDataFrame([], "node long, component long")
    turn = 0
    while turn <= stars:
        now = held.join(comp, held.name == comp.node, "left").select("x", "name", "n", "at", F.coalesce("component", "name").alias("c"))
        if turn < stars:
            ends = edges.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count("*").alias("links"))
            now = now.join(ends, "name", "left").withColumn("links", F.coalesce("links", F.lit(0)))
        # the set with the most links first, then by chance with odds of that number
        chance = F.pow((F.pmod(F.xxhash64("name", F.lit(turn)), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30)), 1 / (F.col("links") + 1.0)) if turn else F.col("links").cast("double")
        centre = F.max_by(F.struct("name", "n", "at", "c"), F.struct(chance, "name") if turn < stars else F.col("name")).alias("centre")
        live = now.groupBy("x").agg(F.count("*").alias("members"), F.min("c").alias("low"), F.max("c").alias("high"), centre).where("low < high")
        if turn < stars:
            left = live.where(F.col("members") > large).select("x", "centre.*").select("x", *side("a"))
            met = left.join(now.select("x", *side("b")), "x").where(_may_link())
            met = met.groupBy("b", "a").agg(F.count("*").alias("met"), F.first("na").alias("na"), F.first("nb").alias("nb")).where(F.col("met") * 2 >= _meetings())
            pairs = met.groupBy("b").agg(F.max_by("a", F.struct("met", "a")).alias("a"))
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            counted = held.groupBy("x").agg(F.count("*").alias("members"))
            ranked = held.join(counted, "x").withColumn("at_rank", F.row_number().over(Window.partitionBy("name").orderBy("members", "x")))
            sizes = held.groupBy("name").agg(F.count("*").alias("shared"))
            ranked = ranked.join(sizes, "name").select("x", "name", (F.col("shared") - F.col("at_rank")).cast("int").alias("behind"))
            dealt = now.join(live.select("x", F.ceil(F.col("members") / F.lit(block)).cast("int").alias("k")), "x").join(ranked, ["x", "name"])
            side = lambda k: [F.col("name").alias(k), F.col("n").alias("n" + k), F.col("at").alias("i" + k), F.col("c").alias("c" + k), F.col("behind").alias("r" + k)]
            left = dealt.select("x", *side("a"), F.pmod(F.xxhash64("name"), "k").cast("int").alias("part"))
            right = dealt.select("x", *side("b"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"))
            enough = F.least("ra", "rb") >= _meetings() - 1
            pairs = left.join(right, ["x", "part"]).where((F.col("a") < F.col("b")) & _may_link() & enough).select("a", "b").distinct()
        pairs = written(pairs, "jaccard-pairs")
        found = None if pairs.isEmpty() else written(checked(pairs, docs, text, words), "jaccard-found")
        if found is not None and not found.isEmpty():
            edges = edges.unionByName(found)
            comp = written(with_edges(comp, found), "jaccard-components")
            turn += 1
        else:
            turn = max(turn + 1, stars if turn < stars else 0)
    return comp


def grouped(rows: DataFrame, comp: DataFrame, key: str) -> DataFrame:
    """(key, text_hash, component_id) of rows (key, text_hash, name): the smallest key of each component, null where it has none."""
    held = rows.join(comp, rows.name == comp.node, "left").select("key", "text_hash", F.coalesce("component", "name").alias("root"))
    roots = written(held.groupBy("root").agg(F.min("key").alias("component_id")), "jaccard-roots")
    return held.join(roots, "root").select(F.col("key").alias(key), "text_hash", "component_id")
