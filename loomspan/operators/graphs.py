"""Graph mutation and graph analytics over triple tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.components import connected_components
from loomspan.operators.paths import closure, longest
from loomspan.session import free_shuffles, written
from loomspan.terms import COLUMNS, SUBCLASS, TYPE, XSD


def merge(*layers: DataFrame, repeats: bool = False) -> DataFrame:
    """Set union of graphs. With repeats a triple may stay more than once, for a later merge: so many layers are made distinct once."""
    all_ = reduce(DataFrame.unionByName, [g.select(*COLUMNS) for g in layers])
    return all_ if repeats else all_.distinct()


def with_layer(layers: dict[str, DataFrame]) -> DataFrame:
    """All layers with their provenance, which is not part of a triple's identity."""
    return reduce(DataFrame.unionByName, [g.select(*COLUMNS, F.lit(n).alias("layer")) for n, g in layers.items()])


def layer_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """(layer, triples) with a row ``merged`` for the union."""
    each = with_layer(layers).distinct().groupBy("layer").agg(F.count("*").alias("triples"))
    return each.unionByName(merge(*layers.values()).agg(F.count("*").alias("triples")).select(F.lit("merged").alias("layer"), "triples"))


def delete_nodes(g: DataFrame, manifest: DataFrame) -> DataFrame:
    """Drop triples whose subject or (non-literal) object is a uri of the manifest; predicates don't matter."""
    gone = manifest.select(F.col("uri").alias("_uri")).distinct()
    left = g.join(gone, F.col("s") == F.col("_uri"), "left_anti")
    return left.join(gone, (F.col("o") == F.col("_uri")) & (F.col("o_kind") != "literal"), "left_anti")


def deletion_counts(g: DataFrame, manifest: DataFrame) -> DataFrame:
    """(kind, subjects): deleted triples by the kind of the manifest entry that is their subject."""
    hits = g.join(manifest, g.s == manifest.uri)
    return manifest.select("kind").distinct().join(hits.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("subjects"))


def sanitise(g: DataFrame, string_predicates: list[str], duration_predicate: str) -> DataFrame:
    """IRIs under string predicates become string literals; durations-to-be that start with P get their datatype."""
    to_text = F.col("p").isin(string_predicates) & (F.col("o_kind") == "iri")
    to_duration = (F.col("p") == duration_predicate) & (F.col("o_kind") == "literal") & F.col("o").startswith("P") & ~F.col("o_dt").eqNullSafe(F.lit(XSD + "duration"))
    out = g.withColumn("o_dt", F.when(to_text, XSD + "string").when(to_duration, XSD + "duration").otherwise(F.col("o_dt")))
    out = out.withColumn("o_lang", F.when(to_duration, None).otherwise(F.col("o_lang")))
    return out.withColumn("o_kind", F.when(to_text, "literal").otherwise(F.col("o_kind"))).select(*COLUMNS).distinct()


def sanitise_counts(g: DataFrame, string_predicates: list[str], duration_predicate: str) -> DataFrame:
    """(predicate, changed)."""
    text = g.where(F.col("p").isin(string_predicates) & (F.col("o_kind") == "iri"))
    time = g.where((F.col("p") == duration_predicate) & (F.col("o_kind") == "literal") & F.col("o").startswith("P") & ~F.col("o_dt").eqNullSafe(F.lit(XSD + "duration")))
    return text.unionByName(time).groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("changed"))


def build_variants(tbox: DataFrame, abox: DataFrame, added: DataFrame | None, manifest: DataFrame | None, string_predicates: list[str], duration_predicate: str) -> tuple[DataFrame, DataFrame]:
    """(pre, post): the sanitised base graph, and the same with additions made, then deletions, then sanitised. Without additions and deletions post is pre."""
    base = merge(tbox, abox)
    post = merge(base, added) if added is not None else base
    post = delete_nodes(post, manifest) if manifest is not None else post
    return sanitise(base, string_predicates, duration_predicate), sanitise(post, string_predicates, duration_predicate)


def edges(g: DataFrame, without: list[str] = ()) -> DataFrame:
    """Distinct (src, dst) between nodes, some predicates left out."""
    kept = g.where(F.col("o_kind") != "literal").where(~F.col("p").isin(list(without)) if without else F.lit(True))
    return kept.select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()


def degrees(e: DataFrame) -> DataFrame:
    """(node, degree): incoming and outgoing edges."""
    ends = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


#: Out-edges that one group of clustering holds at most, about, and those below which more tasks aren't worth a group of their own.
GROUP, LEAST = 24_000_000, 1_000_000
#: Bytes of packed lists that are unpacked at once.
SLICE = 1 << 20


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, n, packed) of rows (src, to): sorted lists as the gaps of their numbers, seven bits a byte, the last byte of a gap below 128."""
    for b in batches:
        sizes, flat = b.column(1).value_lengths().to_numpy().astype(np.int64), b.column(1).flatten().to_numpy()
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        gaps = np.diff(flat, prepend=0)
        gaps[first] = flat[first]
        width = np.ones(len(gaps), np.int64)
        for k in range(1, 9):
            width += gaps >= 1 << 7 * k
        ends = np.concatenate([[0], np.cumsum(width)])
        out = np.zeros(ends[-1], np.uint8)
        for k in range(int(width.max(initial=0))):
            some = np.flatnonzero(width > k)
            out[ends[some] + k] = (gaps[some] >> 7 * k & 127) | np.where(width[some] > k + 1, 128, 0)
        offsets = ends[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
        yield pa.record_batch([b.column(0), pa.array(sizes), packed], names=["src", "n", "packed"])


def _unpacked(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of packed lists, and their numbers one after the other."""
    ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    raw = np.frombuffer(lists.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    last = np.flatnonzero(raw < 128)
    start = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    gaps = raw[start].astype(np.int64) & 127
    for k in range(1, int((last - start).max(initial=0)) + 1):
        some = np.flatnonzero(last - start >= k)
        gaps[some] |= (raw[start[some] + k].astype(np.int64) & 127) << 7 * k
    upto = np.searchsorted(last, ends - ends[0])
    sizes, sums = np.diff(upto), np.concatenate([[0], np.cumsum(gaps)])
    return sizes, sums[1:] - np.repeat(sums[upto[:-1]], sizes)


def _slices(lists: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Where each slice begins, and its lists, of about SLICE bytes."""
    ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    at = 0
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
        yield at, lists.slice(at, to - at)
        at = to


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n) of rows (grp, kind, node, packed) sorted by grp and kind: the triangles of nodes, in parts.

    A group's own lists (kind 0) are held together; then each list that another
    node has sent (kind 1) is compared with those of its neighbours in the group.
    """
    grp, own, ready = None, [], None
    emit = lambda nodes, n: pa.record_batch([pa.array(nodes[n > 0], pa.int64()), pa.array(n[n > 0], pa.int64())], names=["node", "n"])

    def index():
        nodes = np.concatenate([x for x, _, _ in own])
        sizes = np.concatenate([x for _, x, _ in own])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        to = np.concatenate([x for _, _, x in own])
        own.clear()
        names = np.unique(to)
        flat = np.searchsorted(names, to).astype(np.int32)
        del to
        # whose lists name a node: positions of nodes, by the place of the node in names
        by = np.argsort(flat, kind="stable").astype(np.int32)
        holders = np.repeat(np.arange(len(nodes), dtype=np.int32), sizes)[by]
        first = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(names)))])
        return nodes, ends, names, flat, holders, first, np.zeros(len(nodes), np.int64), np.zeros(len(names), np.int64), np.zeros(len(names), bool)

    def done():
        if ready is not None:
            yield emit(ready[0], ready[6])
            yield emit(ready[2], ready[7])

    def compared(nodes, lists):
        _, ends, names, flat, holders, first, here, there, flag = ready
        sizes, sent = _unpacked(lists)
        spans, each = np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(nodes), np.int64)
        place = np.minimum(np.searchsorted(names, sent), len(names) - 1)
        known = names[place] == sent
        for i, v in enumerate(np.searchsorted(names, nodes).tolist()):
            mine = place[spans[i] : spans[i + 1]][known[spans[i] : spans[i + 1]]]
            if not len(mine):
                continue
            flag[mine] = True
            # in steps, as a node that many lists name has many places
            for lo in range(first[v], first[v + 1], 512):
                who = holders[lo : min(lo + 512, first[v + 1])]
                size = ends[who + 1] - ends[who]
                starts = np.cumsum(size) - size
                theirs = flat[np.arange(int(size.sum())) + np.repeat(ends[who] - starts, size)]
                hit = flag[theirs]
                n = np.add.reduceat(hit, starts, dtype=np.int64)
                here[who] += n
                each[i] += int(n.sum())
                if len(theirs) > len(names):
                    there += np.bincount(theirs[hit], minlength=len(names))
                else:
                    np.add.at(there, theirs[hit], 1)
            flag[mine] = False
        return emit(nodes, each)

    for b in batches:
        at = 0
        while at < b.num_rows:
            key = (b.column(0)[at].as_py(), b.column(1)[at].as_py())
            part = b.slice(at)
            g, k = part.column(0).to_numpy(), part.column(1).to_numpy()
            other = np.flatnonzero((g != key[0]) | (k != key[1]))
            part = part.slice(0, int(other[0]) if len(other) else part.num_rows)
            at += part.num_rows
            if key[0] != grp:
                yield from done()
                grp, own, ready = key[0], [], None
            nodes = part.column(2).to_numpy()
            for lo, lists in _slices(part.column(3)):
                mine = nodes[lo : lo + len(lists)]
                if key[1] == 0:
                    sizes, to = _unpacked(lists)
                    own.append((mine, sizes, to.astype(np.int32) if to.max(initial=0) < 1 << 31 else to))
                    continue
                if ready is None:
                    ready = index()
                yield compared(mine, lists)
    yield from done()


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, node) of rows (grp, packed): the nodes that a group's lists name, each once a slice."""
    for b in batches:
        groups = b.column(0).to_numpy()
        for lo, lists in _slices(b.column(1)):
            sizes, to = _unpacked(lists)
            of = np.repeat(groups[lo : lo + len(lists)], sizes)
            for g in np.unique(of):
                nodes = np.unique(to[of == g])
                yield pa.record_batch([pa.array(np.full(len(nodes), g, np.int32)), pa.array(nodes, pa.int64())], names=["grp", "node"])


def _numbered(deg: DataFrame) -> DataFrame:
    """deg with an id, 0, 1, 2 and so on in the order of the nodes, so that nodes with near names share a group."""
    deg = written(deg.repartitionByRange("node").sortWithinPartitions("node").withColumn("id", F.monotonically_increasing_id()), "clustering-nodes")
    part, at, before = F.shiftright("id", 33).cast("int"), 0, {}
    for r in deg.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        before[r.part], at = at, at + r.n
    starts = F.array(*[F.lit(before.get(i, 0)).cast("long") for i in range(max(before, default=0) + 1)])
    return deg.withColumn("id", starts[part] + F.col("id").bitwiseAND(F.lit((1 << 33) - 1)))


def clustering(e: DataFrame, group: int = GROUP) -> DataFrame:
    """(node, k, links, coefficient) over neighbours in either direction; self-loops left out.

    Edges point from the smaller degree to the larger, so no node points to more
    than the square root of twice the edges, and a hub's neighbours never pair
    with each other. Nodes are cut by range into groups of at most about
    ``group`` out-edges. A group keeps its nodes' lists, and each list goes once
    to every group that points to its node: what the ends of an edge share closes
    a triangle with it. So lists aren't repeated for each edge. They are packed,
    as where all nodes meet each goes to all groups, and groups come in rounds of
    one a core, so that the disk holds the lists as often as there are cores at most.
    """
    spark = e.sparkSession
    pairs = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    pairs = written(pairs, "clustering-pairs")
    free_shuffles(spark)
    deg = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("k"))
    deg = _numbered(written(deg, "clustering-degrees"))
    side = lambda x: deg.select(F.col("node").alias(x), F.col("k").alias("k" + x), F.col("id").alias("i" + x))
    ranked = pairs.join(side("a"), "a").join(side("b"), "b")
    lower = F.struct("ka", "ia") < F.struct("kb", "ib")
    up = ranked.select(F.when(lower, F.col("ia")).otherwise(F.col("ib")).alias("src"), F.when(lower, F.col("ib")).otherwise(F.col("ia")).alias("dst"))
    lists = up.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("to"))
    lists = written(lists.mapInArrow(_packed, "src long, n long, packed binary"), "clustering-lists")
    free_shuffles(spark)
    total, cores = lists.agg(F.sum("n")).first()[0] or 1, spark.sparkContext.defaultParallelism
    groups = max(-(-total // group), min(cores, total // LEAST))
    # the nodes at which so many shares of the edges are full, of at most a thousand ranges of nodes for each group
    last = lists.agg(F.max("src")).first()[0] or 0
    wide = max(1, last // (1000 * groups))
    ranges = lists.groupBy(F.floor(F.col("src") / wide).alias("r")).agg(F.sum("n").alias("n")) if groups > 1 else None
    upto = ranges.select("r", F.sum("n").over(Window.orderBy("r")).alias("upto")) if groups > 1 else None
    cuts = [r.c * wide for r in upto.groupBy(F.floor((F.col("upto") - 1) * groups / total)).agg(F.min("r").alias("c")).orderBy("c").collect()][1:] if groups > 1 else []
    grp = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), lambda c: c <= F.col("src")))
    lists = lists.withColumn("grp", grp)
    parts, done = int(spark.conf.get("spark.sql.shuffle.partitions")), []
    for lo in range(0, len(cuts) + 1, cores):
        own = lists.where(F.col("grp").between(lo, lo + cores - 1))
        named = own.select("grp", "packed").mapInArrow(_named, "grp int, node long").distinct()
        sends = named.join(lists.select(F.col("src").alias("node"), "packed"), "node")
        rows = own.select("grp", F.lit(0).alias("kind"), F.col("src").alias("node"), "packed").unionByName(sends.select("grp", F.lit(1).alias("kind"), "node", "packed"))
        each = rows.repartition(parts, "grp").sortWithinPartitions("grp", "kind").mapInArrow(_shared, "node long, n long")
        done.append(written(each.groupBy(F.col("node").alias("id")).agg(F.sum("n").alias("n")), "clustering-links"))
        free_shuffles(spark)
    per = reduce(DataFrame.unionByName, done).groupBy("id").agg(F.sum("n").alias("links"))
    out = deg.join(per, "id", "left").select("node", "k", F.coalesce("links", F.lit(0)).alias("links"))
    return out.withColumn("coefficient", F.when(F.col("k") < 2, F.lit(0.0)).otherwise(2.0 * F.col("links") / (F.col("k") * (F.col("k") - 1))))


def components(e: DataFrame) -> DataFrame:
    """(node, component) of the graph without directions."""
    loops = e.where("src = dst").select(F.col("src").alias("node"))
    c = connected_components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    alone = loops.distinct().join(c, "node", "left_anti").select("node", F.col("node").alias("component"))
    return c.unionByName(alone)


def component_sizes(e: DataFrame) -> DataFrame:
    return components(e).groupBy("component").agg(F.count("*").alias("size"))


def subclass_closure(g: DataFrame, predicate: str = SUBCLASS) -> DataFrame:
    """(sub, super) pairs in zero or more steps; safe in cycles."""
    e = g.where((F.col("p") == predicate) & (F.col("o_kind") == "iri")).select(F.col("s").alias("a"), F.col("o").alias("b"))
    nodes = e.select("a").unionByName(e.select(F.col("b").alias("a"))).distinct()
    return closure(e, nodes, True).select(F.col("a").alias("sub"), F.col("b").alias("super"))


def inferred_types(g: DataFrame) -> DataFrame:
    """Opt-in entailment: types along subclasses."""
    up = subclass_closure(g).where("sub <> super")
    t = g.where(F.col("p") == TYPE).join(up, F.col("o") == F.col("sub")).select("s", "s_kind", "p", F.col("super").alias("o"), "o_kind", "o_dt", "o_lang")
    return merge(g, t)


def max_depth(e: DataFrame) -> int:
    """The longest chain of child-to-parent edges in nodes, from the roots down, a root being 1; 0 without edges. A cycle that no root leads to adds nothing; another raises."""
    steps = longest(e.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    return steps + 1 if steps else 0


def individuals(g: DataFrame, namespace: str, schema_kinds: list[str]) -> DataFrame:
    """Typed subjects of a namespace that are not themselves of a schema kind."""
    typed = g.where(F.col("p") == TYPE)
    schema = typed.where(F.col("o").isin(schema_kinds)).select("s")
    return typed.where(F.col("s").startswith(namespace)).select("s").distinct().join(schema, "s", "left_anti")
