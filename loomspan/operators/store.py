"""An indexed triple store: terms as 64-bit ids, tables bucketed by subject and by object, and statistics that order joins.

The dictionary gives each distinct term an id, the hash of its four parts; terms
whose hashes meet are hashed anew with a number until all ids differ, so equal
ids are equal terms. The triples (p, s, o, literal) are held twice, bucketed by
s and by o into one file a bucket, sorted by predicate; the dictionary is
bucketed by id. So patterns about one subject join without an exchange, and a
scan reads the files' parts of its predicate.

A query's variables stay ids until an expression or the result needs the term:
joins compare longs, DISTINCT and COUNT work on ids, and a filter on one
variable is evaluated once for each distinct term of the dictionary.

The order of patterns is by cost: the subjects that have all predicates of a
star are counted from characteristic sets, other joins are estimated by the
numbers of distinct subjects and objects.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.sparql import Engine, Solutions, _used, _variables, evaluate
from loomspan.session import free_shuffles, scratch, written
from loomspan.terms import TYPE

TERM = ("v", "k", "dt", "lang")
#: Characteristic sets and classes that the statistics keep, the most frequent ones; the order of joins alone depends on them.
KEPT = 10_000
#: A table of triples is dealt in rounds, each of which holds the shuffle files of its buckets alone: one for each so many terms, and so many at most.
ROUND, ROUNDS = 1_000_000, 4
#: Terms that a task holds to leave out repeats before they move.
HELD = 400_000


def term_id(v: Column, k: Column, dt: Column, lang: Column, bits: int = 64, salt: Column | None = None) -> Column:
    """The hash of a term's parts; fewer bits make hashes meet, for tests."""
    none = lambda c: F.coalesce(c, F.lit(""))
    h = F.xxhash64(v, k, none(dt), none(lang), *([salt] if salt is not None else []))
    return h if bits == 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


@dataclass
class Statistics:
    """Counts of predicates (triples, distinct subjects, distinct objects), of classes, and of characteristic sets."""

    predicates: dict[str, tuple[int, int, int]] = field(default_factory=dict)
    classes: dict[str, int] = field(default_factory=dict)
    sets: list[tuple[frozenset, int]] = field(default_factory=list)

    def size(self, t: tuple) -> float:
        """Estimated solutions of one pattern."""
        s, p, _, o = t
        if p[0] != "iri":
            n, ds, do = (sum(x[i] for x in self.predicates.values()) for i in range(3))
        else:
            n, ds, do = self.predicates.get(p[1], (0, 1, 1))
        if o[0] != "var":
            n = self.classes.get(o[1], 0) if p[:2] == ("iri", TYPE) and len(self.classes) < KEPT else n / max(do, 1)
        return n / max(ds, 1) if s[0] != "var" else n

    def star(self, predicates: frozenset) -> float:
        """Subjects that have all the predicates."""
        return sum(n for have, n in self.sets if predicates <= have)

    def joined(self, size: float, chosen: list[tuple], t: tuple) -> float:
        """Estimated solutions when a pattern is joined to the chosen ones, which have ``size``."""
        known = {x[1] for c in chosen for x in (c[0], c[1], c[3]) if x[0] == "var"}
        s, p, _, o = t
        own = self.size(t)
        _, ds, do = self.predicates.get(p[1], (0, 1, 1)) if p[0] == "iri" else (0, 1, 1)
        if s[0] == "var" and s[1] in known:
            star = frozenset(c[1][1] for c in chosen if c[0] == s and c[1][0] == "iri" and not c[2])
            if star and p[0] == "iri":
                have = self.star(star)
                out = size * (self.star(star | {p[1]}) / have if have else 0) * (self.size((s, p, "", ("var", ""))) / max(ds, 1)) * (own / max(self.size((s, p, "", ("var", ""))), 1e-9) if o[0] != "var" else 1)
            else:
                out = size * own / max(ds, 1)
            return out / max(do, 1) if o[0] == "var" and o[1] in known else out
        if o[0] == "var" and o[1] in known:
            return size * own / max(do, 1)
        return size * own


@dataclass
class Store:
    """The tables of a store and its statistics. ``close`` forgets the tables; their files stay."""

    spark: SparkSession
    folder: str
    names: dict[str, str]
    statistics: Statistics
    clashing: bool

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name])

    def id_of(self, t: tuple) -> Column:
        """The id of a constant. One that the store doesn't have gets its hash, which is no term's id while no two terms share one, or else null."""
        value = [F.lit(x).cast("string") for x in (t[1], t[0], t[2], t[3])]
        if not self.clashing:
            return term_id(*value)
        same = self.table("terms").where(F.col("v").eqNullSafe(value[0]) & F.col("k").eqNullSafe(value[1]) & F.col("dt").eqNullSafe(value[2]) & F.col("lang").eqNullSafe(value[3]))
        got = same.select("id").first()
        return F.lit(got.id if got else None).cast("long")

    def sparql(self, text: str, lexical: bool = True) -> DataFrame:
        return StoreEngine(self).run(text, lexical)

    def close(self) -> None:
        for name in self.names.values():
            self.spark.sql(f"drop table if exists {name}")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of triples; one that comes again nearby is left out."""
    names, schema, held, size = list(TERM), pa.schema([(c, pa.string()) for c in TERM]), [], 0
    distinct = lambda x: x.group_by(names, use_threads=False).aggregate([]).select(names)
    for b in batches:
        s, kind, p, *o = (x.cast(pa.string()) for x in b.columns)
        none = pa.nulls(len(s), pa.string())
        for cols in ([s, kind, none, none], [p, pa.array(["iri"] * len(p), pa.string()), none, none], o):
            held.append(distinct(pa.table(cols, schema=schema)))
            size += held[-1].num_rows
        if size > HELD:
            held = [distinct(pa.concat_tables(held))]
            size = held[0].num_rows
            if size > HELD // 2:
                yield from held[0].to_batches()
                held, size = [], 0
    if held:
        yield from distinct(pa.concat_tables(held)).to_batches()


def _told_apart(hashed: DataFrame, bits: int) -> DataFrame:
    """(id, v, k, dt, lang) of terms some of which have one hash as their id."""
    order = F.struct(*[F.coalesce(F.col(c), F.lit("")) for c in TERM])
    done = hashed.withColumn("_o", order)
    first = done.groupBy("id").agg(F.min("_o").alias("_first"))
    # of terms with one hash the first keeps it, the others draw again until theirs is free
    kept = written(done.join(first, "id").where("_o = _first").select("id", *TERM), "store-kept")
    rest = written(done.join(first, "id").where("_o <> _first").select(*TERM), "store-rest")
    for salt in range(1, 200):
        drawn = rest.withColumn("id", term_id(*map(F.col, TERM), bits, F.lit(salt))).join(kept.select("id"), "id", "left_anti").withColumn("_o", order)
        win = drawn.groupBy("id").agg(F.min("_o").alias("_first"))
        new = written(drawn.join(win, "id").where("_o = _first").select("id", *TERM), "store-kept")
        rest = written(rest.withColumn("_o", order).join(new.select(order.alias("_o")), "_o", "left_anti").select(*TERM), "store-rest")
        kept = kept.unionByName(new)
        if rest.isEmpty():
            return written(kept, "store-terms")
    raise RuntimeError("the ids have too few bits for these terms")


TABLES = {"terms": ("id", ("id",), "id bigint, v string, k string, dt string, lang string"), "by_s": ("s", ("p", "s"), "p bigint, s bigint, o bigint, literal boolean"), "by_o": ("o", ("p", "o", "s"), "p bigint, s bigint, o bigint, literal boolean")}


def _bucketed(df: DataFrame, table: str, folder: str, buckets: int, rounds: int = 1) -> str:
    """A table of one file for each bucket, or more where an object has very many triples. Each round writes other buckets."""
    by, order, _ = TABLES[table]
    name = f"loomspan_{table}_{uuid.uuid4().hex[:12]}"
    for r in range(rounds):
        some = df if rounds == 1 else df.where(F.pmod(F.pmod(F.hash(by), F.lit(buckets)), F.lit(rounds)) == r)
        # equal triples meet in a bucket; the object table comes from distinct rows, and its large buckets are split
        dealt = some.hint("rebalance", buckets, by) if table == "by_o" else some.repartition(buckets, by).distinct()
        out = dealt.write.format("parquet").mode("append" if r else "overwrite").bucketBy(buckets, by).sortBy(*order).option("path", f"{folder}/{table}")
        # sorted ids are written as differences
        out.option("compression", "zstd").option("parquet.writer.version", "v2").saveAsTable(name)
        free_shuffles(df.sparkSession)
    return name


def build_store(g: DataFrame, folder: str | None = None, buckets: int | None = None, bits: int = 64) -> Store:
    """A store of a triple table, in a folder of the shared file system (a fresh one under the scratch folder if none is given).

    Repeated triples count once: they meet by their ids, so no exchange moves
    their strings. A row with a null subject, predicate or object is left out;
    an empty table gives a store without solutions. ``buckets`` is the number
    of shuffle partitions if not given. ``g`` is read once for the terms and
    once for each round of the triples and not written beside the store, so it
    must give the same rows each time.
    """
    spark = g.sparkSession
    folder = folder or scratch(spark, "store")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    null = F.lit(None).cast("string")
    whole = [c for c in ("s", "s_kind", "p", "o", "o_kind")]
    rows = g.where(" and ".join(f"{c} is not null" for c in whole))
    parts = {"s": (F.col("s"), F.col("s_kind"), null, null), "p": (F.col("p"), F.lit("iri"), null, null), "o": (F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"))}
    named = lambda cols: [c.alias(n) for c, n in zip(cols, TERM, strict=True)]
    terms = rows.select("s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang").mapInArrow(_once, "v string, k string, dt string, lang string")
    names = {"terms": _bucketed(terms.withColumn("id", term_id(*map(F.col, TERM), bits)).select("id", *TERM), "terms", folder, buckets)}
    terms = spark.table(names["terms"])
    clashing = not terms.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if clashing:
        terms = _told_apart(written(terms, "store-terms"), bits)
        spark.sql(f"drop table {names['terms']}")
        names["terms"] = _bucketed(terms, "terms", folder, buckets)
        terms = spark.table(names["terms"])
    rounds = min(ROUNDS, buckets, terms.count() // ROUND + 1)
    if not clashing:
        coded = rows.select(*[term_id(*parts[n], bits).alias(n) for n in ("p", "s", "o")], (F.col("o_kind") == "literal").alias("literal"))
    else:
        coded = rows.select(*[F.struct(*named(c)).alias(n) for n, c in parts.items()], (F.col("o_kind") == "literal").alias("literal"))
        for n in parts:
            ids = terms.select(F.col("id").alias(f"_{n}"), *[F.col(c).alias(f"_{c}") for c in TERM])
            same = [coded[n][c].eqNullSafe(ids[f"_{c}"]) for c in TERM]
            coded = coded.join(ids, same).drop(*[f"_{c}" for c in TERM])
        coded = coded.select(F.col("_p").alias("p"), F.col("_s").alias("s"), F.col("_o").alias("o"), "literal")
    names["by_s"] = _bucketed(coded, "by_s", folder, buckets, 1 if clashing else rounds)
    names["by_o"] = _bucketed(spark.table(names["by_s"]), "by_o", folder, buckets, rounds)
    spark.createDataFrame([(buckets, clashing)], "buckets int, clashing boolean").coalesce(1).write.parquet(f"{folder}/about")
    _write_statistics(Store(spark, folder, names, Statistics(), clashing))
    return Store(spark, folder, names, _read_statistics(spark, folder), clashing)


def open_store(spark: SparkSession, folder: str) -> Store:
    """A store that build_store has written, without reading its triples."""
    about = spark.read.parquet(f"{folder}/about").first()
    names = {}
    for table, (by, order, columns) in TABLES.items():
        names[table] = f"loomspan_{table}_{uuid.uuid4().hex[:12]}"
        spark.sql(f"create table {names[table]} ({columns}) using parquet options (path '{folder}/{table}') clustered by ({by}) sorted by ({', '.join(order)}) into {about.buckets} buckets")
    return Store(spark, folder, names, _read_statistics(spark, folder), about.clashing)


def _write_statistics(store: Store) -> None:
    """Counts by predicate, by class, and by characteristic set, beside the tables."""
    by_s, terms = store.table("by_s"), store.table("terms")
    text = terms.select(F.col("id").alias("p"), F.col("v").alias("name"))
    each = by_s.groupBy("p").agg(F.count("*").alias("n"), F.approx_count_distinct("s").alias("ds"), F.approx_count_distinct("o").alias("do")).join(text, "p")
    each.select("name", "n", "ds", "do").write.parquet(f"{store.folder}/predicates")
    classes = by_s.where(F.col("p") == store.id_of(("iri", TYPE, None, None))).groupBy("o").agg(F.count("*").alias("n"))
    classes.join(text.select(F.col("p").alias("o"), "name"), "o").select("name", "n").orderBy(F.desc("n"), "name").limit(KEPT).write.parquet(f"{store.folder}/classes")
    sets = by_s.select("s", "p").distinct().groupBy("s").agg(F.array_sort(F.collect_list("p")).alias("ps")).groupBy("ps").agg(F.count("*").alias("n"))
    top = sets.orderBy(F.desc("n"), "ps").limit(KEPT).select("ps", "n", F.explode("ps").alias("p"))
    top.join(text, "p").groupBy("ps", "n").agg(F.collect_list("name").alias("names")).select("n", "names").write.parquet(f"{store.folder}/sets")


def _read_statistics(spark: SparkSession, folder: str) -> Statistics:
    rows = lambda name: spark.read.parquet(f"{folder}/{name}").limit(KEPT).collect()
    return Statistics({r.name: (r.n, r.ds, r.do) for r in rows("predicates")}, {r.name: r.n for r in rows("classes")}, [(frozenset(r.names), r.n) for r in rows("sets")])


class StoreEngine(Engine):
    """Queries over a store; variables are ids until their terms are needed."""

    def __init__(self, store: Store) -> None:
        self.store = store
        self.g = store.table("by_s")

    def edges(self, p: tuple) -> DataFrame:
        return self.g.where((F.col("p") == self.constant(p)) & ~F.col("literal")).select(F.col("s").alias("a"), F.col("o").alias("b"))

    def nodes(self) -> DataFrame:
        return self.g.select(F.col("s").alias("a")).unionByName(self.store.table("by_o").select(F.col("o").alias("a")))

    def constant(self, t: tuple) -> Column:
        return self.store.id_of((*t, None, None)[:4])

    def scan(self, t: tuple, known: Solutions | None = None) -> Solutions:
        s, p, path, o = t
        if path:
            out = self._path(s, p, path, o, self._ids(known or Solutions(None, [], set()), {x[1] for x in (s, o) if x[0] == "var"}))
            return Solutions(out.df, out.names, out.sure, set(out.names))
        bound = set(known.names) if known else set()
        # by the side that the join is on, or by object if the constant leaves few of the predicate's triples: those are cheaper to move than all are to read
        stats = self.store.statistics
        few = o[0] != "var" and stats.size(t) * 8 <= stats.size((s, p, path, ("var", "")))
        side = "by_o" if s[0] == "var" and s[1] not in bound and (few or o[0] == "var" and o[1] in bound) else "by_s"
        df, cols = self.store.table(side), {}
        for term, col in ((p, "p"), (s, "s"), (o, "o")):
            if term[0] != "var":
                df = df.where(F.col(col) == self.constant(term))
            elif term[1] in cols:
                df = df.where(F.col(col) == F.col(cols[term[1]]))
            else:
                cols[term[1]] = col
        return Solutions(df.select(*[F.col(c).alias(n) for n, c in cols.items()], *([] if cols else [F.lit(1).alias("_one")])), list(cols), set(cols), set(cols))

    def _ids(self, s: Solutions, names: set[str]) -> Solutions:
        """The solutions with these variables as ids; a term that the store doesn't have is null, as no path leads from it."""
        for n in [n for n in s.names if n in names and n not in s.raw]:
            ids = self.store.table("terms").select(F.col("id").alias("_id"), F.struct(*TERM).alias("_t"))
            rest = [F.col(c) for c in s.df.columns if c != n]
            same = [F.col(n)[c].eqNullSafe(F.col("_t")[c]) for c in TERM]
            s = Solutions(s.df.join(ids, same, "left").select(*rest, F.col("_id").alias(n)), s.names, s.sure, s.raw | {n})
        return s

    def terms(self, s: Solutions, names: set[str]) -> Solutions:
        for n in [n for n in s.names if n in names and n in s.raw]:
            own = self.store.table("terms").select(F.col("id").alias("_id"), F.struct(*TERM).alias("_t"))
            rest = [F.col(c) for c in s.df.columns if c != n]
            df = s.df.join(own, F.col(n) == F.col("_id"), "inner" if n in s.sure else "left").select(*rest, F.col("_t").alias(n))
            s = Solutions(df, s.names, s.sure, s.raw - {n})
        return s

    def _filter(self, s: Solutions, e: tuple) -> Solutions:
        used = _used(e) & set(s.names)
        if len(used) == 1 and used <= s.raw & s.sure:
            n = next(iter(used))
            good = self.store.table("terms").select("id", F.struct(*TERM).alias(n)).where(evaluate(e, used).truth()).select(F.col("id").alias("_id"))
            return Solutions(s.df.join(good, F.col(n) == F.col("_id"), "left_semi"), s.names, s.sure, s.raw)
        return super()._filter(s, e)

    def ordered(self, parts: list, names: set[str]) -> list:
        """Neighbouring patterns by estimated cost: the smallest first, then always the one that leaves the fewest solutions; paths wait until an end is bound."""
        stats, out, run = self.store.statistics, [], []

        def flush() -> None:
            known = set(names) | {v for kind, *rest in out for v in _variables(kind, rest)}
            chosen, size = [], 1.0
            while run:
                touching = [i for i, (_, t) in enumerate(run) if {x[1] for x in (t[0], t[1], t[3]) if x[0] == "var"} & known or not known]
                cost = lambda i: (bool(run[i][1][2]), stats.joined(size, chosen, run[i][1]) if chosen else stats.size(run[i][1]), i)  # noqa: E731, B023
                at = min(touching or range(len(run)), key=cost)
                size = max(cost(at)[1], 1e-3)
                part = run.pop(at)
                chosen.append(part[1])
                out.append(part)
                known |= {x[1] for x in (part[1][0], part[1][1], part[1][3]) if x[0] == "var"}

        for part in parts:
            if part[0] == "triple":
                run.append(part)
            else:
                flush()
                out.append(part)
        flush()
        return out
