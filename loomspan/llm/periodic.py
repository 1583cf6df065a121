"""Periodic runs of words, found by a scan over all lags.

A document's word ids are compared with themselves shifted by every lag up to
a third of its length (n / min_exp), and true stretches are run-length coded.
A stretch long enough for lag q holds at least 2q equal places in a row, so it
holds one of the places 0, q, 2q, ...: from lag 8 on only these places are
compared first (by hashes of 8 words, which such a stretch fills there), and
only around hits the stretch is measured on the ids themselves. So a scan of
all lags takes n log n steps, and none of them is left out.

A stretch's smallest period divides its lag, as the stretch is at least three
lags long, so it is found by taking prime factors out. Batches of short
documents are scanned together, a lag at a time; a long document's lags are
dealt in ranges to tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.textops import SPACE, exact_words, lean, mixed, runs, slices
from loomspan.session import written

#: Words of the grams that are compared at one place in each lag.
GRAM = 8
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_ids(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word ids, word offsets of the texts) of a run of texts; equal ids are equal bytes."""
    inside = ~SPACE[data]
    starts, ends = runs(inside, at)
    return exact_words(data, inside, starts, ends)[0].astype(np.uint32), np.searchsorted(starts, at)


def _factors(n: int) -> list[int]:
    """The prime factors of n, each once."""
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] * (n > 1)


def smallest_period(ids: np.ndarray, start: int, end: int, lag: int) -> int:
    """The smallest period of ids[start:end], which has the period lag and is at least two lags long."""
    for f in _factors(lag):
        while lag % f == 0 and np.array_equal(ids[start : end - lag // f], ids[start + lag // f : end]):
            lag //= f
    return lag


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading places of two arrays of one length agree."""
    at, size = 0, 64
    while at < len(a):
        same = a[at : at + size] == b[at : at + size]
        if not same.all():
            return at + int(same.argmin())
        at, size = at + size, size * 2
    return len(a)


def stretch_at(ids: np.ndarray, place: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The widest [start, end) within [low, high) around place whose words agree with those a lag on, end counting the lag."""
    right = _reach(ids[place : high - lag], ids[place + lag : high])
    left = _reach(ids[low:place][::-1], ids[low + lag : place + lag][::-1])
    return place - left, place + right + lag


class _Known:
    """Stretches that are found already, so that their other multiples aren't measured again."""

    def __init__(self):
        self.start, self.end, self.period = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, found: list[tuple[int, int, int]], lag: int) -> None:
        live = self.end - self.start > lag
        new = np.array(found, np.int64).reshape(-1, 3).T
        self.start, self.end, self.period = (np.concatenate([old[live], n]) for old, n in zip((self.start, self.end, self.period), new, strict=True))

    def unknown(self, places: np.ndarray, lag: int) -> np.ndarray:
        """The ascending places that lie in no known stretch with a period that divides the lag."""
        use = (lag % self.period == 0) & (self.end - self.start > lag) if len(self.period) else np.zeros(0, bool)
        if not use.any():
            return places
        cover = np.zeros(len(places) + 1, np.int64)
        np.add.at(cover, np.searchsorted(places, self.start[use]), 1)
        np.add.at(cover, np.searchsorted(places, self.end[use] - lag), -1)
        return places[np.cumsum(cover)[:-1] <= 0]


def scan(ids: np.ndarray, bounds: np.ndarray, low: int = 1, high: int | None = None, least: int = 24, exponent: int = 3) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of all runs with a lag in [low, high) in texts given by word ids and offsets, starts counted in each text."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")  # for each lag the texts that are long enough lie in front
    sizes = sizes[order]
    ends = np.cumsum(sizes)
    ids = np.concatenate([ids[bounds[k] : bounds[k + 1]] for k in order]) if len(order) else ids
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    grams = np.zeros(max(len(ids) - GRAM + 1, 0), np.uint64)
    for k in range(GRAM):
        grams = mixed(grams + ids[k : k + len(grams)].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    longest = int(sizes[0]) // exponent if len(sizes) else 0
    known, out = _Known(), set()

    def note(hits: list[tuple[int, int]], lag: int) -> None:
        good = [(s, e, smallest_period(ids, s, e, lag)) for s, e in hits if e - s >= max(least, exponent * lag)]
        if good:
            known.add(good, lag)
            out.update(good)

    for lag in range(low, min(longest + 1, high or longest + 1)):
        texts = int(np.searchsorted(-sizes, -max(least, exponent * lag), side="right"))
        cut = int(ends[texts - 1]) if texts else 0
        if not cut:
            break
        if lag < GRAM:
            same = np.zeros(cut, bool)
            same[:-lag] = (ids[: cut - lag] == ids[lag:cut]) & (owner[: cut - lag] == owner[lag:cut])
            first, last = runs(same, np.array([0, cut]))
            big = last - first >= max(least - lag, (exponent - 1) * lag)
            note([(int(s), int(e) + lag) for s, e in zip(first[big], last[big], strict=True)], lag)
            continue
        places = grams[:cut:lag]
        places = np.flatnonzero(places[1:] == places[:-1]) * lag
        if len(places):
            places = places[(places + lag < cut)]
            places = known.unknown(places[owner[places] == owner[places + lag]], lag)
            found, done = [], -1
            for p in places.tolist():
                if p >= done:
                    t = owner[p]
                    s, e = stretch_at(ids, p, lag, int(ends[t] - sizes[t]), int(ends[t]))
                    done = e - lag
                    found.append((s, e))
            note(found, lag)
    return sorted((int(order[t := owner[s]]), int(s - (ends[t] - sizes[t])), int(e - s), int(q)) for s, e, q in out)


def _collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run repeats after its first period."""
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    start, length, period = np.array(found, np.int64).T
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    return b" ".join(w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if g <= 0)


def _result(keys: list[pa.Array], texts: list[list[bytes]], found: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    rows = [[{"start": s, "length": n, "period": q} for s, n, q in sorted(f, key=lambda r: (r[0], r[2]))] for f in found]
    kept = pa.array([_collapsed(w, f) for w, f in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
    return pa.record_batch([pa.concat_arrays(keys), pa.array([len(w) for w in texts], pa.int64()), pa.array(rows, RUNS), kept], names=["key", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 24, exponent: int = 3, long_bytes: int = 1 << 16, lags: int = 2048) -> DataFrame:
    """(key, n_words, runs, collapsed) of every whole text: runs lists (start, length, period) by start and period, collapsed is the text without repeats.

    A run is a stretch of consecutive words, extended by no neighbour, with the
    smallest period q and at least max(least, exponent * q) words; exponent is
    3 at least. collapsed joins by one space the words that no run holds after
    its first period. Words lie between ASCII white space.

    A null, empty or blank text has no words, no runs and an empty collapsed
    text; repeated rows give repeated results, a null key stays null; extra
    columns are ignored; an empty table gives an empty result. Texts of
    long_bytes or more are dealt in ranges of ``lags`` lags.
    """
    if exponent < 3 or least < 2 * GRAM + GRAM:
        raise ValueError("the scan needs an exponent of 3 and 24 words at least")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    big = F.octet_length("text") >= long_bytes

    @lean
    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, j, data, at in slices(b.column(1)):
                found: list[list] = [[] for _ in range(j - i)]
                for t, *run in scan(*word_ids(data, at), least=least, exponent=exponent):
                    found[t].append(tuple(run))
                raw = data.tobytes()
                yield _result([b.column(0).slice(i, j - i)], [raw[x:y].split() for x, y in zip(at[:-1], at[1:], strict=True)], found)

    @lean
    def ranged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(b.num_rows):
                for _, _, data, at in slices(b.column(1).slice(k, 1)):
                    low = b.column(2)[k].as_py() * lags + 1
                    found = scan(*word_ids(data, at), low, low + lags, least, exponent)
                    cols = list(zip(*found, strict=True))[1:] or [(), (), ()]
                    yield pa.record_batch([pa.array([b.column(0)[k].as_py()] * len(found), pa.string()), *[pa.array(c, pa.int64()) for c in cols]], names=["row", "start", "length", "period"])

    @lean
    def finished(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, j, data, at in slices(b.column(1)):
                raw = data.tobytes()
                found = [[(r["start"], r["length"], r["period"]) for r in f or []] for f in b.column(2).slice(i, j - i).to_pylist()]
                yield _result([b.column(0).slice(i, j - i)], [raw[x:y].split() for x, y in zip(at[:-1], at[1:], strict=True)], found)

    short = rows.where(~big).mapInArrow(whole, schema)
    longs = rows.where(big).withColumn("row", F.sha2("text", 256))
    ranges = F.ceil(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) / F.lit(exponent * lags)).cast("int")
    dealt = longs.dropDuplicates(["row"]).select("row", "text", F.explode(F.sequence(F.lit(0), F.greatest(ranges, F.lit(1)) - 1)).alias("range"))
    found = dealt.repartition(parts, "row", "range").mapInArrow(ranged, "row string, start long, length long, period long").distinct()
    per_text = found.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    long_ones = longs.join(written(per_text, "periodic-runs"), "row", "left").select("key", "text", "runs").mapInArrow(finished, schema)
    return short.unionByName(long_ones).withColumnRenamed("key", key)


def _stuttered(docs: DataFrame) -> DataFrame:
    """documents with the words of each tenth text, by crc32 of its key, repeated from some word on as the query's contract fixes it."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  f(x) with x computed once

    def moved(w: Column) -> Column:
        n, g = F.greatest(F.size(w), F.lit(1)).cast("long"), F.floor(h / 10)
        a = F.pmod(g, n)
        ap = F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).alias("p"))
        place = lambda i, x: F.when(i >= x["a"], x["a"] + (i - x["a"]) % x["p"]).otherwise(i).cast("int")
        return let(ap, lambda x: F.array_join(F.transform(w, lambda _, i: F.get(w, place(i, x))), " "))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    some = (h % 10 == 0) & F.col("text").isNotNull()
    return docs.select("doc_id", F.when(some, let(words, moved)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    out = periodic_runs(_stuttered(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # runs come by start and period, so the first of the greatest is the one asked for
    best = F.aggregate("runs", none, lambda m, r: F.when(m.isNull() | (r["length"] * m["period"] > m["length"] * r["period"]), r).otherwise(m))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * best.length) div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
