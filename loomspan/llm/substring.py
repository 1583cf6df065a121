"""Exact substring dedup by prefix-free parsing.

Every byte in a 100-byte string that also starts earlier in the corpus goes.

Rolling hashes of 50-byte grams set the triggers: of the grams inside each
100-byte string the leftmost smallest one is its trigger, which depends on the
string alone. A phrase is a trigger with the text that its strings cover; equal
strings lie at the same place of phrases with equal triggers, so phrases
(with that lookahead, as parsing of this kind keeps its overlaps) decide all
matches:

1. the parse: of a phrase's occurrences all but the first in corpus order are
   covered whole (phrases are told apart by 192 bits of three hashes);
2. the dictionary: the bytes of first occurrences of phrases that share a
   trigger with another phrase meet by trigger. They are sorted by their
   suffixes from the trigger on, and by their reversed prefixes before it; the
   lengths that neighbours have in common give, for each place of a string
   around the trigger, which phrases hold the same string, byte by byte, and
   of those the first in corpus order keeps it;
3. a trigger with one phrase has no other match.

So the suffixes that are sorted are those at triggers, a few for each phrase,
and not one for each byte of the dictionary; they are sorted bucket by bucket,
in memory. Both questions go through the bucket exchange (see packed): a batch
of texts names each phrase once, with its smallest document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.packed import by_bucket, packed, restored, squeezed, unpacked
from loomspan.llm.textops import BASE, UNBASE, lean, mixed, powers, prefix_hash, slices
from loomspan.session import written

LENGTH = 100
#: A second odd multiplier and its inverse modulo 2**64.
OTHER = 0xD1342543DE82EF95
UNOTHER = pow(OTHER, -1, 1 << 64)
GRAM = 50


def window_hashes(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all stretches of size bytes."""
    n = len(prefix) - 1 - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mixed((prefix[size:] - prefix[:n]) * powers(UNBASE, len(prefix))[:n])


def _other_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches that share nothing with the first kind but the bytes."""
    other = mixed(data.astype(np.uint64) + np.uint64(0x51ED270B))  # each byte is another random number
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(other * powers(OTHER, len(data)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(UNOTHER, len(sums))[starts])


def leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of width values the index of its leftmost smallest one."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, span = values, np.arange(len(values), dtype=np.int32), 1
    while 2 * span <= width:
        right = best[span:] < best[:-span]
        at = np.where(right, at[span:], at[:-span])
        best = np.where(right, best[span:], best[:-span])
        span *= 2
    shift = width - span
    right = best[shift : shift + n] < best[:n]
    return np.where(right, at[shift : shift + n], at[:n])


def phrases(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """The phrases of a run of texts: text index i, trigger hash, trigger place, first and last string start (places in data), and two hashes of the phrase."""
    gram = length // 2
    prefix = prefix_hash(data)
    grams = window_hashes(prefix, gram)
    trigger = leftmost_min(grams, length - gram + 1)
    starts = np.arange(len(trigger))
    owner = np.searchsorted(at, starts, side="right") - 1
    ok = starts + length <= at[owner + 1] if len(starts) else np.zeros(0, bool)
    starts, owner, trigger = starts[ok], owner[ok], trigger[ok]
    if not len(starts):
        return {k: np.zeros(0, np.int64) for k in ("i", "place", "lo", "hi")} | {k: np.zeros(0, np.uint64) for k in ("trigger", "phrase", "second")}
    new = np.append(True, (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1]))
    first = np.flatnonzero(new)
    lo, hi, place = starts[first], starts[np.append(first[1:], len(starts)) - 1], trigger[first].astype(np.int64)
    inverse = powers(UNBASE, len(prefix))
    body = (prefix[hi + length] - prefix[lo]) * inverse[lo]
    shape = (place - lo).astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64)
    return {"i": owner[first], "trigger": grams[place], "place": place, "lo": lo, "hi": hi, "phrase": mixed(mixed(body) + shape * np.uint64(BASE)), "second": mixed(_other_hash(data, lo, hi + length) + shape)}


def _batches(docs: DataFrame, kind: str, batch_bytes: int) -> DataFrame:
    """Rows of up to batch_bytes of text, compressed, with keys."""

    @lean
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in it:
            for i, j, data, at in slices(b.column(1), batch_bytes):
                number += 1
                cols = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(0).slice(i, j - i))]
                yield pa.record_batch([*cols, *[pa.array([x], pa.binary()) for x in (packed(at.astype(np.int64)), squeezed(data.tobytes(), 5))]], names=["batch", "keys", "at", "texts"])

    return docs.mapInArrow(work, f"batch long, keys array<{kind}>, at binary, texts binary")


def _orders(keys: list) -> np.ndarray:
    """Document order of a batch's keys; a null comes first."""
    return np.array([-(1 << 63) if k is None else int(k) for k in keys], np.int64)


def _firsts(names: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lead): rows sorted by names and corpus order, and which of them are the first of their name in the batch."""
    order = np.lexsort((start, doc, *reversed(names)))
    lead = np.ones(len(order), bool)
    if len(order):
        lead[1:] = np.logical_or.reduce([n[order][1:] != n[order][:-1] for n in names])
    return order, lead


def _parse(texts: bytes, at: np.ndarray, docs: np.ndarray, buckets: int, length: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """A batch's phrases; the indices of its first ones in request order, their bucket bounds, and the indices of the others."""
    p = phrases(np.frombuffer(texts, np.uint8), at, length)
    order, lead = _firsts([p["trigger"], p["phrase"], p["second"]], docs[p["i"]], p["lo"])
    first = order[lead]
    by, bounds = by_bucket(p["trigger"][first], buckets, p["phrase"][first])
    return p, first[by], bounds, order[~lead]


def _ask_phrases(buckets: int, length: int):
    @lean
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for number, keys, at, texts in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                docs = _orders(keys)
                p, first, bounds, _ = _parse(restored(texts), unpacked(at, np.int64), docs, buckets, length)
                sides = [p["trigger"][first], p["phrase"][first], p["second"][first], docs[p["i"][first]]]
                cuts = list(zip(bounds[:-1], bounds[1:], strict=True))
                cols = [pa.array(range(buckets), pa.int32()), pa.array([number] * buckets, pa.int64())]
                yield pa.record_batch(cols + [pa.array([packed(x[i:j]) for i, j in cuts], pa.binary()) for x in sides], names=["bucket", "batch", *"abcd"])

    return work


def _answer(t: pa.Table) -> pa.Table:
    """For each phrase in a request: 1 if another batch has it earlier, else 2 if its trigger has another phrase, else 0."""
    a, b, c = ([unpacked(x, np.uint64) for x in t.column(n).to_pylist()] for n in "abc")
    size = list(map(len, a))
    batch = np.repeat(t.column("batch").to_numpy(), size)
    doc = np.concatenate([unpacked(x, np.int64) for x in t.column("d").to_pylist()])
    a, b, c = map(np.concatenate, (a, b, c))
    order = np.lexsort((batch, doc, c, b, a))
    code = np.zeros(len(order), np.uint8)
    if len(order):
        changed = lambda x: np.append(True, x[order][1:] != x[order][:-1])
        new_a = changed(a)
        new = new_a | changed(b) | changed(c)
        group = np.cumsum(new_a) - 1
        kinds = np.bincount(group, new)
        code[order] = np.where(~new, 1, np.where(kinds[group] > 1, 2, 0))
    ends = np.cumsum([0, *size])
    return pa.table({"batch": t.column("batch"), "bucket": t.column("bucket"), "code": pa.array([packed(code[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})


def _codes(answers: pa.Table) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint8), *[unpacked(x, np.uint8) for x in answers.sort_by("bucket").column("code").to_pylist()]])


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all stretches, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _settle_phrases(buckets: int, length: int):
    """Covered stretches of a batch as (first string, number of strings), and its open phrases by bucket: before and after (how far the first string starts before the trigger, and the last), document, place, and the phrases' bytes."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        docs, at, raw = _orders(r["keys"]), unpacked(r["at"], np.int64), restored(r["texts"])
        p, first, bounds, rest = _parse(raw, at, docs, buckets, length)
        code = _codes(right)
        gone = np.concatenate([first[code == 1], rest])
        start, n = p["lo"][gone], p["hi"][gone] - p["lo"][gone] + 1
        entry = first[code == 2]
        cut = np.searchsorted(np.flatnonzero(code == 2), bounds)
        data = np.frombuffer(raw, np.uint8)
        lo, size = p["lo"][entry], p["hi"][entry] - p["lo"][entry] + length
        cols = {"batch": [r["batch"]], "start": [packed(start.astype(np.uint32))], "n": [packed(n.astype(np.uint32))]}
        sides = {"trigger": p["trigger"][entry], "before": (p["place"][entry] - lo).astype(np.uint16), "after": (p["place"][entry] - p["hi"][entry]).astype(np.uint16), "doc": docs[p["i"][entry]], "lo": lo.astype(np.uint32)}
        asked = [i for i in range(buckets) if cut[i + 1] > cut[i]]
        cols |= {"bucket": [asked]} | {k: [[packed(x[cut[i] : cut[i + 1]]) for i in asked]] for k, x in sides.items()}
        cols["bytes"] = [[squeezed(data[_flat(lo[cut[i] : cut[i + 1]], size[cut[i] : cut[i + 1]])].tobytes(), 5) for i in asked]]
        kinds = {"batch": pa.int64(), "bucket": pa.list_(pa.int32())}
        return pa.table({k: pa.array(v, kinds.get(k) or (pa.binary() if k in ("start", "n") else pa.list_(pa.binary()))) for k, v in cols.items()})

    return work


OPEN = ("trigger", "before", "after", "doc", "lo", "bytes")


def _classes(group: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows sorted by group and bytes, and how many leading bytes each sorted row shares with the one before it; -1 in another group."""
    width = texts.shape[1]
    order = np.lexsort((np.ascontiguousarray(texts).view(f"S{width}").ravel(), group)) if width else np.argsort(group, kind="stable")
    same = texts[order][1:] == texts[order][:-1]
    common = np.where(same.all(axis=1), width, same.argmin(axis=1)) if width else np.zeros(len(same), np.int64)
    return order, np.append(-1, np.where(group[order][1:] == group[order][:-1], common, -1))


def later_strings(trigger: np.ndarray, before: np.ndarray, after: np.ndarray, doc: np.ndarray, batch: np.ndarray, lo: np.ndarray, bodies: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(phrases, starts): the strings of length bytes of these phrases that an earlier phrase of the same trigger has at the same place around it.

    Phrase i has the strings that start before[i] .. after[i] bytes before the
    trigger; bodies holds all phrases' bytes. Corpus order is by doc, batch, lo.
    """
    before, after = before.astype(np.int64), after.astype(np.int64)
    size = before - after + length
    at = np.cumsum(size) - size
    reach = length // 2  # a string starts at most so far before its trigger, which is as long
    n = len(trigger)
    # what lies from the trigger on, and what lies before it, reversed; places beyond a phrase are zero and decide nothing
    right, left = np.zeros((n, length), np.uint8), np.zeros((n, reach), np.uint8)
    for side, have, first, step in ((right, length - after, at + before, 1), (left, before, at + before - 1, -1)):
        k = np.arange(side.shape[1])
        ok = k < have[:, None]
        side[ok] = bodies[(first[:, None] + step * k)[ok]]
    (by_right, ahead), (by_left, behind) = _classes(trigger, right), _classes(trigger, left)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((lo, batch, doc))] = np.arange(n)
    kind_right, kind_left = np.empty(n, np.int64), np.empty(n, np.int64)
    out = []
    for e in range(reach + 1):
        has = np.flatnonzero((after <= e) & (e <= before))
        if len(has) < 2:
            continue
        kind_right[by_right] = np.cumsum(ahead < length - e)
        kind_left[by_left] = np.cumsum(behind < e)
        order = has[np.lexsort((rank[has], kind_left[has], kind_right[has]))]
        again = order[1:][(kind_right[order][1:] == kind_right[order][:-1]) & (kind_left[order][1:] == kind_left[order][:-1])]
        out.append((again, lo[again] + before[again] - e))
    return out


def _answer_open(length: int):
    """The places of strings that go, for each batch that asked."""

    def work(t: pa.Table) -> pa.Table:
        cols = {k: [unpacked(x, kind) for x in t.column(k).to_pylist()] for k, kind in (("trigger", np.uint64), ("before", np.uint16), ("after", np.uint16), ("doc", np.int64), ("lo", np.uint32))}
        size = list(map(len, cols["trigger"]))
        flat = {k: np.concatenate(v) for k, v in cols.items()}
        asked = np.repeat(np.arange(len(size)), size)
        batch = np.repeat(t.column("batch").to_numpy(), size)
        bodies = np.concatenate([np.frombuffer(restored(x), np.uint8) for x in t.column("bytes").to_pylist()])
        ends = np.cumsum(flat["before"].astype(np.int64) - flat["after"] + length)
        order = np.argsort(flat["trigger"], kind="stable")
        names = flat["trigger"][order]
        edge = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        i = 0
        while i < len(order):  # some triggers at a time, each whole
            j = int(edge[k]) if (k := np.searchsorted(edge, i + (1 << 16))) < len(edge) else len(order)
            some = order[i:j]
            n = flat["before"][some].astype(np.int64) - flat["after"][some] + length
            own = bodies[_flat(ends[some] - n, n)]
            lo = flat["lo"][some].astype(np.int64)
            found += [(some[rows], starts) for rows, starts in later_strings(names[i:j], flat["before"][some], flat["after"][some], flat["doc"][some], batch[some], lo, own, length)]
            i = j
        rows, starts = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ([], [])))
        order = np.lexsort((starts, asked[rows]))
        cut = np.searchsorted(asked[rows][order], np.arange(len(size) + 1))
        starts = starts[order].astype(np.uint32)
        return pa.table({"batch": t.column("batch"), "start": pa.array([packed(starts[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    return work


def _kept(kind: str, length: int):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        at, raw = unpacked(r["at"], np.int64), restored(r["texts"])
        gone = np.zeros(len(raw) + 1, np.int32)
        for x, y in zip(right.column("start").to_pylist(), right.column("n").to_pylist(), strict=True):
            start = unpacked(x, np.uint32).astype(np.int64)
            n = unpacked(y, np.uint32).astype(np.int64) if y else np.ones(len(start), np.int64)
            np.add.at(gone, start, 1)
            np.add.at(gone, start + n + (length - 1), -1)
        gone = np.cumsum(gone)[:-1] > 0
        data = np.frombuffer(raw, np.uint8)
        rows = []
        for k in range(len(at) - 1):
            g = gone[at[k] : at[k + 1]]
            runs = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
            rows.append((len(g), int(g.sum()), runs, hashlib.sha256(data[at[k] : at[k + 1]][~g].tobytes()).hexdigest(), edge.reshape(-1, 2).tolist()))
        n, removed, spans, digest, where = zip(*rows, strict=True)
        cols = {"key": left.column("keys").combine_chunks().values, "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
        return pa.table(cols | {"kept_sha256": pa.array(digest), "spans": pa.array(where, pa.list_(pa.list_(pa.int64())))})

    return work, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"


def dedup_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id", batch_bytes: int = 4 << 20) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans): what stays of every whole text, spans as [start, end) bytes removed.

    Corpus order is by integer key, a null key first; rows of one key are
    ordered as they are read, so of wholly equal rows one stays. Keys of
    another type raise ValueError. A null text is empty; extra columns are
    ignored; an empty table gives an empty result. Phrases are compared by 192
    bits of hash, and strings by their bytes.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} is of type {kind}: the corpus order needs whole numbers")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    held = written(_batches(rows, kind, batch_bytes), "substring-batches")
    asked = held.mapInArrow(_ask_phrases(buckets, LENGTH), "bucket int, batch long, a binary, b binary, c binary, d binary")
    told = asked.groupBy("bucket").applyInArrow(_answer, "batch long, bucket int, code binary")
    settle = _settle_phrases(buckets, LENGTH)
    many = ", ".join(f"{c} array<binary>" for c in OPEN)
    opened = held.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(lambda a, b: settle(a, b), f"batch long, start binary, n binary, bucket array<int>, {many}")
    opened = written(opened, "substring-phrases")
    each = opened.select("batch", F.explode(F.arrays_zip("bucket", *OPEN)).alias("x")).select("batch", "x.*")
    later = each.groupBy("bucket").applyInArrow(_answer_open(LENGTH), "batch long, start binary")
    marks = opened.select("batch", "start", "n").unionByName(later.select("batch", "start", F.lit(None).cast("binary").alias("n")))
    keep, schema = _kept(kind, LENGTH)
    out = held.groupBy("batch").cogroup(marks.groupBy("batch")).applyInArrow(lambda a, b: keep(a, b), schema)
    return out.withColumnRenamed("key", key)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
