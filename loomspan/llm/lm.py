"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of bigrams, unigrams and the uniform distribution
are mixed. The weight of the bigram estimate depends on the frequency bucket
of its context, and all weights come from expectation-maximisation on counts
held out of the estimates: one part of the training documents, whose own counts
are taken off the corpus counts while the weights are fitted.

Counts are exact over the whole corpus and are never brought to one place: a
batch of documents asks for the counts of its distinct words and bigrams
bucket by bucket (see packed), and gets them back for its tokens. The weights
are fitted on histograms of likelihood ratios, a few thousand numbers at any
corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.packed import by_bucket, packed, packed_steps, unpacked, unpacked_steps
from loomspan.llm.textops import SPACE, lean, lowered, mixed, prefix_hash, runs, slices, stretch_hash
from loomspan.llm.toxicity import fold
from loomspan.session import written

END, BEGIN = np.uint64(0x8F1BBCDCBFA53E0B), np.uint64(0xCA62C1D6E7A9F3B5)
TEST, HELD = 2, 3
#: Likelihood ratios in steps of 1/16 in the natural logarithm; the first bin is ratio zero.
STEP, LEAST, BINS = 1 / 16, -40.0, 1602


def tokens_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of words and ends, offsets) of a run of texts."""
    low = lowered(data)
    starts, ends = runs(~SPACE[low], at)
    bounds = np.searchsorted(starts, at)
    words = stretch_hash(prefix_hash(low), starts, ends)
    return np.insert(words, bounds[1:], END), bounds + np.arange(len(at))


def _pairs(idx: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Each token's bigram as previous * (n + 1) + own index; index n stands for the beginning."""
    before = np.empty(len(idx), np.uint64)
    before[1:] = idx[:-1]
    before[at[:-1]] = n
    return before * np.uint64(n + 1) + idx


def _pair_keys(pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
    n = np.uint64(len(words) + 1)
    ext = np.append(words, BEGIN)
    return mixed(ext[pairs // n] * np.uint64(0x9FB21C651E98DF25) + ext[pairs % n])


def batches_of(docs: DataFrame, text: str, key: str, batch_bytes: int) -> DataFrame:
    """Rows of up to batch_bytes of text: keys, folds, token offsets, distinct words, and each token's index among them."""
    kind = docs.schema[key].dataType.simpleString()

    @lean
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for b in it:
            for i, j, data, at in slices(b.column(2), batch_bytes):
                toks, offs = tokens_of(data, at)
                words, idx, n = np.unique(toks, return_inverse=True, return_counts=True)
                # frequent words first, by powers of two, so that indices compress; within a power by hash, so that hashes do
                order = np.lexsort((words, -np.floor(np.log2(n))))
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                words, idx = words[order], rank[idx]
                folds = np.array(b.column(1).slice(i, j - i).to_pylist(), np.uint8)
                keys = b.column(0).slice(i, j - i)
                # a batch is named by its place and its content: if a lost executor's rows come back in another order, no answer of before is taken for them
                number += 1
                name = xxhash.xxh64_intdigest(data, part << 32 | number) >> 1
                cols = [pa.array([name], pa.int64()), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), keys)]
                cols += [pa.array([x], pa.binary()) for x in (folds.tobytes(), packed_steps(offs.astype(np.int64)), packed_steps(words), packed(idx.astype(np.uint32)))]
                yield pa.record_batch(cols, names=["batch", "keys", "folds", "at", "words", "idx"])

    rows = docs.select(F.col(key).alias("key"), fold(key, 7).cast("int").alias("fold"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, f"batch long, keys array<{kind}>, folds binary, at binary, words binary, idx binary")


def _weights(folds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens count for training, and which of those are held out."""
    per = np.repeat(folds, np.diff(at))
    return per != TEST, per == HELD


def _requests(buckets: int):
    @lean
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for number, folds, at, words, idx in zip(*[b.column(c).to_pylist() for c in ("batch", "folds", "at", "words", "idx")], strict=True):
                folds, at, words, idx = np.frombuffer(folds, np.uint8), unpacked_steps(at, np.int64), unpacked_steps(words, np.uint64), unpacked(idx, np.uint32).astype(np.uint64)
                train, held = _weights(folds, at)
                count = lambda inv, n, hit: np.bincount(inv[hit], minlength=n).astype(np.uint32)
                small = idx.astype(np.int64)
                pairs, inv = np.unique(_pairs(idx, at, len(words)), return_inverse=True)
                keys = _pair_keys(pairs, words)
                sides = []
                for k, i in ((words, small), (keys, inv)):
                    order, bounds = by_bucket(k, buckets)
                    t, h = count(i, len(k), train)[order], count(i, len(k), held)[order]
                    # within a bucket the quotient tells the whole key, and ascends
                    sides.append((k[order] // np.uint64(buckets), t, h, bounds))
                rows: list[list] = [[] for _ in range(7)]
                for q in range(buckets):
                    rows[0].append(q)
                    for s, (k, t, h, bounds) in enumerate(sides):
                        cut = slice(bounds[q], bounds[q + 1])
                        rows[1 + 3 * s].append(packed_steps(k[cut]))
                        rows[2 + 3 * s].append(packed(t[cut]))
                        rows[3 + 3 * s].append(packed(h[cut]))
                cols = [pa.array(rows[0], pa.int32()), pa.array([number] * buckets, pa.int64()), *[pa.array(r, pa.binary()) for r in rows[1:]]]
                yield pa.record_batch(cols, names=["bucket", "batch", "wk", "wt", "wh", "pk", "pt", "ph"])

    return work


def _answers(t: pa.Table) -> pa.Table:
    """Corpus counts of a bucket's keys, and their held-out part, for each request in it; the first row carries the bucket's number of distinct training words."""
    out, distinct = [], []
    for k, c, h in (("wk", "wt", "wh"), ("pk", "pt", "ph")):
        keys = [unpacked_steps(x, np.uint64) for x in t.column(k).to_pylist()]
        _, inv = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([0, *map(len, keys)])
        sums = []
        for name in (c, h):
            each = np.concatenate([unpacked(x, np.uint32) for x in t.column(name).to_pylist()])
            sums.append(np.bincount(inv, each, minlength=0).astype(np.uint64) if len(each) else np.zeros(0, np.uint64))
        total, held = sums
        distinct.append((int((total > 0).sum()), int((total > held).sum())))
        for s in (total, held):
            per = s[inv] if len(inv) else s
            out.append([packed(per[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    lead = [[v] + [0] * (t.num_rows - 1) for v in distinct[0]]
    cols = {"batch": t.column("batch"), "bucket": t.column("bucket"), "v_all": pa.array(lead[0], pa.int64()), "v_rest": pa.array(lead[1], pa.int64())}
    return pa.table(cols | {n: pa.array(x, pa.binary()) for n, x in zip(("wt", "wh", "pt", "ph"), out, strict=True)})


COUNTS = ("wt", "wh", "pt", "ph")


def _placed(kind: str, buckets: int):
    """A batch with the corpus counts, and their held-out part, of its distinct words (wt, wh) and bigrams (pt, ph)."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1 or not right.num_rows:
            raise RuntimeError("a batch was read again in another order; write docs before they are scored")
        r = left.to_pylist()[0]
        folds, at, words, idx = np.frombuffer(r["folds"], np.uint8), unpacked_steps(r["at"], np.int64), unpacked_steps(r["words"], np.uint64), unpacked(r["idx"], np.uint32).astype(np.uint64)
        right = right.sort_by("bucket")
        train, held = _weights(folds, at)
        pairs = np.unique(_pairs(idx, at, len(words)))
        got = {}
        for names, keys in ((("wt", "wh"), words), (("pt", "ph"), _pair_keys(pairs, words))):
            order, _ = by_bucket(keys, buckets)
            for name in names:
                got[name] = np.zeros(len(keys), np.uint64)
                got[name][order] = np.concatenate([np.zeros(0, np.uint64), *[unpacked(x, np.uint64) for x in right.column(name).to_pylist()]])
        own = {
            "n_all": int(train.sum()), "n_rest": int((train & ~held).sum()), "d_all": int((folds != TEST).sum()), "d_rest": int(((folds != TEST) & (folds != HELD)).sum()),
            "v_all": sum(right.column("v_all").to_pylist()), "v_rest": sum(right.column("v_rest").to_pylist()),
        }
        cols = {"keys": left.column("keys").combine_chunks()} | {c: left.column(c) for c in ("folds", "at", "idx")}
        cols |= {n: pa.array([packed(got[n])], pa.binary()) for n in COUNTS}
        return pa.table(cols | {n: pa.array([v], pa.int64()) for n, v in own.items()})

    schema = f"keys array<{kind}>, folds binary, at binary, idx binary, wt binary, wh binary, pt binary, ph binary, n_all long, n_rest long, d_all long, d_rest long, v_all long, v_rest long"
    return work, schema


def _by_token(at: np.ndarray, idx: bytes, counts: list[bytes]) -> list[np.ndarray]:
    """COUNTS of each token of a batch."""
    wt, wh, pt, ph = (unpacked(x, np.uint64) for x in counts)
    idx = unpacked(idx, np.uint32).astype(np.uint64)
    _, inv = np.unique(_pairs(idx, at, len(wt)), return_inverse=True)
    idx = idx.astype(np.int64)
    return [wt[idx], wh[idx], pt[inv], ph[inv]]


def context_counts(counts: np.ndarray, sizes: np.ndarray, texts: int) -> np.ndarray:
    """Each token's context count: the count of the word before it, or the number of texts at a beginning."""
    out = np.empty_like(counts)
    out[1:] = counts[:-1]
    first = np.cumsum(sizes) - sizes
    out[first] = texts
    return out


def bucket_of(count: np.ndarray) -> np.ndarray:
    """Frequency bucket of a context: the binary logarithm of its count; contexts that were never seen have bucket 0 and no bigram estimate."""
    return np.floor(np.log2(np.maximum(count, 1).astype(np.float64))).astype(np.int64)


def ratio_bin(ratio: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.clip(((np.log(ratio) - LEAST) / STEP).astype(np.float64), 0, BINS - 2) // 1 + 1, 0).astype(np.int64)


def em(hist: np.ndarray, rounds: int = 200) -> float:
    """The mixture weight of the first estimate, from the histogram of ratios of the first to the second."""
    n = hist.sum()
    if not n:
        return 0.5
    r = np.exp(LEAST + (np.arange(BINS) - 0.5) * STEP)
    r[0] = 0.0
    w = 0.5
    for _ in range(rounds):
        nxt = float((hist * (w * r / (w * r + 1 - w))).sum() / n)
        if abs(nxt - w) < 1e-9:
            break
        w = min(max(nxt, 1e-6), 1 - 1e-6)
    return w


def unigram(count: np.ndarray, n: int, v: int, weight: float) -> np.ndarray:
    return weight * count / max(n, 1) + (1 - weight) / (v + 1)


def _histogram(joined: DataFrame, fn) -> np.ndarray:
    """Sums over the corpus of what fn counts in a batch's held-out tokens, by bucket and bin."""

    @lean
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, BINS), np.int64)
        for b in it:
            for folds, at, idx, *counts in zip(*[b.column(i).to_pylist() for i in range(7)], strict=True):
                folds, at = np.frombuffer(folds, np.uint8), unpacked_steps(at, np.int64)
                held, size = _weights(folds, at)[1], np.diff(at)[folds == HELD]
                if len(size):
                    wt, wh, pt, ph = _by_token(at, idx, counts)
                    bucket, bins = fn(size, (wt - wh)[held], (pt - ph)[held])
                    total += np.bincount(bucket * BINS + bins, minlength=64 * BINS).reshape(64, BINS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], names=["at", "n"])

    rows = joined.select("folds", "at", "idx", *COUNTS).mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(64 * BINS, np.int64)
    for r in rows:
        out[r.at] = r.n
    return out.reshape(64, BINS)


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", batch_bytes: int = 6 << 20) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    A null text is the empty text and has the end as its only token. Repeated
    rows count as often as they occur and get equal scores; a null key falls in
    the fold of the empty text; extra columns are ignored; an empty table gives
    an empty result. batch_bytes trades a task's memory against repeated keys.
    Words and bigrams are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one exchange by batch, which the requests and the answers' return both read
    held = batches_of(docs, text, key, batch_bytes).repartition(buckets, "batch")
    asked = held.mapInArrow(_requests(buckets), "bucket int, batch long, wk binary, wt binary, wh binary, pk binary, pt binary, ph binary")
    told = asked.groupBy("bucket").applyInArrow(_answers, "batch long, bucket int, v_all long, v_rest long, wt binary, wh binary, pt binary, ph binary")
    work, schema = _placed(kind, buckets)
    joined = written(held.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(lambda a, b: work(a, b), schema), "lm-counts")
    names = ("n_all", "n_rest", "d_all", "d_rest", "v_all", "v_rest")
    got = joined.agg(*[F.sum(c).alias(c) for c in names]).first()
    t = {c: got[c] or 0 for c in names}

    def first(size: np.ndarray, w: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(len(w), np.int64), ratio_bin(w * ((t["v_rest"] + 1) / max(t["n_rest"], 1)))

    flat = em(_histogram(joined, first)[0])

    def second(size: np.ndarray, w: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        context = context_counts(w, size, t["d_rest"])
        seen = context > 0
        ratio = p[seen] / context[seen] / unigram(w[seen], t["n_rest"], t["v_rest"], flat)
        return bucket_of(context[seen]), ratio_bin(ratio)

    hist = _histogram(joined, second)
    every = em(hist.sum(axis=0))
    weights = np.array([em(h) if h.sum() >= 20 else every for h in hist])

    @lean
    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for keys, folds, ends, idx, *counts in zip(b.column(0), *[b.column(i).to_pylist() for i in range(1, 8)], strict=True):
                ends = unpacked_steps(ends, np.int64)
                size = np.diff(ends)
                w, _, p, _ = _by_token(ends, idx, counts)
                context = context_counts(w, size, t["d_all"])
                mix = np.where(context > 0, weights[bucket_of(context)], 0.0)
                prob = mix * p / np.maximum(context, 1) + (1 - mix) * unigram(w, t["n_all"], t["v_all"], flat)
                base = np.log10((w + 1.0) / (t["n_all"] + 1.0 * (t["v_all"] + 1)))
                add = lambda x: np.add.reduceat(x, ends[:-1])  # noqa: E731  each text has its end, so none is empty
                cols = [keys.values, pa.array(np.frombuffer(folds, np.uint8) == TEST), pa.array(size), pa.array(add((w > 0).astype(np.int64))), pa.array(np.full(len(size), t["n_all"], np.int64)), pa.array(add(base)), pa.array(add(np.log10(prob)))]
                yield pa.record_batch(cols, names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = joined.select("keys", "folds", "at", "idx", *COUNTS).mapInArrow(scored, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
