"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability comes from the
hashed words in it; the document's is their noisy-or with a leak, which stands
for labels that no sentence explains. The weights are trained from document
labels alone, and then locate the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.textops import count_in, lean, lowered, mixed, prefix_hash, runs, slices, stretch_hash

BITS = 18
BREAK = np.zeros(256, dtype=bool)
BREAK[list(b".!?\n")] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = LETTER[48:58] = LETTER[128:] = True
FLOOR = -4.0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sentences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentence starts, ends, each word's bucket, each word's sentence) in a run of lower-cased texts."""
    starts, ends = runs(~BREAK[data], at)
    ws, we = runs(LETTER[data], at)
    bucket = (stretch_hash(prefix_hash(data), ws, we) >> np.uint64(64 - BITS)).astype(np.int32)
    return starts, ends, bucket, np.searchsorted(starts, ws, side="right") - 1


@dataclass(frozen=True)
class Model:
    """Word weights and the leak: the probability of a document with no evidence."""

    weights: np.ndarray
    leak: float

    def sentence(self, z: np.ndarray) -> np.ndarray:
        """Probability of sentences whose words' weights sum to z; without evidence 0."""
        low = _sigmoid(np.array(FLOOR))
        return np.maximum(0.0, (_sigmoid(FLOOR + z) - low) / (1 - low))


def train(word: np.ndarray, sentence: np.ndarray, doc: np.ndarray, label: np.ndarray, often: np.ndarray | None = None, steps: int = 160, rate: float = 0.15, sparse: float = 2e-4, least_docs: int = 5) -> Model:
    """Weights and leak by Adam on the documents' log loss, with a soft threshold that keeps idle words at 0.

    word and sentence: the buckets in each sentence, each once, and their
    sentences; doc: each sentence's document; often: how many equal sentences
    the document has (1 if not given). Buckets in fewer than least_docs documents get no weight.
    """
    n, size = len(label), 1 << BITS
    if not n or not label.any():
        return Model(np.zeros(size, np.float32), 0.5 / (n + 1))
    pairs = word.astype(np.int64) * n + doc[sentence]
    pairs.sort()
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]] // n
    seen = np.bincount(pairs, minlength=size) >= least_docs
    del pairs
    keep = seen[word]
    names = np.flatnonzero(seen)
    index = np.zeros(size, np.int64)
    index[names] = np.arange(len(names))
    word, sentence = index[word[keep]], sentence[keep]
    # a sentence without such words is no evidence
    used, sentence = np.unique(sentence, return_inverse=True)
    doc = doc[used]
    often = np.ones(len(used)) if often is None else often[used].astype(np.float64)
    y = label.astype(bool)
    w, leak = np.zeros(len(names)), np.log(y.mean() / (1 - y.mean()) / 2)
    m, v, ml, vl = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    low = _sigmoid(np.array(FLOOR))
    for t in range(1, steps + 1):
        s = _sigmoid(FLOOR + np.bincount(sentence, w[word], minlength=len(used)))
        p = np.clip((s - low) / (1 - low), 0, 1 - 1e-9)
        q = _sigmoid(np.array(leak))
        none = np.log1p(-q) + np.bincount(doc, often * np.log1p(-p), minlength=n)
        some = np.clip(-np.expm1(none), 1e-9, 1)
        # d loss / d none: 1 share each for clean documents, minus the odds for toxic ones
        pull = np.where(y, (1 - some) / some, -1.0)
        slope = np.where(s >= low, s * (1 - s) / (1 - low), 0.0) / (1 - p)
        g = np.bincount(word, (-pull[doc] * often * slope)[sentence], minlength=len(names)) / n
        gl = float((-pull * q).sum() / n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        ml, vl = 0.9 * ml + 0.1 * gl, 0.999 * vl + 0.001 * gl * gl
        fix, fixv = 1 - 0.9**t, 1 - 0.999**t
        pace = rate / (np.sqrt(v / fixv) + 1e-5)
        w -= pace * m / fix
        w = np.sign(w) * np.maximum(0, np.abs(w) - pace * sparse)
        leak -= rate * (ml / fix) / (np.sqrt(vl / fixv) + 1e-8)
    out = np.zeros(size, np.float32)
    out[names] = w
    return Model(out, float(_sigmoid(np.array(leak))))


def distinct_sentences(owner: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence of each word, words, how often each sentence occurs) of a document's words by sentence, equal sentences as one."""
    if not len(owner):
        return owner, bucket, np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    size = np.diff(np.append(first, len(owner)))
    names = mixed(np.add.reduceat(mixed(bucket.astype(np.uint64) + np.uint64(1)), first) + size.astype(np.uint64))
    _, lead, often = np.unique(names, return_index=True, return_counts=True)
    keep = np.zeros(len(first), bool)
    keep[lead] = True
    count = np.zeros(len(first), np.int64)
    count[lead] = often
    stays = np.repeat(keep, size)
    return np.repeat(np.cumsum(keep) - 1, size)[stays], bucket[stays], count[keep]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 5_000, text: str = "text", key: str = "doc_id") -> Model:
    """A model from at most max_labelled labelled documents, those of the smallest hashed key (a bounded sample for the fit alone), each with its whole text.

    The sample's ids are the only broadcast. What reaches the driver is two
    numbers for each distinct word of each distinct sentence of the sample's
    texts. A key or label that is null does not count; of repeated labels the
    largest does, of repeated documents the text with the smallest hash; null
    and empty texts are documents without a sentence; of equally hashed keys the
    smaller comes first.
    """
    picked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows: list[list] = [[], [], [], []]
            for i, j, data, at in slices(b.column(1)):
                low = lowered(data)
                starts, _, bucket, owner = sentences(low, at)
                first = np.searchsorted(starts, at)
                flat = np.unique(owner.astype(np.int64) << BITS | bucket)  # a word counts once in a sentence
                owner, bucket = flat >> BITS, flat & ((1 << BITS) - 1)
                words = np.searchsorted(owner, first)
                for k in range(j - i):
                    own = slice(words[k], words[k + 1])
                    made = distinct_sentences(owner[own], bucket[own])
                    for to, x in zip(rows, (b.column(2)[i + k].as_py(), *[m.astype("<i4").tobytes() for m in made]), strict=True):
                        to.append(x)
            yield pa.record_batch([b.column(0), pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=["key", "y", "owner", "words", "often"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(picked), rows.key == picked.doc_id).groupBy("key").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").cast("int").alias("y"))
    kind = docs.schema[key].dataType.simpleString()
    got = rows.mapInArrow(batches, f"key {kind}, y int, owner binary, words binary, often binary").toPandas().sort_values("key", kind="stable")
    words, owner, doc, often, base = [], [], [], [], 0
    for k, parts in enumerate(zip(got["owner"], got["words"], got["often"], strict=True)):
        o, w, n = (np.frombuffer(x, "<i4") for x in parts)
        words.append(w)
        owner.append(o + np.int32(base))
        often.append(n)
        doc.append(np.full(len(n), k, np.int32))
        base += len(n)
    join = lambda x: np.concatenate(x).astype(np.int32, copy=False) if x else np.zeros(0, np.int32)
    return train(join(words), join(owner), join(doc), got["y"].to_numpy() > 0, join(often))


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", offend: float = 0.5) -> DataFrame:
    """(key, score, offending): offending lists (start byte, end byte, probability) of sentences at or over ``offend``.

    A null, empty or wordless text has the leak as its score and no sentences;
    repeated rows give repeated results; extra columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            scores, found = [], []
            for i, j, data, at in slices(b.column(1)):
                starts, ends, bucket, owner = sentences(lowered(data), at)
                # a word counts once in a sentence, as in training
                flat = np.unique(owner.astype(np.int64) << BITS | bucket)
                weight = model.weights[flat & ((1 << BITS) - 1)]
                hit = weight != 0
                p = model.sentence(np.bincount(flat[hit] >> BITS, weight[hit], minlength=len(starts)))
                first = np.searchsorted(starts, at)
                none = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)))])
                scores.append(1 - (1 - model.leak) * np.exp(none[first[1:]] - none[first[:-1]]))
                bad = np.flatnonzero(p >= offend)
                cut = np.searchsorted(bad, first)
                for k in range(j - i):
                    mine = bad[cut[k] : cut[k + 1]]
                    found.append([{"start": int(starts[s] - at[k]), "end": int(ends[s] - at[k]), "p": float(p[s])} for s in mine])
            col = np.clip(np.concatenate(scores), 0, 1) if scores else np.zeros(0)
            yield pa.record_batch([b.column(0), pa.array(col), pa.array(found, spans)], names=["key", "score", "offending"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(batches, f"key {kind}, score double, offending array<struct<start:long,end:long,p:double>>")
    return out.withColumnRenamed("key", key)


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(parts))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where(fold("doc_id", 5) != 0))
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
