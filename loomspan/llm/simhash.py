"""SimHash near-duplicate detection by segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments of two bits; the vector of
the segments' bit counts is its embedding. The Manhattan distance of two
embeddings never exceeds the Hamming distance, so every pair within
``max_bits`` lies within that Manhattan range. The range join runs on a grid:
the 32 coordinates form six groups, at most three of which can differ when the
distance is three, so two linked fingerprints agree in the counts of at least
one of the C(6, 3) triples of groups. Each triple's counts are a cell. In a
cell the Manhattan bound filters first, then the exact Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import jaccard
from loomspan.llm.textops import lean, lowered, slices
from loomspan.operators.components import connected_components
from loomspan.session import written

SEED = 42
LOW = 0x5555555555555555
#: Sizes in two-bit segments; they add up to 32.
GROUPS = (6, 6, 5, 5, 5, 5)


def fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of one lower-cased text in UTF-8."""
    parts = text.split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        starts = (ends - np.fromiter(map(len, parts), np.int64, len(parts)) - 1)[: len(parts) - words + 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    every = np.array(hashes, dtype="<u8")
    for i in range(0, len(every), 1 << 15):
        part = every[i : i + (1 << 15)]
        total += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(every), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3) -> DataFrame:
    """(key, fp long): 64-bit SimHash of word shingles. A null or blank text has fingerprint zero."""

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[int] = []
            for _, _, data, at in slices(b.column(1)):
                low = lowered(data).tobytes()
                out += [fingerprint(low[i:j], words) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(np.array(out, dtype=np.uint64).view(np.int64))], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(batches, f"key {kind}, fp long")


def counts_of(fp):
    """The embedding packed in a long, two bits a segment: the counts 0, 1 and 2 are written 00, 01 and 11.

    In this code the Manhattan distance of two embeddings is the number of bits
    in which they differ, and equal counts have equal codes.
    """
    low = fp.bitwiseAND(F.lit(LOW))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a, b):
    """Manhattan distance of two packed embeddings."""
    return F.bit_count(a.bitwiseXOR(b))


def _masks() -> list[int]:
    out, at = [], 0
    for g in GROUPS:
        out.append(((1 << 2 * g) - 1) << at)
        at += 2 * g
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _block_forest(pairs_of: int):
    """For a cell's block pair: a spanning forest of its links within max_bits."""
    m1, m2, m4 = (np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F))

    def bits(x: np.ndarray) -> np.ndarray:
        x = x - ((x >> np.uint64(1)) & m1)
        x = (x & m2) + ((x >> np.uint64(2)) & m2)
        x = (x + (x >> np.uint64(4))) & m4
        return (x * np.uint64(0x0101010101010101)) >> np.uint64(56)

    def unary(x: np.ndarray) -> np.ndarray:
        low, high = x & m1, (x >> np.uint64(1)) & m1
        return low | high | ((low & high) << np.uint64(1))

    def forest(fps: np.ndarray) -> tuple[list[int], list[int]]:
        fps = np.unique(fps)
        code = unary(fps)
        left = np.ones(len(fps), bool)
        a, b = [], []
        for i in range(len(fps)):
            if not left[i]:
                continue
            left[i] = False
            todo = [i]
            while todo:  # what is reached leaves the pool, so each is compared with the rest once
                j = todo.pop()
                pool = np.flatnonzero(left)
                if not len(pool):
                    break
                near = pool[bits(code[pool] ^ code[j]) <= pairs_of]
                near = near[bits(fps[near] ^ fps[j]) <= pairs_of]
                left[near] = False
                a += [int(fps[j].view(np.int64))] * len(near)
                b += fps[near].view(np.int64).tolist()
                todo += near.tolist()
        return a, b

    return forest


def links(fps: DataFrame, max_bits: int = 3, block: int = 1024) -> DataFrame:
    """(a, b) fingerprints within max_bits: enough links to connect all that are connected.

    fps has a column fp of distinct fingerprints. A cell with up to ``block``
    members is joined whole. A larger cell is dealt into blocks of about that
    size by a hash, and every pair of its blocks is one group, so no task ever
    holds more than two blocks and no link is lost. Within a group a spanning
    forest stands for its links, so a cell gives fewer rows than members.
    """
    if max_bits > 3:
        raise ValueError("the grid of six groups covers distances up to 3")
    masks = _masks()
    triples = [_signed(masks[i] | masks[j] | masks[k]) for i, j, k in combinations(range(6), 3)]
    c = fps.select("fp", counts_of(F.col("fp")).alias("c"))
    cells = c.select("fp", F.posexplode(F.array(*[F.col("c").bitwiseAND(F.lit(m)) for m in triples])).alias("t", "cell"))
    cells = cells.select("fp", F.xxhash64("t", "cell").alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    held = cells.join(sizes, "cell")
    small = held.where(F.col("n") <= block).select("fp", F.col("cell"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    large = held.where(F.col("n") > block).select("fp", "cell", parts.alias("k"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("me"))
    large = large.select("fp", "cell", "me", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    large = large.select("fp", "cell", F.least("me", "o").alias("i"), F.greatest("me", "o").alias("j"))
    forest = _block_forest(max_bits)

    def group(table: pa.Table) -> pa.Table:
        a, b = forest(table.column("fp").to_numpy().view(np.uint64))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # groups of two are the common case and stay in SQL
    pairs = (
        small.join(sizes.where("n = 2").select("cell"), "cell", "left_semi")
        .groupBy("cell")
        .agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where((manhattan(counts_of(F.col("a")), counts_of(F.col("b"))) <= max_bits) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
        .select("a", "b")
    )
    more = small.join(sizes.where("n > 2").select("cell"), "cell", "left_semi").unionByName(large)
    grouped = more.groupBy("cell", "i", "j").applyInArrow(group, "a long, b long")
    return pairs.unionByName(grouped)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, max_bits: int = 3) -> DataFrame:
    """(key, fingerprint hex, component_id): component_id is the smallest key reachable over links.

    Equal fingerprints meet in one representative first (a partial minimum), so
    a copy group of any size is one node. Repeated rows give repeated results; a
    null key keeps its fingerprint, and its component is the smallest non-null
    key there is in it, else null. Extra columns are ignored; an empty table
    gives an empty result.
    """
    fp = written(fingerprints(docs, text, key, words), "simhash-fp")
    reps = written(fp.groupBy("fp").agg(F.min("key").alias("rep")), "simhash-reps")
    edges = written(links(reps.select("fp"), max_bits), "simhash-links")
    comp = connected_components(edges)
    named = reps.join(comp, reps.fp == comp.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = written(named.join(roots, "root").select("fp", "component_id"), "simhash-components")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fp.join(final, "fp").select(F.col("key").alias(key), hexed.alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, max_bits: int = 3, **how) -> DataFrame:
    """(key, text_hash, component_id): component_id is the smallest key reachable over links, null where none has a key.

    Texts link at an exact Jaccard similarity of jaccard.LEAST or more of their
    shingles. The fingerprints of the shingles and their grid find what lies
    within max_bits, and each pair is verified by its sets. At that similarity
    fingerprints differ in some ten bits of 64, for which no grid is selective,
    so the pairs beyond max_bits come from the prefix join (see jaccard), which
    skips what the fingerprints have connected. A row for each row of docs;
    text_hash tells rows of one key apart. Equal sets are one node, texts
    without a word among them; an empty table gives an empty result.
    """
    rows = written(jaccard.named(docs, text, key, words), "simhash-rows")
    nodes = rows.where("size > 0").select("name", "fp").distinct()
    reps = written(nodes.groupBy("fp").agg(F.min("name").alias("rep"), F.count("*").alias("n")), "simhash-reps")
    same = nodes.join(reps.where("n > 1"), "fp").where("name <> rep").select(F.col("rep").alias("a"), F.col("name").alias("b"))
    near = links(reps.select("fp"), max_bits)
    for side in ("a", "b"):
        near = near.join(reps.select(F.col("fp").alias(side), F.col("rep").alias(side + "_rep")), side)
    pairs = written(same.unionByName(near.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))).distinct(), "simhash-pairs")
    known = written(jaccard.checked(pairs, docs, text, words), "simhash-known")
    return jaccard.grouped(rows, jaccard.components(docs, text, words, known, **how), key)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
