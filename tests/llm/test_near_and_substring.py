import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from loomspan.llm import simhash, substring

SPACE = r"[^\x20\x09-\x0D]+"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def fingerprint(t):
    w = re.findall(SPACE, lower(t))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    names = sorted(fps, key=lambda k: (k is None, k or 0))
    root = {k: k for k in range(len(names))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(names)):
        for j in range(i):
            if bin(fps[names[i]] ^ fps[names[j]]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {n: names[find(i)] for i, n in enumerate(names)}


def test_near_duplicates_against_brute_force(docs, corpus, empty):
    fps = {k: fingerprint(t) for k, t in corpus}
    want = brute_components(fps)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(corpus)
    assert {k: f for k, f, _ in got} == {k: f"{v:016x}" for k, v in fps.items()}
    assert {k: c for k, _, c in got} == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [3, 1024])
def test_links_connect_random_clusters(spark, block):
    rng = random.Random(block)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 4)):
                y ^= 1 << b
            fps.add(y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    comp = simhash.connected_components(simhash.links(df, block=block))
    got = {r.node & (2**64 - 1): r.component for r in comp.collect()}
    want = brute_components({x: x for x in fps})
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert [g for g in groups(want) if len(g) > 1] == groups(got)


def test_manhattan_is_a_lower_bound(spark):
    df = spark.range(300).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"))
    c = df.select(simhash.manhattan(simhash.counts_of(F.col("a")), simhash.counts_of(F.col("b"))).alias("l1"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("h"), "a", "b")
    for r in c.collect():
        pop = lambda x: [bin((x >> (2 * i)) & 3).count("1") for i in range(32)]
        assert r.l1 == sum(abs(p - q) for p, q in zip(pop(r.a), pop(r.b), strict=True)) <= r.h


def brute_substring(rows):
    seen, out = set(), {}
    for k, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        b = (t or "").encode()
        gone, last = bytearray(len(b)), 0
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                for q in range(max(p, last), p + 100):
                    gone[q] = 1
                last = p + 100
            else:
                seen.add(w)
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.setdefault(k, []).append((len(b), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("batch", [400, 4 << 20])
def test_substrings_against_brute_force(spark, corpus, batch, empty):
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randint(0, 99)}" for _ in range(60))
    rows = corpus + [(200 + i, f"{rng.random()} {passage} {rng.random()}") for i in range(12)]
    rows += [(300, "a" * 300), (301, "ab" * 200), (302, "é" * 130), (303, "ab" * 60 + "a" * 150), (304, passage[:99]), (305, passage[:100])]
    got: dict = {}
    for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batch_bytes=batch).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
        assert r.n_removed == sum(b - a for a, b in r.spans) and r.n_spans == len(r.spans)
    want = brute_substring(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert substring.dedup_substrings(empty).count() == 0
