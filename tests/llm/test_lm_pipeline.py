import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomspan.llm import lm

SPACE = r"[^\x20\x09-\x0D]+"


def tokens(t):
    return re.findall(SPACE, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["\n"]


def remainder(k):
    return zlib.crc32(("" if k is None else str(k)).encode()) % 7


def brute(rows):
    """The same model in plain Python: counts, held-out weights by frequency bucket, scores."""
    train = [(k, tokens(t)) for k, t in rows if remainder(k) != lm.TEST]
    rest = [(k, t) for k, t in train if remainder(k) != lm.HELD]
    held = [t for k, t in train if remainder(k) == lm.HELD]

    def counts(part):
        return Counter(x for _, t in part for x in t), Counter(p for _, t in part for p in zip(["^", *t[:-1]], t, strict=True))

    uni, bi = counts(train)
    uni_r, bi_r = counts(rest)
    n, v, n_r, v_r = sum(uni.values()), len(uni), sum(uni_r.values()), len(uni_r)
    hist = np.zeros((64, lm.BINS), np.int64)
    for t in held:
        for w in t:
            hist[0, lm.ratio_bin(np.array([uni_r[w] * (v_r + 1) / max(n_r, 1)]))[0]] += 1
    flat = lm.em(hist[0])
    hist[:] = 0
    for t in held:
        for a, w in zip(["^", *t[:-1]], t, strict=True):
            c = len(rest) if a == "^" else uni_r[a]
            if c:
                low = flat * uni_r[w] / max(n_r, 1) + (1 - flat) / (v_r + 1)
                hist[int(math.log2(c)), lm.ratio_bin(np.array([bi_r[(a, w)] / c / low]))[0]] += 1
    every = lm.em(hist.sum(axis=0))
    weights = [lm.em(h) if h.sum() >= 20 else every for h in hist]
    out = []
    for k, text in rows:
        t, base, score = tokens(text), 0.0, 0.0
        for a, w in zip(["^", *t[:-1]], t, strict=True):
            base += math.log10((uni[w] + 1) / (n + v + 1))
            c = len(train) if a == "^" else uni[a]
            low = flat * uni[w] / max(n, 1) + (1 - flat) / (v + 1)
            x = weights[int(math.log2(c))] if c else 0.0
            score += math.log10(x * bi[(a, w)] / max(c, 1) + (1 - x) * low)
        out.append((k, remainder(k) == lm.TEST, len(t), sum(uni[w] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize("batch", [300, 4 << 20])
def test_scores_against_brute_force(docs, corpus, batch, empty):
    order = lambda r: (-1 if r[0] is None else r[0], r[2])
    got = sorted((tuple(r) for r in lm.score(docs, batch_bytes=batch).collect()), key=order)
    want = sorted(brute(corpus), key=order)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert lm.score(empty).count() == 0


def test_em_finds_the_weight():
    rng = np.random.default_rng(0)
    hist = np.zeros(lm.BINS, np.int64)
    # tokens from a mixture of 0.7 a + 0.3 b, where a is 4 times b or 0
    for _ in range(20000):
        hit = rng.random() < 0.7 * 1 + 0.3 * 0.25
        hist[lm.ratio_bin(np.array([4.0 if hit else 0.0]))[0]] += 1
    assert lm.em(hist) == pytest.approx(0.7, abs=0.02)


def test_pipeline_stage_by_stage(spark, tmp_path, corpus):
    import corpus_pipeline as p
    from loomspan.llm import decontaminate

    leak = "the of and alpha beta delta one two three four five six seven eight nine ten eleven twelve thirteen words more"
    rows = [(k, t, "en", "s", len(t or "")) for k, t in corpus if k is not None and k not in (107,)] + [(500, leak + " filler words here", "en", "s", 1), (501, "a plain text of ten words and an address me@mail.example.com in it", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    docs = spark.read.parquet(d + "/documents.parquet")
    kept = []
    for name, stage in p.STAGES:
        docs = stage(spark, docs, d)
        kept.append((name, {r.doc_id for r in docs.collect()}))
        if name != "sentencepiece":
            assert docs.columns == list(p.COLUMNS)
    kept = dict(kept)
    fine = set()
    for k, t, *_ in rows:
        w = re.findall(SPACE, t or "")
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        if len(w) >= 10 and 100 * len(cover) <= 20 * len(w):
            fine.add(k)
    assert kept["quality_rules"] == fine
    assert 500 not in kept["decontamination"] and kept["near_duplicates"] - kept["decontamination"] == {500}
    assert 100 not in kept["near_duplicates"] and 501 in kept["sentencepiece"] == kept["personal_data"]
