import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import quality, toxicity

SPACE = r"[^\x20\x09-\x0D]+"


def stats(t):
    t = t or ""
    w = re.findall(SPACE, t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = set()
    for k in range(len(w) - 4):
        if c[tuple(w[k : k + 5])] > 1:
            cover |= set(range(k, k + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_stats_against_brute_force(docs, corpus):
    got = sorted(tuple(r)[:6] for r in quality.stats(docs.where("doc_id is not null")).collect())
    assert got == sorted((k, *stats(t)) for k, t in corpus if k is not None)


def test_rules_without_labels_and_empty(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    assert got[102].base_failed and not got[102].kept and got[102].n_words == 0
    assert got[108].base_failed and got[None].kept
    assert quality.quality_rules(empty, labels).count() == 0


def test_learned_list_is_ordered_and_precise():
    rng = np.random.default_rng(1)
    x = {f: rng.integers(0, 1000, 3000) for f in quality.FEATURES}
    bad = (x["symbols_per_1000_words"] > 800) | ((x["upper_per_1000_chars"] > 900) & (x["n_words"] < 500))
    rules = quality.learn_rules(x, bad)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= r.covers(x)
    assert len(rules) >= 2 and (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.02 * (~bad).sum()


def test_rule_column_equals_the_rules(spark):
    rules = [quality.Rule((("n_words", ">=", 5), ("symbols_per_1000_words", "<=", 300))), quality.Rule((("n_words", "<=", 2),))]
    rows = [(n, 0, s, 0, 0, 1, 0, 0, 0, n) for n in range(8) for s in (0, 5)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in quality.STATS)).withColumn("rule", quality.rule_column(rules))
    for r in df.collect():
        want = str(rules[0]) if r.n_words >= 5 and 1000 * r.n_symbols // r.n_words <= 300 else str(rules[1]) if r.n_words <= 2 else None
        assert r.rule == want


@pytest.fixture(scope="module")
def toxic(spark):
    import random

    rng = random.Random(4)
    plain = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(900):
        parts = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(rng.randint(1, 12))]
        bad = i % 4 == 0
        if bad:
            parts[rng.randrange(len(parts))] += " you idiot"
        rows.append((i, ". ".join(parts)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_and_located(spark, toxic):
    docs, labels = toxic
    model = toxicity.fit(docs, labels.where(toxicity.fold("doc_id", 5) != 0))
    out = toxicity.score(docs, model).join(labels, "doc_id").join(docs, "doc_id").where(toxicity.fold("doc_id", 5) == 0).collect()
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in out)
    assert right >= 0.97 * len(out)
    for r in out:
        if r.toxic and r.score >= 0.5:
            assert any("idiot" in r.text.encode()[s.start : s.end].decode() for s in r.offending)
            assert all("idiot" in r.text.encode()[s.start : s.end].decode() for s in r.offending)


def test_toxicity_odd_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, none)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0
    blank = {r.doc_id: r.score for r in got}
    assert blank[102] == blank[103] == blank[104] == pytest.approx(model.leak)


def test_noisy_or_by_hand(spark):
    w = np.zeros(1 << toxicity.BITS, np.float32)
    data = np.frombuffer(b"bad", np.uint8)
    _, _, bucket, _ = toxicity.sentences(data, np.array([0, 3]))
    w[bucket[0]] = 5.0
    model = toxicity.Model(w, 0.1)
    p = float(model.sentence(np.array([5.0]))[0])
    df = spark.createDataFrame([(1, "Bad. fine! BAD bad\nok")], "doc_id long, text string")
    r = toxicity.score(df, model).first()
    assert r.score == pytest.approx(1 - 0.9 * (1 - p) ** 2) and len(r.offending) == 2
