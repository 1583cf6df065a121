"""Fits read whole texts, short items are found, and texts with very many hits end."""

import random

import numpy as np
import pytest

from loomspan.llm.decontaminate import decontaminate
from loomspan.llm.toxicity import distinct_sentences, fit, score, train


def test_the_sentence_that_tells_stands_after_word_ten_thousand(spark):
    rng = random.Random(2)
    rows = []
    for k in range(40):
        body = ". ".join(" ".join(f"w{rng.randint(0, 300)}" for _ in range(20)) for _ in range(520))
        rows.append((k, body + (". you vile creature" if k % 2 else ". you kind creature"), k % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = score(docs, fit(docs, labels)).collect()
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got)
    assert all(len(r.offending) == r.doc_id % 2 for r in got)


def test_equal_sentences_count_as_often_as_they_occur():
    owner = np.array([0, 0, 1, 2, 2, 3, 5, 5])
    words = np.array([3, 9, 3, 3, 9, 4, 3, 9])
    o, w, n = distinct_sentences(owner, words)
    assert (o.tolist(), w.tolist(), n.tolist()) == ([0, 0, 1, 2], [3, 9, 3, 4], [3, 1, 1])
    rng = np.random.default_rng(0)
    label = rng.random(30) < 0.5
    sentence = np.arange(120) % 60
    word = np.where(label[sentence % 30], 5, 6) + 10 * (np.arange(120) >= 60)
    doc = np.arange(60) % 30
    order = np.argsort(sentence, kind="stable")
    twice = train(word[order], sentence[order], doc, label)
    once = train(np.concatenate([word[sentence == k] for k in range(30)]), np.repeat(np.arange(30), 2), np.arange(30), label, np.full(30, 2))
    assert np.allclose(twice.weights, once.weights, atol=1e-3) and abs(twice.leak - once.leak) < 1e-3


def test_short_items_and_many_hits(spark):
    docs = spark.createDataFrame([(1, "so one two three it goes"), (2, "one two, Four"), (3, "One. Two"), (4, "tick tock " * 3000), (5, "two one")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "one two three"), ("b", "one two"), ("c", "tick tock tick tock tick"), ("d", "one"), ("e", " ".join(["tick tock"] * 20))], "item_id string, text string")
    got = {r.doc_id: r.leaked_items for r in decontaminate(docs, bench).collect()}
    assert got == {1: ["a", "b"], 2: ["b"], 3: ["b"], 4: ["c", "e"], 5: []}


def test_windows_that_the_masks_do_not_cover_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "a b")], "item_id string, text string")
    for how in ({"window": 10}, {"share": 0.5}):
        with pytest.raises(ValueError):
            decontaminate(docs, bench, **how)
