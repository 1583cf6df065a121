import random
import re
from collections import Counter

import numpy as np
import pytest

from loomspan.llm.collocations import collocations, counted, merged, pieces, read_piece
from loomspan.llm.textops import column_bytes


def brute(rows, least=10, inside=50, top=2000):
    """Rows (lang, text); whole numbers of Python, phrases as tuples."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if len(p) == 2 and any(lg == lang and len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 100 * b >= inside * a for (lg, q), b in f.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p, -a, lf, r, n[lang], -s) for lang, found in out.items() for i, (s, a, _, p, lf, r) in enumerate(sorted(found)[:top]))


def rows():
    rng = random.Random(8)
    words = ["new", "York", "of", "the", "city", "é", "漢字", "a-b", "x\x01y", "state", " z"]
    out = []
    for k in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?"]) for _ in range(rng.randint(0, 120)))
        out.append((["en", "fr", None, "und"][k % 7 % 4], text + " new york city" * (k % 3)))
    return out + [("de", None), ("de", ""), ("de", " . "), ("es", "the same text of words " * 40), ("es", "the same text of words " * 40), ("en", "w " * 9000)]


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 1, "most": 5}, {"top": 7, "least": 3, "inside": 80}])
def test_against_brute_force(spark, how):
    docs = spark.createDataFrame([(k, lang, t, 1, "c") for k, (lang, t) in enumerate(rows())], "doc_id long, lang string, text string, a int, phrase string").repartition(5)
    if "shard_bytes" in how:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = sorted(tuple(r) for r in collocations(docs, **how).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows(), **{k: v for k, v in how.items() if k in ("top", "least", "inside")})
    assert len(got) > 20


def test_tables_without_words(spark):
    for r in ([], [("en", None), (None, " .")]):
        assert collocations(spark.createDataFrame(r, "lang string, text string")).count() == 0


def test_serialised_tries_merge_to_the_trie_of_all():
    import pyarrow as pa

    texts = [t or "" for _, t in rows()]
    whole = counted(*column_bytes(pa.array(texts)))
    parts = [counted(*column_bytes(pa.array(texts[i::3]))) for i in range(3)]
    ranges: dict[int, list] = {}
    for t in parts:
        for r, vocabulary, arrays in pieces(t, 11):
            ranges.setdefault(r, []).append(read_piece(vocabulary, arrays))
    again = merged([merged(x) for x in ranges.values()])
    assert again.words.equals(whole.words)
    for name in ("single", "one", "pair", "two", "parent", "third", "three"):
        assert np.array_equal(getattr(again, name), getattr(whole, name)), name


def test_scores_beyond_64_bits(spark):
    from loomspan.llm.collocations import _score

    a, lf, r = 90_000_000_000_001, 99_999_999_999_999, 98_765_432_109_876
    got = spark.createDataFrame([(a, lf, r)], "a long, l long, r long").select(_score("a", "l", "r").alias("s")).first().s
    assert got == 1000000 * a * a // (lf * r)
