import hashlib
import random
import re
import zlib

import pytest

from loomspan.llm.periodic import op11_periodic_runs, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=24, exponent=3):
    """Every stretch by its smallest period, without any of the operator's shortcuts."""
    n, spans = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                spans.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in spans.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(5)
    out = [None, "", " \t\n", "one", "a " * 24, "a " * 23, "a b " * 12, "a b c d e f g h " * 3, "é漢 " * 40, "x\x0by " * 30]
    for k in range(60):
        parts = []
        while len(parts) < 260:
            p = [rng.choice("abc") + (str(rng.randint(0, 3)) if k % 2 else "") for _ in range(rng.randint(1, 40))]
            parts += p * rng.choice([1, 1, 2, 3, 4, 7]) + p[: rng.randint(0, len(p))]
        out.append(" ".join(parts))
    base = [f"w{rng.randint(0, 900)}" for _ in range(500)]
    out += [" ".join(base * 5), " ".join((base[:9] * 8 + base) * 3), "same " * 3000, " ".join(["ab"] * 50 + base + ["ab"] * 50)]
    return out


@pytest.mark.parametrize("how", [{}, {"long_bytes": 1, "lags": 37}])
def test_against_brute_force(spark, how):
    rows = list(enumerate(texts()))
    rows = [(k, t, "x", 1) for k, t in rows] + [(None, "a b c " * 20, "x", 1), (7, rows[7][1], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, row int").repartition(3)
    got = sorted((r.doc_id or -1, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs, **how).collect())
    want = []
    for k, t, *_ in rows:
        words = WORD.findall(t or "")
        found = brute_runs(words)
        want.append((k or -1, len(words), found, collapsed(words, found)))
    assert got == sorted(want)
    assert max(len(w[2]) for w in want) > 3


def test_empty_and_refused(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs(docs).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, exponent=2)


def test_query(spark, tmp_path):
    rows = list(enumerate(texts())) + [(k, " \n") for k in range(300, 340)] + [(k, f"p{k} " + "some words of a text that goes on for a while, and on. " * 6) for k in range(100, 180)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    changed = 0
    got = {r.doc_id: r for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    for k, t in rows:
        words = WORD.findall(t or "")
        n, h = len(words), zlib.crc32(str(k).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
            changed += 1
        found = brute_runs(words)
        r = got[k]
        assert r.n_runs == len(found)
        if found:
            best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (*best, 1000 * best[1] // best[2])
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
    assert changed > 5
