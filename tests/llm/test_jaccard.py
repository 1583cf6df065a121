import random
import re

import pytest

from loomspan.llm.simhash import near_copies

SPACE = r"[^\x20\x09-\x0D]+"


def shingles(t):
    w = re.findall(SPACE, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_groups(rows):
    """The smallest key of each row's component, by comparing every pair."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, least.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def rows(corpus):
    """The corpus with families of near copies at all similarities, and boilerplate that everyone shares."""
    rng = random.Random(5)
    line = " all rights of this text are reserved by whoever wrote it and by no one else at all"
    out = list(corpus)
    for f in range(6):
        w = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([5, 9, 30, 64, 200]))]
        for k in range(14):
            x = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                x[rng.randrange(len(x))] = f"z{rng.randint(0, 99)}"
            out.append((1000 + 20 * f + k, " ".join(x) + (line if f % 2 else "")))
    return [*out, (2000, "Four Words  Only here"), (2001, "four words only HERE"), (None, out[-1][1]), (5, "five is a repeated key with another text")]


@pytest.mark.parametrize("how", [{}, {"block": 2, "stars": 0, "most": 0}, {"block": 3, "stars": 1}])
def test_groups_against_brute_force(spark, rows, empty, how):
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **how)
    assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=str) == brute_groups(rows)
    assert near_copies(empty, **how).count() == 0


def test_pipeline_stage_drops_near_copies(spark):
    import corpus_pipeline as p

    words = [f"w{i}" for i in range(64)]
    near = [*words[:60], "other", *words[61:]]
    far = [*words[:40], *[f"v{i}" for i in range(24)]]
    rows = [(k, " ".join(w), "en", "s", 1) for k, w in [(2, words), (56, near), (60, far), (None, words), (None, far[::-1])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = p.keep_one_of_each(spark, docs, "")
    assert left.columns == list(p.COLUMNS)
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 0, 2, 60]
