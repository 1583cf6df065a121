import random

import numpy as np
import pytest
from test_near_and_substring import brute_substring

from loomspan.llm import substring


def test_strings_are_compared_by_their_bytes_when_hashes_collide():
    """Three phrases under one trigger number: the third has other bytes there, so it shares nothing with the first two."""
    rng = random.Random(1)
    text = lambda n: bytes(rng.randrange(97, 101) for _ in range(n))
    gram, left, right = text(50), text(50), text(50)
    bodies = [left + gram + right, left[:20] + text(30) + gram + right, left + text(50) + right]
    args = [np.array(x) for x in ([7, 7, 7], [50, 50, 50], [0, 0, 0], [1, 2, 3], [1, 1, 2], [1000, 2000, 3000])]
    found = substring.later_strings(*args, np.frombuffer(b"".join(bodies), np.uint8), 100)
    got = sorted((int(p), int(s)) for rows, starts in found for p, s in zip(rows, starts, strict=True))
    common = next(k for k in range(51) if bodies[1][49 - k] != left[49 - k])
    assert got == [(1, 2050 - e) for e in range(common, -1, -1)]


@pytest.mark.parametrize("batch", [300, 4 << 20])
def test_repetitive_texts_with_changed_bytes(spark, batch):
    rng = random.Random(4)
    base = "".join(rng.choice("ab") for _ in range(700))
    rows = []
    for k in range(40):
        t = list(base[rng.randint(0, 200) : rng.randint(300, 700)])
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("abc\0")
        rows.append((k, "".join(t)))
    rows += [(50, "\0" * 250), (51, "x" + "\0" * 130), (None, base), (52, base + base), (53, "same " * 90), (54, "same " * 90 + "!")]
    got: dict = {}
    for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batch_bytes=batch).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert got == brute_substring(rows)
