import random

from loomspan.operators import matching


def plain_pairs(gold, predicted):
    free, hits = list(gold), 0
    for p in predicted:
        at = next((i for i, g in enumerate(free) if p == g or (p and g and (p in g or g in p))), None)
        if at is not None:
            free.pop(at)
            hits += 1
    return hits


def test_matching_is_greedy_without_python_groups(spark):
    rnd = random.Random(3)
    texts = ["", "a", "ab", "b", "abc", "bc", "c", "ab c", "EUR 5", "eur 5;"]
    schema = "sentence long, type string, pos int, text string"
    make = lambda: [(s, k, p, rnd.choice(texts)) for s in range(60) for k in ("M", None) for p in range(rnd.randrange(6))]
    gold, pred = make(), make()
    plain = lambda x: x.lower().rstrip(".,;:!?")
    want = {}
    for s, k in {r[:2] for r in gold + pred}:
        g, p = ([plain(r[3]) for r in rows if r[:2] == (s, k)] for rows in (gold, pred))
        tp = plain_pairs(g, p)
        want[s, k] = (tp, len(p) - tp, len(g) - tp)
    rnd.shuffle(gold)
    got = matching.match_entities(spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema))
    assert {(r.sentence, r.type): (r.tp, r.fp, r.fn) for r in got.collect()} == want
    assert "InArrow" not in got._jdf.queryExecution().toString()
