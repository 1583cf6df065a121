import random

import pytest

from loomspan.operators.matching import suffix_join
from loomspan.operators.table_functions import entity_function, instance_function


def test_instances_in_sql(spark):
    def complete(prompt):
        if "fail" in prompt:
            raise OSError("down")
        if "odd" in prompt:
            return "no json"
        return '```json\n{"instances": [{"uri_suffix": "a", "type": "T", "summary": 5}, {"type": "T"}, {"uri_suffix": "b", "type": "U"}, 7]}\n```'

    spark.udtf.register("instances_of", instance_function(complete, pause=0))
    spark.createDataFrame([(1, "good"), (2, "fail"), (3, "odd"), (4, None)], "id int, prompt string").createOrReplaceTempView("asked")
    got = sorted(tuple(r) for r in spark.sql("SELECT a.id, i.pos, i.uri_suffix, i.type, i.summary, i.error FROM asked a, LATERAL instances_of(a.prompt) i").collect())
    assert got[:2] == [(1, 0, "a", "T", "5", None), (1, 2, "b", "U", None, None)]
    assert [r[0] for r in got[2:]] == [2, 3] and got[2][-1] == "OSError: down" and got[3][-1].startswith("no answer") and all(r[1] is None for r in got[2:])


def test_entities_in_sql(spark):
    def load():
        def find(text):
            if text == "bad":
                raise ValueError("unreadable")
            return [(w, "CAP", text.index(w)) for w in text.split() if w.istitle()]

        return find

    spark.udtf.register("entities_of", entity_function(load))
    spark.createDataFrame([(1, "In Rome and Oslo"), (2, "bad"), (3, ""), (4, None)], "id int, text string").createOrReplaceTempView("read_texts")
    got = sorted(map(str, (tuple(r) for r in spark.sql("SELECT t.id, e.* FROM read_texts t, LATERAL entities_of(t.text) e").collect())))
    assert got == ["(1, 0, 'In', 'CAP', 0, None)", "(1, 1, 'Rome', 'CAP', 3, None)", "(1, 2, 'Oslo', 'CAP', 12, None)", "(2, None, None, None, None, 'ValueError: unreadable')"]


def test_suffixes_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    keys = [(k, word(rng.randint(1, 6))) for k in range(25)] + [(99, None), (98, "")]
    names = [word(rng.randint(0, 9)) for _ in range(200)] + [None, "", "ab", "ab"]
    got = sorted(map(str, ((r.name, r.key) for r in suffix_join(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(keys, "pos int, key string")).collect())))
    first = lambda n: min(((p, k) for p, k in keys if k and n is not None and n.endswith(k)), default=(0, None))[1]
    assert got == sorted(map(str, ((n, first(n)) for n in names)))
    empty = spark.createDataFrame([], "pos int, key string")
    assert [r.key for r in suffix_join(spark.createDataFrame([("x",)], "name string"), empty).collect()] == [None]
    with pytest.raises(ValueError):
        suffix_join(spark.createDataFrame([("x",)], "name string"), spark.createDataFrame(keys, "pos int, key string"), most=2)
