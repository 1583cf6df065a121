import itertools
import random
import re

import duckdb
import pytest

from loomspan.llm.licenses import OP12_SQL, PHRASES, TEMPLATES, _expanded, compiled, op12_license_scan, scan_licenses

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def wordings(text):
    """Every sequence of words that a template of few regions stands for, by writing all choices out; a free word is '*'."""
    choices = []
    for part in re.findall(r"\[\[.*?\]\]|\{\{.*?\}\}|\S+", text):
        if part.startswith("[["):
            inner = wordings(part[2:-2])
            choices.append([[], *inner])
        elif part.startswith("{{"):
            low, _, high = part[2:-2].partition("-")
            choices.append([["*"] * n for n in range(int(low), int(high or low) + 1)])
        else:
            choices.append([[part]])
    return [list(itertools.chain(*c)) for c in itertools.product(*choices)]


def brute(text, templates):
    words = [w.decode() for w in WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))]
    places = sorted((i, label) for p, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    ends = {}
    for label, t in templates:
        for form in wordings(t):
            for i in range(len(words) - len(form) + 1):
                if all(f in ("*", w) for f, w in zip(form, words[i:], strict=False)):
                    ends[i, label] = max(ends.get((i, label), 0), i + len(form))
    return len(words), places, sorted((i, label, e) for (i, label), e in ends.items())


SMALL = [("x", "alpha beta [[gamma]] delta"), ("x", "alpha beta {{1-2}} omega"), ("y", "beta [[gamma delta]] [[delta]] alpha omega"), ("z", "alpha {{0-3}} beta beta")]


def test_automata_against_all_wordings(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "omega"]) for _ in range(rng.randint(0, 60)))) for k in range(120)]
    rows += [(None, "ALPHA-beta;delta"), (200, None), (201, ""), (201, ""), (202, "mit license mit  LICENSE, the Apache License"), (203, "alpha beta\x00delta é alpha betaé delta"), (204, "alpha beta " * 5000 + "delta")]
    docs = spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "doc_id long, text string, matches string, n_words int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, [(x.start, x.label) for x in r.places], [(x.start, x.label, x.end) for x in r.matches]) for r in scan_licenses(docs, templates=SMALL).collect())
    assert got == sorted((k if k is not None else -1, *brute(t, SMALL)) for k, t in rows)
    assert sum(len(g[3]) for g in got) > 50
    assert scan_licenses(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["[[a]] b c d", "a b {{1-2}}", "a b [[c", "a b c]] d", "a [[b [[c]] d]] e f"])
def test_templates_that_are_refused(text):
    with pytest.raises(ValueError):
        compiled("x", text, {})


def _written_out(text, full):
    text = re.sub(r"\[\[(.*?)\]\]", r"\1" if full else "", text)
    return re.sub(r"\{\{(\d+)-\d+\}\}", lambda m: " ".join(["Someone"] * int(m[1])), text)


def test_query_against_sql(spark, tmp_path):
    rows = [(None if k == 3 else k, t) for k, t in enumerate([None, "", "Released under the MIT License.", "no key: licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0 (the \"License\")", "This work is licensed under the GNU General Public License, version 3."])]
    rows += [(10 + 2 * k + full, "Before. " + _written_out(t, full).upper() + "; after") for k, (_, t) in enumerate(_expanded(TEMPLATES)) for full in (0, 1)]
    rows += [(200 + k, _written_out(t, 1).replace(" the ", " thee ", 1)) for k, (_, t) in enumerate(_expanded(TEMPLATES))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.asDict() for r in op12_license_scan(spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet' where doc_id is not null")
    want = c.sql(OP12_SQL).fetchall()
    names = [d[0] for d in c.sql(OP12_SQL).description]
    assert len(want) == len(rows) - 1
    for w in want:
        assert got[w[0]] == dict(zip(names, w, strict=True))
    for k, (label, _) in enumerate(_expanded(TEMPLATES)):
        assert {got[10 + 2 * k + full]["score"] for full in (0, 1)} == {1.0} and label in got[10 + 2 * k]["labels"].split(",")
