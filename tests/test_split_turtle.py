import random

import pytest

from loomspan.sources.split_turtle import STATES, ends_of, entries, read_split, summary
from loomspan.sources.turtle import TurtleError, TurtleParser, read_turtle

TEXT = '''@prefix ex: <http://e/> . # a comment with a dot . and "quotes" and [
@prefix
   xsd:
   <http://www.w3.org/2001/XMLSchema#> .
ex:a a ex:K ; ex:label "one. two"@en, 'it''s' ;
   ex:text """long. text with [ brackets ( and "quotes"
# no comment here .
@prefix ex: <http://wrong/> .
and an end \\""" of nothing .""" ;
   ex:n 1.5, -2, 3.0e7, true .
ex:b.c ex:list ( 1 ( "x" [ ex:p ex:q . ex:r ] ) ex:a ) .
'''.replace("'it''s'", '"it\'s"').replace("ex:q . ex:r", "ex:q")
MORE = """ex:node{i} ex:of [ ex:deep [ ex:deeper "v{i}" ; ex:n {i} ] ; ex:also ( {i} 2 ) ] .
_:x{i} ex:to _:shared ; ex:text '''single. [
{i} \""" not the end
'''; ex:end ex:e .
"""
TAIL = """PREFIX ex: <http://other/>
@base <http://base/> .
<rel> ex:a <http://abs/x> .
PREFIX
ex: <more/>
ex:z ex:y "last" .
[ ex:only "one" ] .
"""


def whole():
    return TEXT + "".join(MORE.replace("{i}", str(i)) for i in range(12)) + TAIL + "".join(MORE.replace("{i}", str(i)) for i in range(12, 15)) + "# the end . \n"


def plain(rows):
    """Triples with each node without a label named by what hangs on it; the nodes are trees here."""
    rows = [tuple(r) for r in rows]
    below: dict = {}
    for r in rows:
        below.setdefault(r[0], []).append(r)

    def name(x):
        if not x.startswith("_:") or ".g" not in x:
            return x
        return "[" + "|".join(sorted(f"{r[2]} {name(r[3])} {r[5]} {r[6]}" for r in below.get(x, []))) + "]"

    return sorted((name(r[0]), r[1], r[2], name(r[3]), *map(str, r[4:])) for r in rows)


@pytest.mark.parametrize("size", [120, 333, 700, 10**6])
def test_every_split_size_gives_the_parse_of_the_whole(spark, tmp_path, size):
    (tmp_path / "one.ttl").write_text(whole())
    (tmp_path / "two.ttl").write_text(TEXT.replace("http://e/", "http://two/"))
    (tmp_path / "none.ttl").write_text("")
    want = [r for f, t in (("one_ttl", whole()), ("two_ttl", TEXT.replace("http://e/", "http://two/"))) for r in TurtleParser(t, f).parse()]
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for k in keys:
        spark.conf.set(k, size)
    try:
        got = read_split(spark, str(tmp_path / "*.ttl")).collect()
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert plain(got) == sorted(set(plain(want))) or plain(got) == plain(set(want))
    assert len(got) == len(set(want))


def test_the_reader_splits_large_files_itself(spark, tmp_path):
    (tmp_path / "one.ttl").write_text(whole())
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    try:
        got = read_turtle(spark, str(tmp_path / "one.ttl"))
        assert "Union" in got._jdf.queryExecution().toString() and plain(got.collect()) == plain(set(TurtleParser(whole(), "one_ttl").parse()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_states_and_ends_at_random_cuts():
    """Ends of statements of the splits, moved to their places, are those of the whole text, wherever lines are cut."""
    text, rng = whole(), random.Random(6)
    lines = text.splitlines(keepends=True)
    for _ in range(30):
        cuts = sorted({0, len(lines), *rng.sample(range(len(lines)), rng.randint(1, 40))})
        parts = ["".join(lines[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        made = entries([{s: summary(p, s) for s in STATES} for p in parts])
        ends, at = [], 0
        for p, e in zip(parts, made, strict=False):
            ends += [at + x for x in ends_of(p, e.state, e.depth)]
            at += len(p)
        assert ends == ends_of(text, "", 0)
        assert made[-1].prefixes["ex"] == "http://base/more/" and made[-1].base == "http://base/" and made[-1].state == ""


@pytest.mark.parametrize("text", ["@prefix ex: <http://e/> .\nex:a ex:b ex:c", "nothing here at all .", '@prefix ex: <http://e/> .\nex:a ex:b """open .\n'])
def test_broken_files_are_reported(spark, tmp_path, text):
    (tmp_path / "bad.ttl").write_text(text)
    with pytest.raises(Exception, match="TurtleError"):
        read_split(spark, str(tmp_path / "bad.ttl")).collect()
    with pytest.raises(TurtleError):
        TurtleParser(text, "x").parse()
