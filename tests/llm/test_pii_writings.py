"""One entity has one surrogate in all its writings, checked against a plain reading of the output."""

import random
import re

import pytest

from loomspan.llm.pii import anonymize

DOCS = "doc_id long, text string"


def luhn_number(rng):
    body = [rng.randrange(10) for _ in range(15)]
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(body))
    return "".join(map(str, body)) + str(-total % 10)


def writings(rng):
    """(kind, canonical value, writings) of some entities."""
    out = []
    for k in range(12):
        card = "4" + luhn_number(rng)[1:]
        four = [card[i : i + 4] for i in range(0, 16, 4)]
        out.append(("card", card, [card, " ".join(four), "-".join(four), " ".join(four)]))
        mail = f"ann.lee{k}@mail{k % 3}.example.com"
        out.append(("email", mail, [mail, mail.title(), mail.upper(), mail.capitalize()]))
        code = rng.choice(["+44", "+1", "+353", "+49", "+7"])
        parts = [f"{rng.randint(20, 99)}", f"{rng.randint(1000, 9999)}", f"{rng.randint(1000, 9999)}"]
        out.append(("phone", code + "".join(parts), [code + "".join(parts), code + " " + " ".join(parts), code + "-" + "-".join(parts), code + "." + ".".join(parts)]))
        ip = ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8))
        out.append(("ipv6", ip, [ip, ip.upper()]))
    return out


def bare(kind, text):
    return re.sub("[^0-9+]", "", text) if kind in ("card", "phone") else text.lower()


@pytest.fixture(scope="module")
def result(spark):
    rng = random.Random(12)
    known = writings(rng)
    rows = [(100 * k + j, f"Before this {w} and after.") for k, (_, _, ws) in enumerate(known) for j, w in enumerate(ws)]
    rng.shuffle(rows)
    out = {r.doc_id: r.text for r in anonymize(spark.createDataFrame(rows, DOCS).repartition(3), "key").collect()}
    return known, {k: t.removeprefix("Before this ").removesuffix(" and after.") for k, t in out.items()}


def test_writings_agree_and_differ_from_others(result):
    known, out = result
    seen = {}
    for k, (kind, value, ws) in enumerate(known):
        made = {bare(kind, out[100 * k + j]) for j in range(len(ws))}
        assert len(made) == 1, (kind, ws, [out[100 * k + j] for j in range(len(ws))])
        assert made != {value} and seen.setdefault((kind, next(iter(made))), k) == k
        for j, w in enumerate(ws):
            assert re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", w))) == re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", out[100 * k + j]))) or kind == "ipv6"


def test_country_codes_stay(result):
    known, out = result
    for k, (kind, _, ws) in enumerate(known):
        if kind == "phone":
            code = re.match(r"\+\d+", ws[1])[0]
            assert all(out[100 * k + j].startswith(code) and out[100 * k + j] != w for j, w in enumerate(ws))


def test_ipv6_keeps_its_groups(spark, result):
    known, out = result
    for k, (kind, _, ws) in enumerate(known):
        if kind == "ipv6":
            assert [len(g) for g in out[100 * k].split(":")] == [len(g) for g in ws[0].split(":")]
    rows = [(1, "at 2001:db8::7 and fe80::1 end"), (2, "std::vector<int> a::b, 12:30:45 and ::"), (3, "x 2001:DB8::7 y")]
    got = {r.doc_id: r.text for r in anonymize(spark.createDataFrame(rows, DOCS), "key").collect()}
    assert "2001:db8::7" not in got[1] and "fe80::1" not in got[1] and re.fullmatch(r"at [0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f] and [0-9a-f]{4}::[0-9a-f] end", got[1])
    assert got[2] == rows[1][1]
    assert got[3].lower()[2:-2] == got[1].split()[1]


def test_initials_without_a_title_agree_with_those_behind_one(spark):
    rows = [(1, "Mr J. Brown came. Later J. Brown left, and J.R. Brown; Brown too. I. Then K. Green.")]
    got = anonymize(spark.createDataFrame(rows, DOCS), "key").first().text
    m = re.fullmatch(r"Mr (\w)\. (\w+) came\. Later (\w)\. (\w+) left, and (\w)\.(\w)\. (\w+); (\w+) too\. I\. Then K\. Green\.", got)
    assert m and len({m[1], m[3], m[5]}) == 1 and len({m[2], m[4], m[7], m[8]}) == 1 and m[1] != "J" and m[2] != "Brown"
