"""License scans by template markup.

A template is a license's wording with regions: ``[[...]]`` may be left out and
``{{a-b}}`` stands for a to b words of any kind. It is compiled into an
automaton over words: a row of items, each one word or any word, with jumps
past what may be left out. A stretch of a text is accepted if the automaton
consumes it whole, so the words outside regions must match exactly. Templates
begin and end with words that are mandatory; the automaton starts at places
where the first two stand.

Beside it plain phrases name licenses by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.textops import exact_words, lean, lowered, runs, slices

#: Bytes of words: digits, lower-case letters and what is not ASCII.
LETTER = np.zeros(256, dtype=bool)
LETTER[48:58] = LETTER[97:123] = LETTER[128:] = True
ANY = -2
#: Phrases that name a license, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: The wording of public licenses and of the notices that name them, with regions marked.
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
    "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] "
    "shall be included in all copies or substantial portions of the software"
)
_AS_IS = (
    " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose "
    "and noninfringement in no event shall {{1-12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
    "connection with the software or the use or other dealings in the software"
)
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under [[the]] [[terms of the]] mit license"),
    ("mit", _MIT),
    ("mit", _MIT + _AS_IS),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this {{1-3}} except in compliance with the license"),
    ("gpl-3.0", "this {{1-4}} is licensed under the [[terms of the]] gnu general public license version 3"),
    ("gpl-2.0", "this {{1-4}} is licensed under the [[terms of the]] gnu general public license version 2"),
    (
        "gpl-{}",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version {} of the license or at your option any later version",
    ),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] cc by nc 4 0"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] creative commons attribution noncommercial 4 0 international [[public]] license"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] cc by sa 4 0"),
    (
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code "
        "must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this "
        "list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
)


def _expanded(templates) -> list[tuple[str, str]]:
    """Templates with {} for a version, once for each."""
    return [(label.replace("{}", f"{v}.0"), text.replace("{}", v)) for label, text in templates for v in (("2", "3") if "{}" in label else ("",))]


@dataclass(frozen=True)
class Automaton:
    """items[i] is the word that leads from state i to i + 1 (a number, or ANY); closure[i] has the states that i stands for, jumps included."""

    label: str
    items: tuple[int, ...]
    closure: tuple[tuple[int, ...], ...]

    def end(self, words: list[int], start: int) -> int:
        """The end of the longest stretch from start on that is accepted, or -1."""
        states, best, last = set(self.closure[0]), -1, len(self.items)
        for k in range(start, len(words)):
            w = words[k]
            states = {s for i in states if i < last and self.items[i] in (w, ANY) for s in self.closure[i + 1]}
            if not states:
                break
            if last in states:
                best = k + 1
        return best


def compiled(label: str, text: str, numbers: dict[str, int]) -> Automaton:
    """The automaton of a template; words that are new get a number. Regions do not nest."""
    items: list[int] = []
    jumps: dict[int, list[int]] = {}
    opened = None
    for part in text.lower().replace("[[", " [[ ").replace("]]", " ]] ").split():
        if part == "[[":
            if opened is not None:
                raise ValueError(f"regions of {label} nest")
            opened = len(items)
        elif part == "]]":
            if opened is None:
                raise ValueError(f"a region of {label} ends that has not begun")
            jumps.setdefault(opened, []).append(len(items))
            opened = None
        elif part.startswith("{{") and part.endswith("}}"):
            low, _, high = part[2:-2].partition("-")
            for k in range(int(high or low)):
                if k >= int(low):
                    jumps.setdefault(len(items), []).append(len(items) + 1)
                items.append(ANY)
        else:
            items.append(numbers.setdefault(part, len(numbers)))
    closed: list[tuple[int, ...]] = [()] * (len(items) + 1)
    for i in range(len(items), -1, -1):
        closed[i] = tuple(sorted({i, *(s for j in jumps.get(i, ()) for s in closed[j])}))
    if opened is not None or len(items) < 3 or ANY in items[:1] or items[-1] == ANY or any(len(closed[i]) > 1 for i in (0, len(items) - 1)):
        raise ValueError(f"{label}: a template begins and ends with mandatory words, and its regions end")
    return Automaton(label, tuple(items), tuple(closed))


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(key, n_words, places, matches): places lists (label, start) of phrases, matches (label, start, end) of accepted stretches, by start and label.

    Words are runs of digits, letters and characters beyond ASCII, A-Z in lower
    case, counted from 0. At one start the longest accepted stretch of a label
    counts. A null or empty text has no words; repeated rows give repeated
    results, a null key stays null; extra columns are ignored; an empty table
    gives an empty result.
    """
    numbers: dict[str, int] = {}
    lines = [(label, [numbers.setdefault(w, len(numbers)) for w in line.split()]) for line, label in phrases]
    automata = [compiled(label, t, numbers) for label, t in _expanded(templates)]
    starts_of: dict[int, list[Automaton]] = {}
    for a in automata:
        starts_of.setdefault(a.items[0], []).append(a)
    known = pa.array([w.encode() for w in numbers], pa.large_binary())
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    match = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def found_in(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[list], list[list]]:
        low = lowered(data)
        inside = LETTER[low]
        begin, end = runs(inside, at)
        index, words = exact_words(low, inside, begin, end)
        number = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)
        w = number[index] if len(index) else np.zeros(0, np.int32)
        first = np.searchsorted(begin, at)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(first))
        places: list[list] = [[] for _ in at[1:]]
        matches: list[list] = [[] for _ in at[1:]]

        def standing(line: list[int]) -> np.ndarray:
            """Places where the words stand consecutively in one text."""
            n = len(w) - len(line) + 1
            if n <= 0:
                return np.zeros(0, np.int64)
            ok = owner[:n] == owner[len(line) - 1 :]
            for k, x in enumerate(line):
                ok &= w[k : k + n] == x
            return np.flatnonzero(ok)

        for label, line in lines:
            for p in standing(line).tolist():
                places[owner[p]].append((p - int(first[owner[p]]), label))
        for group in starts_of.values():
            for a in group:
                # a jump may follow the first word, or any word the second item
                hits = standing([a.items[0]]) if len(a.closure[1]) > 1 or a.items[1] == ANY else standing(list(a.items[:2]))
                for p in hits.tolist():
                    t = owner[p]
                    e = a.end(w[p : min(first[t + 1], p + len(a.items))].tolist(), 0)  # an item takes one word at most
                    if e > 0:
                        matches[t].append((p - int(first[t]), a.label, p - int(first[t]) + e))
        return np.diff(first), places, matches

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, j, data, at in slices(b.column(1)):
                n, places, matches = found_in(data, at)
                placed = [[{"label": x, "start": s} for s, x in sorted(p)] for p in places]
                matched = []
                for m in matches:
                    longest: dict[tuple, int] = {}
                    for s, x, e in m:
                        longest[s, x] = max(e, longest.get((s, x), 0))
                    matched.append([{"label": x, "start": s, "end": e} for (s, x), e in sorted(longest.items())])
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(placed, place), pa.array(matched, match)], names=["key", "n_words", "places", "matches"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words long, places array<struct<label:string,start:long>>, matches array<struct<label:string,start:long,end:long>>"
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(batches, schema).withColumnRenamed("key", key)


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    """score is 1 where a template accepts a stretch, 0.5 where only a phrase names a license, else 0."""
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda x: x["label"]) for c in cols]))), ",")
    starts = F.transform("places", lambda x: x["start"])
    score = F.when(F.size("matches") > 0, 1.0).when(F.size("places") > 0, 0.5).otherwise(0.0)
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("places").alias("base_labels"), labels("places", "matches").alias("labels"), score.alias("score"),
    )


def _regex(text: str) -> str:
    """A template as a regular expression over words that stand between single spaces."""
    out = []
    for part in text.replace("[[", " [[ ").replace("]]", " ]] ").split():
        if part.startswith("{{"):
            low, _, high = part[2:-2].partition("-")
            out.append(f"(?:[^ ]+ ){{{low},{high or low}}}")
        else:
            out.append({"[[": "(?:", "]]": ")?"}.get(part, part + " "))
    return " " + "".join(out)


def _sql() -> str:
    """DuckDB text: phrases by the words that follow, templates as regular expressions over the joined words."""
    named = ", ".join(f"case when regexp_matches(line, '{_regex(t)}') then '{label}' end" for label, t in _expanded(TEMPLATES))
    hits = " ".join(f"when concat_ws(' ', {', '.join(['word', 'w2', 'w3'][: len(p.split())])}) = '{p}' then '{label}'" for p, label in PHRASES)
    return rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
w as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) - 1 as i from d),
n as (select *, lead(word) over x as w2, lead(word, 2) over x as w3 from w window x as (partition by doc_id order by i)),
p as (select doc_id, i, case {hits} end as label from n),
b as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, list(distinct label) as found from p where label is not null group by doc_id),
m as (select doc_id, len(words) as n_words, [x for x in [{named}] if x is not null] as matched from (select *, ' ' || array_to_string(words, ' ') || ' ' as line from d))
select m.doc_id, n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(array_to_string(list_sort(found), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(matched, coalesce(found, [])))), ','), '') as labels,
       case when len(matched) > 0 then 1.0::double when n_base > 0 then 0.5::double else 0.0::double end as score
from m left join b using (doc_id)"""


OP12_SQL = _sql()
