"""Turtle files in splits.

A split begins at some line, maybe inside a long string, a list or a nested
node, and the dot that ends a statement can only be told from others if that is
known. So a first pass goes over each split from each of the three states that
a line can begin in (outside, in a long string of double or of single quotes)
and notes the state it ends in, by how much brackets have opened, at which
depths dots stand, and the prefixes that are declared. Put together file by
file these tell each split its state, its depth and its prefixes; they are some
hundred bytes for each split, and all that reaches the driver.

A split as Spark reads it is cut into blocks of lines, which are the splits in
all that follows, so that a task holds a block and not its share of a file.

A second pass parses the whole statements of each split. What stands before its
first end and behind its last is a part of a statement that other splits hold
the rest of: those parts meet by the split where their statement began.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.session import written
from loomspan.sources.turtle import TOKEN, TurtleError, TurtleParser, scope_of
from loomspan.terms import COLUMNS

#: States at a line's start: outside of long strings, or in one of these quotes.
OUTSIDE, STATES = "", ("", '"""', "'''")
#: Nothing is given back in them, so a match that fails at the end of a text keeps no state for each character.
CLOSE = {'"""': re.compile(r'(?:[^"\\]++|\\.|"(?!""))*+"""', re.S), "'''": re.compile(r"(?:[^'\\]++|\\.|'(?!''))*+'''", re.S)}
#: Splits and declarations of prefixes that the driver takes.
MOST = 2_000_000
#: Characters of statements that are parsed together.
PIECE = 1 << 20
#: Characters of a block of lines.
BLOCK = 4 << 20


@dataclass
class Summary:
    """What a split does to the state that it is entered in."""

    state: str
    depth: int = 0
    dots: set[int] = field(default_factory=set)
    declared: list[tuple[str, str]] = field(default_factory=list)
    first: list[str] = field(default_factory=list)
    last: list[str] = field(default_factory=list)


def tokens(text: str, state: str) -> Iterator[tuple[str, str, int]]:
    """(kind, token, end) of a text entered in a state; at last ("state", the state at its end, its length)."""
    at = 0
    if state:
        m = CLOSE[state].match(text)
        if not m:
            yield "state", state, len(text)
            return
        yield "long", "", m.end()
        at = m.end()
    while at < len(text):
        quotes = text[at : at + 3]
        if quotes in CLOSE:
            m = CLOSE[quotes].match(text, at + 3)
            if not m:
                yield "state", quotes, len(text)
                return
            yield "long", quotes, m.end()
            at = m.end()
            continue
        m = TOKEN.match(text, at)
        if not m or m.end() == at:  # no Turtle from this state; the parser reports it if it is the true one
            at += 1
            continue
        at = m.end()
        if m.lastgroup:
            yield m.lastgroup, m[0], at
    yield "state", OUTSIDE, len(text)


def declarations(toks: list[str]) -> list[tuple[int, str, str]]:
    """(place of the last token, name, address) of the prefixes and bases declared in some tokens; the name of a base is None's text."""
    out = []
    for i, t in enumerate(toks):
        word = t.lower().lstrip("@")
        if word == "prefix" and i + 2 < len(toks) and toks[i + 1].endswith(":") and toks[i + 2].startswith("<"):
            out.append((i + 2, toks[i + 1], toks[i + 2][1:-1]))
        elif word == "base" and i + 1 < len(toks) and toks[i + 1].startswith("<"):
            out.append((i + 1, "", toks[i + 1][1:-1]))
    return out


def summary(text: str, state: str) -> Summary:
    out = Summary(state)
    for kind, t, _ in tokens(text, state):
        if kind == "state":
            out.state = t
            break
        if kind == "op" and t in "[(":
            out.depth += 1
        elif kind == "op" and t in "])":
            out.depth -= 1
        elif kind == "op" and t == ".":
            out.dots.add(out.depth)
        word = t if kind in ("iri", "name", "word", "lang") else "."  # only those make declarations
        if len(out.first) < 3:
            out.first.append(word)
        out.last = [*out.last, word][-3:]
        if kind == "iri":
            out.declared += [(n, a) for end, n, a in declarations(out.last) if end == len(out.last) - 1]
    return out


@dataclass(frozen=True)
class Entry:
    """How a split is entered: its number in the file, the state, the depth, the split where the open statement began (-1 for the first), and the prefixes."""

    number: int
    state: str
    depth: int
    began: int
    prefixes: dict[str, str]
    base: str


def entries(splits: list[dict[str, Summary]]) -> list[Entry]:
    """The entries of a file's splits, in order, and one more for its end."""
    state, depth, began, prefixes, base, tail, out = OUTSIDE, 0, -1, {}, "", [], []

    def declare(found: list[tuple[str, str]]) -> None:
        nonlocal prefixes, base
        for name, address in found:
            resolved = address if not base or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", address) else base + address
            if name:
                prefixes = prefixes | {name[:-1]: resolved}
            else:
                base = address

    for number, by_state in enumerate(splits):
        s = by_state[state]
        both = [*tail, *s.first]
        declare([(n, a) for end, n, a in declarations(both) if end >= len(tail) and not _within(both, len(tail), end, n)])
        out.append(Entry(number, state, depth, began, prefixes, base))
        declare(s.declared)
        if any(depth + d == 0 for d in s.dots):
            began = number
        depth, state = depth + s.depth, s.state
        tail = s.last if len(s.last) == 3 else [*tail, *s.last][-3:]
    return [*out, Entry(len(splits), state, depth, began, prefixes, base)]


def _within(both: list[str], cut: int, end: int, name: str) -> bool:
    """Whether a declaration that ends at a place lies behind the cut as a whole."""
    return end - (2 if name else 1) >= cut


def _by_split(it: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[str, tuple[int, int], str]]:
    """(path, (start, number), text) of the blocks of the splits that a task reads, from rows (path, start, line) in the order of the scan.

    A block ends with the line that fills it, so the same splits always give the same blocks.
    """
    now, number, lines, size = None, 0, [], 0

    def taken() -> str:
        nonlocal lines, size
        lines.append("")
        text, lines, size = "\n".join(lines), [], 0
        return text

    for b in it:
        for path, start, line in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
            if (path, start) != now:
                if lines:
                    yield now[0], (now[1], number), taken()
                now, number = (path, start), 0
            lines.append(line)
            size += len(line) + 1
            if size >= block:
                yield path, (start, number), taken()
                number += 1
    if lines:
        yield now[0], (now[1], number), taken()


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    meta = lambda c: F.col(f"_metadata.{c}")
    # line feeds alone end lines, so that joined lines are the file again
    return spark.read.option("lineSep", "\n").text(path).select(meta("file_path").alias("path"), meta("file_block_start").alias("start"), "value")


def _summaries(lines: DataFrame, block: int) -> dict[str, dict[tuple[int, int], dict[str, Summary]]]:
    """Summaries by path and by start and number of the block."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, (start, number), text in _by_split(it, block):
            rows = [(st, s.state, s.depth, sorted(s.dots), [list(d) for d in s.declared], s.first, s.last) for st in STATES for s in [summary(text, st)]]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.string())), pa.list_(pa.string()), pa.list_(pa.string())]
            cols = [pa.array([path] * len(rows)), *[pa.array([x] * len(rows), pa.int64()) for x in (start, number)], *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]]
            yield pa.record_batch(cols, names=["path", "start", "number", "entered", "state", "depth", "dots", "declared", "first", "last"])

    out: dict[str, dict[tuple[int, int], dict[str, Summary]]] = {}
    size = 0
    for r in lines.mapInArrow(work, "path string, start long, number long, entered string, state string, depth long, dots array<long>, declared array<array<string>>, first array<string>, last array<string>").toLocalIterator():
        size += 1 + len(r.declared)
        if size > MOST:
            raise TurtleError(f"more than {MOST} splits and declarations: raise spark.sql.files.maxPartitionBytes")
        out.setdefault(r.path, {}).setdefault((r.start, r.number), {})[r.entered] = Summary(r.state, r.depth, set(r.dots), [tuple(d) for d in r.declared], r.first, r.last)
    return out


def ends_of(text: str, state: str, depth: int) -> list[int]:
    """Where statements end in a split."""
    out = []
    for kind, t, end in tokens(text, state):
        if kind == "op":
            depth += (t in "[(") - (t in "])")
            if t == "." and depth == 0:
                out.append(end)
    return out


def _parser(e: Entry, scope: str, own: str) -> TurtleParser:
    p = TurtleParser("", scope, own)
    p.prefixes, p.base = dict(e.prefixes), e.base
    return p


def read_split(spark: SparkSession, path: str | list[str], block: int = BLOCK) -> DataFrame:
    """The distinct triples of Turtle files that are read in splits of any size.

    They are those of a parse of each file as a whole, but for the names of
    nodes without a label. A file with a statement that doesn't end, or that is
    no Turtle, raises TurtleError when it is read; empty files have no triples.
    """
    known = {}
    for file, splits in _summaries(_lines(spark, path), block).items():
        made = entries([splits[s] for s in sorted(splits)])
        known |= {(file, s): made[k] for k, s in enumerate(sorted(splits))} | {(file, None): made[-1]}
    after = {(file, e.number): e for (file, _), e in known.items()}

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(began: int, number: int, text: str) -> pa.RecordBatch:
            cols = [pa.nulls(1, pa.string()) for _ in COLUMNS] + [pa.array([file]), pa.array([began], pa.int32()), pa.array([number], pa.int32()), pa.array([text])]
            return pa.record_batch(cols, names=[*COLUMNS, "path", "began", "number", "text"])

        def triples(rows: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array([r[i] for r in rows], pa.string()) for i in range(7)] + [pa.nulls(len(rows), t) for t in (pa.string(), pa.int32(), pa.int32(), pa.string())]
            return pa.record_batch(cols, names=[*COLUMNS, "path", "began", "number", "text"])

        for file, start, text in _by_split(it, block):
            e = known[file, start]
            ends = ends_of(text, e.state, e.depth)
            if not ends:
                yield part(e.began, e.number, text)
                continue
            yield part(e.began, e.number, text[: ends[0]])
            yield part(e.number, e.number, text[ends[-1] :])
            p = _parser(e, scope_of(file), f"{scope_of(file)}.{e.number}")
            for _, name, address in declarations([t for kind, t, _ in tokens(text[: ends[0]], e.state) if kind != "state"]):
                if name:
                    p.prefixes[name[:-1]] = p.resolve(address)
                else:
                    p.base = address
            at = ends[0]
            for k, end in enumerate(ends):
                if end - at >= PIECE or k == len(ends) - 1:
                    yield triples(p.read(text[at:end]).parse())
                    at = end

    schema = ", ".join(f"{c} string" for c in COLUMNS)
    parsed = written(_lines(spark, path).mapInArrow(work, f"{schema}, path string, began int, number int, text string"), "turtle-splits")
    parts = parsed.where("text is not null").groupBy("path", "began").agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("parts"))
    parts = parts.select("path", "began", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"))

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for file, began, text in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                rows = _parser(after[file, began + 1], scope_of(file), f"{scope_of(file)}.{began}p").read(text).parse()
                yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(7)], names=COLUMNS)

    rest = parts.mapInArrow(join, schema)
    return parsed.where("text is null").select(*COLUMNS).unionByName(rest).distinct()
