"""Turtle and N-Triples in and out.

Small Turtle files are one task each; files larger than a task's share are
read in splits (see split_turtle). N-Triples are lines and are read and written
by Spark's text source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.terms import COLUMNS, RDF, TRIPLE, XSD

TOKEN = re.compile(
    r'''\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<long>"""(?:[^"\\]++|\\.|"(?!""))*+"""|\'\'\'(?:[^'\\]++|\\.|'(?!''))*+\'\'\')|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')'''
    r"""|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<bnode>_:[\w.-]*\w)|(?P<num>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<name>(?:[^\W\d_][\w.-]*)?:(?:(?:[\w:%-]|\.(?=[\w:%.-])|\\.)*))"""
    r"""|(?P<word>[A-Za-z]+)|(?P<op>\^\^|[.;,\[\]()])""",
    re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class TurtleError(ValueError):
    """The text is not Turtle."""


def unescape(s: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else ESCAPES.get(m[1], m[1]), s, flags=re.S)


class TurtleParser:
    """Triples of one text; blank nodes carry the scope's name, so files don't share them, and nodes without a label that of their own scope, so parts of a file don't."""

    def __init__(self, text: str, scope: str, own: str | None = None) -> None:
        self.own = own or scope
        self.n = 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.scope = scope
        self.read(text)

    def read(self, text: str) -> TurtleParser:
        """Take another text, with the prefixes as they are."""
        self.toks, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m or m.end() == at:
                raise TurtleError(f"unreadable at {text[at : at + 40]!r}")
            at = m.end()
            if m.lastgroup:
                self.toks.append((m.lastgroup, m[0]))
        self.i = 0
        self.out: list[tuple] = []
        return self

    def peek(self) -> str:
        return self.toks[self.i][1] if self.i < len(self.toks) else ""

    def next(self) -> tuple[str, str]:
        if self.i >= len(self.toks):
            raise TurtleError("the text ends early")
        self.i += 1
        return self.toks[self.i - 1]

    def need(self, x: str) -> None:
        if (got := self.next()[1]) != x:
            raise TurtleError(f"{x} expected, not {got!r}")

    def fresh(self) -> tuple:
        self.n += 1
        return (f"_:{self.own}.g{self.n}", "bnode", None, None)

    def parse(self) -> list[tuple]:
        while self.i < len(self.toks):
            x = self.peek()
            if x.lower() in ("@prefix", "prefix"):
                self.i += 1
                name = self.next()[1][:-1]
                self.prefixes[name] = self.resolve(self.next()[1][1:-1])
                self._dot(x)
            elif x.lower() in ("@base", "base"):
                self.i += 1
                self.base = self.next()[1][1:-1]
                self._dot(x)
            else:
                if x == "[":
                    s = self.term()
                    if self.peek() != ".":
                        self.properties(s)
                else:
                    s = self.term()
                    self.properties(s)
                self.need(".")
        return self.out

    def _dot(self, word: str) -> None:
        if word.startswith("@"):
            self.need(".")

    def resolve(self, x: str) -> str:
        x = unescape(x)
        return x if not self.base or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", x) else self.base + x

    def properties(self, s: tuple) -> None:
        while True:
            p = self.term(verb=True)
            while True:
                self.emit(s, p, self.term())
                if self.peek() != ",":
                    break
                self.i += 1
            while self.peek() == ";":
                self.i += 1
            if self.peek() in (".", "]", ""):
                return
            if self.toks[self.i - 1][1] != ";":
                raise TurtleError(f"unexpected {self.peek()!r}")

    def emit(self, s: tuple, p: tuple, o: tuple) -> None:
        self.out.append((s[0], s[1], p[0], *o))

    def term(self, verb: bool = False) -> tuple:
        kind, x = self.next()
        if kind == "iri":
            return (self.resolve(x[1:-1]), "iri", None, None)
        if kind == "name":
            prefix, _, local = x.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix}:")
            return (self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "iri", None, None)
        if kind == "word":
            if x == "a" and verb:
                return (RDF + "type", "iri", None, None)
            if x in ("true", "false"):
                return (x, "literal", XSD + "boolean", None)
        if kind == "bnode":
            return (f"_:{self.scope}.{x[2:]}", "bnode", None, None)
        if kind == "num":
            return (x, "literal", XSD + ("double" if re.search("[eE]", x) else "decimal" if "." in x else "integer"), None)
        if kind in ("str", "long"):
            body = unescape(x[3:-3] if kind == "long" else x[1:-1])
            if self.i < len(self.toks) and self.toks[self.i][0] == "lang":
                return (body, "literal", None, self.next()[1][1:].lower())
            if self.peek() == "^^":
                self.i += 1
                return (body, "literal", self.term()[0], None)
            return (body, "literal", None, None)
        if x == "[":
            node = self.fresh()
            if self.peek() != "]":
                self.properties(node)
            self.need("]")
            return node
        if x == "(":
            items = []
            while self.peek() != ")":
                items.append(self.term())
            self.i += 1
            head = (RDF + "nil", "iri", None, None)
            for item in reversed(items):
                cell = self.fresh()
                self.emit(cell, (RDF + "first",), item)
                self.emit(cell, (RDF + "rest",), head)
                head = cell
            return head
        raise TurtleError(f"unexpected {x!r}")


_SCHEMA = pa.schema([(c, pa.string()) for c in COLUMNS])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(7)], schema=_SCHEMA)


def scope_of(path: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", path.rsplit("/", 1)[-1])


def read_turtle(spark: SparkSession, path: str | list[str], missing_ok: bool = False, split: bool | None = None) -> DataFrame:
    """The distinct triples of Turtle files; with missing_ok files that are not there count as empty.

    Files are read in splits if one of them is larger than
    spark.sql.files.maxPartitionBytes, or as ``split`` says.
    """
    if missing_ok:
        from loomspan.sources.json_io import existing

        path = existing(spark, path)
        if not path:
            return spark.createDataFrame([], TRIPLE)
    if split is None:
        conf = spark._jsparkSession.sessionState().conf()
        split = _largest(spark, path) > conf.filesMaxPartitionBytes()
    if split:
        from loomspan.sources.split_turtle import read_split

        return read_split(spark, path)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield _rows(TurtleParser(raw.as_py().decode(), scope_of(name)).parse())

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(work, ", ".join(f"{c} string" for c in COLUMNS)).distinct()


def _largest(spark: SparkSession, paths: str | list[str]) -> int:
    """Bytes of the largest file of some paths or patterns."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    most = 0
    for p in [paths] if isinstance(paths, str) else paths:
        h = jvm.org.apache.hadoop.fs.Path(p)
        fs = h.getFileSystem(conf)
        for found in fs.globStatus(h) or []:
            inside = fs.listStatus(found.getPath()) if found.isDirectory() else [found]
            most = max([most, *(f.getLen() for f in inside)])
    return most


def _quoted(x: Column) -> Column:
    out = x
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), out, F.lit('"'))


def term_text(value: Column, kind: Column, dt: Column, lang: Column, prefixes: dict[str, str] | None = None) -> Column:
    """A term as N-Triples, or with prefixes as Turtle writes it."""
    iri = F.concat(F.lit("<"), value, F.lit(">"))
    for prefix, uri in (prefixes or {}).items():
        local = F.substr(value, F.lit(len(uri) + 1))
        iri = F.when(value.startswith(uri) & local.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(F.lit(prefix + ":"), local)).otherwise(iri)
    node = F.concat(F.lit("_:b"), F.regexp_replace(F.substr(value, F.lit(3)), "[^A-Za-z0-9]", "_"))
    typed = F.concat(_quoted(value), F.coalesce(F.concat(F.lit("@"), lang), F.concat(F.lit("^^<"), dt, F.lit(">")), F.lit("")))
    return F.when(kind == "iri", iri).when(kind == "bnode", node).otherwise(typed)


def ntriples(g: DataFrame) -> DataFrame:
    """(value): a line for each triple."""
    null = F.lit(None).cast("string")
    s = term_text(F.col("s"), F.col("s_kind"), null, null)
    o = term_text(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"))
    return g.select(F.concat(s, F.lit(" <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def write_ntriples(g: DataFrame, path: str) -> None:
    ntriples(g).write.mode("overwrite").text(path)


NT_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*$'


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Triples of N-Triples lines, without Python; comments and blank lines go."""
    x = F.col(column)
    part = lambda i: F.regexp_extract(x, NT_LINE, i)
    rows = lines.where(x.rlike(NT_LINE)).select(part(1).alias("a"), part(2).alias("p"), part(3).alias("c"))
    bare = lambda c: F.when(c.startswith("<"), F.regexp_replace(c, "^<|>$", "")).otherwise(c)
    kind = lambda c: F.when(c.startswith("<"), "iri").when(c.startswith("_:"), "bnode").otherwise("literal")
    text = F.regexp_extract("c", r'^"((?:[^"\\]|\\.)*)"', 1)
    for a, b in (("\\\\", "\u0001"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\u0001", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    c = F.col("c")
    is_text = c.startswith('"')
    return rows.select(
        bare(F.col("a")).alias("s"), kind(F.col("a")).alias("s_kind"), "p", F.when(is_text, text).otherwise(bare(c)).alias("o"), kind(c).alias("o_kind"),
        F.when(is_text, F.nullif(F.regexp_extract("c", r'"\^\^<([^>]*)>$', 1), F.lit(""))).alias("o_dt"),
        F.when(is_text, F.lower(F.nullif(F.regexp_extract("c", r'"@([A-Za-z0-9-]+)$', 1), F.lit("")))).alias("o_lang"),
    ).distinct()


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


def turtle_blocks(g: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(s, value): a subject's triples as one block, sorted."""
    null = F.lit(None).cast("string")
    s = term_text(F.col("s"), F.col("s_kind"), null, null, prefixes)
    p = F.when(F.col("p") == RDF + "type", "a").otherwise(term_text(F.col("p"), F.lit("iri"), null, null, prefixes))
    o = term_text(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"), prefixes)
    per = g.select(s.alias("s"), p.alias("p"), o.alias("o")).groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_set("o")), ", ").alias("o"))
    line = F.concat("p", F.lit(" "), "o")
    return per.groupBy("s").agg(F.concat("s", F.lit(" "), F.array_join(F.array_sort(F.collect_list(line)), " ;\n    "), F.lit(" .\n")).alias("value"))


def write_turtle(g: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    """A folder of Turtle parts, each with the prefixes at its head, so each is a file of its own."""
    head = "".join(f"@prefix {k}: <{v}> .\n" for k, v in (prefixes or {}).items())
    blocks = turtle_blocks(g, prefixes).repartitionByRange(F.col("s")).sortWithinPartitions("s").select("value")

    def with_head(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in it:
            if first and b.num_rows and head:
                yield pa.record_batch([pa.array([head])], names=["value"])
                first = False
            yield pa.record_batch([b.column(0)], names=["value"])  # one schema, whatever the column's nullability

    blocks.mapInArrow(with_head, "value string").write.mode("overwrite").text(path)
