"""A SPARQL subset over triple tables, compiled to DataFrames.

SELECT [DISTINCT] and CONSTRUCT; basic graph patterns with ``a``, ``;``, ``,``
and the paths ``p*`` and ``p+``; OPTIONAL, UNION, FILTER, BIND; GROUP BY with
COUNT, SUM, AVG, MIN, MAX; ORDER BY; LIMIT. A solution is a row with one struct
(lexical form, kind, datatype, language) for each variable; null is unbound.
Expressions that fail are null, so a filter on them drops the row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.paths import closure
from loomspan.terms import RDF, XSD, encode_for_uri

TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<var>[?$]\w+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')(?P<tail>@[A-Za-z-]+)?"""
    r"""|(?P<num>\d+(?:\.\d+)?)|(?P<name>(?:[A-Za-z_][\w.-]*)?:[\w.-]*[\w-]|(?:[A-Za-z_][\w-]*)?:)|(?P<word>[A-Za-z_]\w*)|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}().;,=<>!*/+\-])"""
)
NUMERIC = [XSD + t for t in ("decimal", "integer", "double", "float", "int", "long")]
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX"}
KIND = "struct<v:string,k:string,dt:string,lang:string>"


class SparqlError(ValueError):
    """The text is outside the subset."""


@dataclass
class Group:
    parts: list = field(default_factory=list)


@dataclass
class Query:
    form: str
    distinct: bool
    select: list
    template: list
    where: Group
    group: list
    order: list
    limit: int | None


class Parser:
    def __init__(self, text: str) -> None:
        self.toks: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"unreadable at {text[at : at + 30]!r}")
            at = m.end()
            kind = m.lastgroup if m.lastgroup != "tail" else "str"
            if kind:
                self.toks.append((kind, m[0]))
        self.i, self.prefixes = 0, {}

    def peek(self, *words: str) -> bool:
        return self.i < len(self.toks) and self.toks[self.i][1].upper() in words and self.toks[self.i][0] in ("word", "op")

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise SparqlError(f"{word} expected at {self.toks[self.i : self.i + 3]}")

    def next(self) -> tuple[str, str]:
        if self.i >= len(self.toks):
            raise SparqlError("the text ends early")
        self.i += 1
        return self.toks[self.i - 1]

    def query(self) -> Query:
        while self.take("PREFIX"):
            name = self.next()[1]
            self.prefixes[name[:-1]] = self.next()[1][1:-1]
        select, template, distinct = [], [], False
        if self.take("SELECT"):
            form, distinct = "select", self.take("DISTINCT")
            while not self.peek("WHERE", "{"):
                if self.take("*"):
                    select = None
                elif self.take("("):
                    e = self.expr()
                    self.need("AS")
                    select.append((self.next()[1][1:], e))
                    self.need(")")
                else:
                    v = self.next()[1][1:]
                    select.append((v, ("var", v)))
        else:
            self.need("CONSTRUCT")
            form = "construct"
            self.need("{")
            while not self.take("}"):
                template += self.triples()
                self.take(".")
        self.take("WHERE")
        where = self.group()
        by, order, limit = [], [], None
        if self.take("GROUP"):
            self.need("BY")
            while self.i < len(self.toks) and self.toks[self.i][0] == "var":
                by.append(self.next()[1][1:])
        if self.take("ORDER"):
            self.need("BY")
            while self.i < len(self.toks) and not self.peek("LIMIT"):
                down = self.take("DESC")
                if down or self.take("ASC") or self.peek("("):
                    self.need("(")
                    order.append((self.expr(), down))
                    self.need(")")
                else:
                    order.append((("var", self.next()[1][1:]), False))
        if self.take("LIMIT"):
            limit = int(self.next()[1])
        if self.i < len(self.toks):
            raise SparqlError(f"not in the subset: {self.toks[self.i : self.i + 3]}")
        return Query(form, distinct, select, template, where, by, order, limit)

    def group(self) -> Group:
        self.need("{")
        g = Group()
        while not self.take("}"):
            if self.take("OPTIONAL"):
                g.parts.append(("optional", self.group()))
            elif self.take("FILTER"):
                g.parts.append(("filter", self.expr()))
            elif self.take("BIND"):
                self.need("(")
                e = self.expr()
                self.need("AS")
                g.parts.append(("bind", self.next()[1][1:], e))
                self.need(")")
            elif self.peek("{"):
                arms = [self.group()]
                while self.take("UNION"):
                    arms.append(self.group())
                g.parts.append(("union", arms))
            else:
                g.parts += [("triple", t) for t in self.triples()]
            self.take(".")
        return g

    def term(self) -> tuple:
        kind, x = self.next()
        if kind == "var":
            return ("var", x[1:])
        if kind == "iri":
            return ("iri", x[1:-1], None, None)
        if kind == "name":
            prefix, _, local = x.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"unknown prefix {prefix}:")
            return ("iri", self.prefixes[prefix] + local, None, None)
        if kind == "num":
            return ("literal", x, XSD + ("decimal" if "." in x else "integer"), None)
        if kind == "str":
            body, _, lang = x.rpartition("@") if x[-1] not in "\"'" else (x, "", "")
            body = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body[1:-1])
            if self.take("^^"):
                return ("literal", body, self.term()[1], None)
            return ("literal", body, None, lang or None)
        if kind == "word" and x == "a":
            return ("iri", RDF + "type", None, None)
        if kind == "word" and x.lower() in ("true", "false"):
            return ("literal", x.lower(), XSD + "boolean", None)
        raise SparqlError(f"a term expected, not {x!r}")

    def triples(self) -> list:
        out, s = [], self.term()
        while True:
            p = self.term()
            path = "*" if self.take("*") else "+" if self.take("+") else ""
            while True:
                out.append((s, p, path, self.term()))
                if not self.take(","):
                    break
            if not self.take(";") or self.peek(".", "}"):
                return out

    def expr(self, level: int = 0) -> tuple:
        ops = (("||",), ("&&",), ("=", "!=", "<", ">", "<=", ">="), ("+", "-"), ("*", "/"))
        if level == len(ops):
            return self.primary()
        left = self.expr(level + 1)
        while True:
            if level == 2 and (self.peek("IN") or self.peek("NOT")):
                no = self.take("NOT")
                self.need("IN")
                self.need("(")
                items = [self.expr()]
                while self.take(","):
                    items.append(self.expr())
                self.need(")")
                left = ("in", left, items)
                left = ("!", left) if no else left
            elif self.peek(*ops[level]):
                left = ("op", self.next()[1], left, self.expr(level + 1))
            else:
                return left

    def primary(self) -> tuple:
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.take("!"):
            return ("!", self.primary())
        if self.take("-"):
            return ("op", "-", ("literal", "0", XSD + "integer", None), self.primary())
        kind, x = self.toks[self.i]
        if kind == "word" and x.lower() not in ("true", "false"):
            self.i += 1
            self.need("(")
            distinct, args = self.take("DISTINCT"), []
            if self.take("*"):
                args.append(("*",))
            while not self.take(")"):
                args.append(self.expr())
                self.take(",")
            return ("call", x.upper(), args, distinct)
        return self.term()


def _struct(v: Column, k: Column | str, dt: Column | str | None = None, lang: Column | str | None = None) -> Column:
    wrap = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(v.alias("v"), wrap(k).alias("k"), wrap(dt).alias("dt"), wrap(lang).alias("lang"))


def _constant(t: tuple) -> Column:
    return _struct(F.lit(t[1]), t[0], t[2], t[3])


@dataclass
class Value:
    """An expression: of type term, bool, num or str."""

    type: str
    col: Column

    def term(self) -> Column:
        if self.type == "term":
            return self.col
        dt = {"bool": XSD + "boolean", "num": XSD + "decimal", "str": None}[self.type]
        return F.when(self.col.isNotNull(), _struct(_plain(self.col) if self.type == "num" else self.col.cast("string"), "literal", dt))

    def text(self) -> Column:
        return self.col["v"] if self.type == "term" else self.col.cast("string")

    def number(self) -> Column:
        if self.type == "num":
            return self.col
        if self.type == "term":
            return F.when(self.col["dt"].isin(NUMERIC), self.col["v"].try_cast("decimal(38,10)"))
        return self.col.try_cast("decimal(38,10)")

    def truth(self) -> Column:
        if self.type == "bool":
            return self.col
        if self.type == "num":
            return self.col != 0
        return F.when(self.col["dt"] == XSD + "boolean", self.col["v"] == "true").otherwise(F.length(self.text()) > 0) if self.type == "term" else F.length(self.col) > 0


def evaluate(e: tuple, bound: set[str]) -> Value:
    kind = e[0]
    if kind == "var":
        return Value("term", F.col(e[1]) if e[1] in bound else F.lit(None).cast(KIND))
    if kind in ("iri", "literal"):
        return Value("term", _constant(e))
    if kind == "!":
        return Value("bool", ~evaluate(e[1], bound).truth())
    if kind == "in":
        left = evaluate(e[1], bound)
        return Value("bool", reduce(lambda a, b: a | b, [_compare("=", left, evaluate(x, bound)) for x in e[2]]))
    if kind == "op":
        op, a, b = e[1], evaluate(e[2], bound), evaluate(e[3], bound)
        if op in ("&&", "||"):
            return Value("bool", a.truth() & b.truth() if op == "&&" else a.truth() | b.truth())
        if op in "+-*/":
            x, y = a.number(), b.number()
            return Value("num", {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[op]())
        return Value("bool", _compare(op, a, b))
    _, name, args, _ = e
    if name == "BOUND":
        return Value("bool", evaluate(args[0], bound).col.isNotNull())
    v = [evaluate(x, bound) for x in args]
    texts = [x.text() for x in v]
    if name in ("STR", "LCASE", "UCASE", "ENCODE_FOR_URI"):
        return Value("str", {"STR": lambda x: x, "LCASE": F.lower, "UCASE": F.upper, "ENCODE_FOR_URI": encode_for_uri}[name](texts[0]))
    if name == "STRLEN":
        return Value("num", F.length(texts[0]).cast("decimal(38,10)"))
    if name == "CONCAT":
        return Value("str", F.concat(*texts))
    if name in ("CONTAINS", "STRSTARTS", "STRENDS"):
        return Value("bool", getattr(texts[0], {"CONTAINS": "contains", "STRSTARTS": "startswith", "STRENDS": "endswith"}[name])(texts[1]))
    if name in ("REGEX", "REPLACE"):
        flags = args[-1][1] if len(args) == (3 if name == "REGEX" else 4) else ""
        pattern = (f"(?{flags})" if flags else "") + args[1][1]
        if name == "REGEX":
            return Value("bool", texts[0].rlike(pattern))
        return Value("str", F.regexp_replace(texts[0], pattern, args[2][1]))
    if name in ("IRI", "URI"):
        return Value("term", F.when(texts[0].isNotNull(), _struct(texts[0], "iri")))
    if name == "STRDT":
        return Value("term", F.when(texts[0].isNotNull(), _struct(texts[0], "literal", texts[1])))
    if name == "STRLANG":
        return Value("term", F.when(texts[0].isNotNull(), _struct(texts[0], "literal", None, texts[1])))
    if name == "COALESCE":
        return Value("term", F.coalesce(*[x.term() for x in v]))
    if name in ("ISIRI", "ISURI", "ISLITERAL", "ISBLANK"):
        return Value("bool", v[0].term()["k"] == {"ISLITERAL": "literal", "ISBLANK": "bnode"}.get(name, "iri"))
    if name == "LANG":
        return Value("str", F.coalesce(v[0].term()["lang"], F.lit("")))
    if name == "DATATYPE":
        return Value("term", F.when(v[0].term()["dt"].isNotNull(), _struct(v[0].term()["dt"], "iri")))
    raise SparqlError(f"{name} is not in the subset")


def _compare(op: str, a: Value, b: Value) -> Column:
    fn = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    if "num" in (a.type, b.type):
        return fn(a.number(), b.number())
    x, y = a.number(), b.number()
    numeric = lambda v: F.coalesce(v.col["dt"].isin(NUMERIC), F.lit(False)) if v.type == "term" else F.lit(False)
    if a.type == b.type == "term" and op in ("=", "!="):
        return F.when(numeric(a) & numeric(b), fn(x, y)).otherwise(fn(a.col, b.col))
    return F.when(numeric(a) | numeric(b), fn(x, y)).otherwise(fn(a.text(), b.text()))


def _plain(n: Column) -> Column:
    """A decimal in its shortest form."""
    text = n.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def _extreme(v: Value, fn) -> Column:
    """The least or greatest term: by number if any value is one, else by lexical form. The term keeps its datatype; a number is in its shortest form."""
    number, text = fn(v.number()), fn(F.when(v.term().isNotNull(), F.struct(v.text().alias("v"), v.term()["k"].alias("k"), v.term()["dt"].alias("dt"), v.term()["lang"].alias("lang"))))
    return F.when(number.isNotNull(), _struct(_plain(number), "literal", XSD + "decimal")).otherwise(text)


def _downward(key: Column) -> Column:
    """A sort key (number, text) whose ascending order is the descending order of the key; null comes last."""
    codes = F.transform(F.regexp_extract_all(key["t"], F.lit("(?s)."), F.lit(0)), lambda c: -F.ascii(c))
    return F.struct(key["n"].isNull().alias("a"), (-key["n"]).alias("b"), key["t"].isNull().alias("c"), F.array_append(codes, F.lit(1)).alias("d"))


def _used(e) -> set[str]:
    """The variables of an expression."""
    if isinstance(e, tuple) and len(e) == 2 and e[0] == "var":
        return {e[1]}
    return set().union(*map(_used, e)) if isinstance(e, (tuple, list)) else set()


def _variables(kind: str, rest: list) -> set[str]:
    """The variables that a part of a group may bind."""
    if kind == "triple":
        return {x[1] for x in (rest[0][0], rest[0][1], rest[0][3]) if x[0] == "var"}
    if kind == "bind":
        return {rest[0]}
    groups = rest[0] if kind == "union" else [rest[0]] if kind == "optional" else []
    return {v for g in groups for k, *r in g.parts for v in _variables(k, r)}


@dataclass
class Solutions:
    """Rows with one column a variable; ``sure`` are the variables that are bound in every row, ``raw`` those that an engine holds in a form of its own."""

    df: DataFrame | None
    names: list[str]
    sure: set[str]
    raw: set[str] = field(default_factory=set)


class Engine:
    """Queries over one triple table."""

    def __init__(self, g: DataFrame) -> None:
        self.g = g.select("p", F.struct(F.col("s").alias("v"), F.col("s_kind").alias("k"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang")).alias("s"), F.struct(F.col("o").alias("v"), F.col("o_kind").alias("k"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang")).alias("o"), F.col("s").alias("sv"), F.col("o").alias("ov"), F.col("o_kind").alias("ok"))

    def scan(self, t: tuple, known: Solutions | None = None) -> Solutions:
        """Solutions of one pattern; known are those found so far, whose values a path starts from."""
        s, p, path, o = t
        if path:
            return self._path(s, p, path, o, known or Solutions(None, [], set()))
        df = self.g
        if p[0] == "iri":
            df = df.where(F.col("p") == p[1])
        if s[0] != "var":
            df = df.where(F.col("sv") == s[1])
        if o[0] != "var":
            df = df.where((F.col("ov") == o[1]) & (F.col("ok") == o[0]))
            if o[0] == "literal":
                df = df.where(F.col("o").eqNullSafe(_constant(o)))
        cols: dict[str, Column] = {}
        for term, col in ((s, F.col("s")), (p, _struct(F.col("p"), "iri")), (o, F.col("o"))):
            if term[0] == "var":
                if term[1] in cols:
                    df = df.where(col.eqNullSafe(cols[term[1]]))
                else:
                    cols[term[1]] = col
        return Solutions(df.select(*[c.alias(n) for n, c in cols.items()], *([] if cols else [F.lit(1).alias("_one")])), list(cols), set(cols))

    def edges(self, p: tuple) -> DataFrame:
        """(a, b): subjects and objects of a predicate, without literals."""
        return self.g.where((F.col("p") == p[1]) & (F.col("ok") != "literal")).select(F.col("s").alias("a"), F.col("o").alias("b"))

    def nodes(self) -> DataFrame:
        """(a): all subjects and objects."""
        return self.g.select(F.col("s").alias("a")).unionByName(self.g.select(F.col("o").alias("a")))

    def constant(self, t: tuple) -> Column:
        return _constant(t)

    def terms(self, s: Solutions, names: set[str]) -> Solutions:
        """The solutions with these variables as terms."""
        return s

    def _path(self, s: tuple, p: tuple, path: str, o: tuple, known: Solutions) -> Solutions:
        edges = self.edges(p)
        zero = path == "*"
        spark = edges.sparkSession
        back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        turned = lambda pairs: pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
        if o[0] != "var":  # from the constant backwards
            pairs = turned(closure(back, spark.range(1).select(self.constant(o).alias("a")), zero))
        elif s[0] != "var":
            pairs = closure(edges, spark.range(1).select(self.constant(s).alias("a")), zero)
        elif s[1] in known.sure:  # from what the variable is bound to
            pairs = closure(edges, known.df.select(F.col(s[1]).alias("a")).distinct(), zero)
        elif o[1] in known.sure:
            pairs = turned(closure(back, known.df.select(F.col(o[1]).alias("a")).distinct(), zero))
        else:
            pairs = closure(edges, (self.nodes() if zero else edges.select("a")).distinct(), zero)
        if s[0] != "var":
            pairs = pairs.where(F.col("a").eqNullSafe(self.constant(s)))
        if o[0] != "var":
            pairs = pairs.where(F.col("b").eqNullSafe(self.constant(o)))
        names = {t[1]: c for t, c in ((s, "a"), (o, "b")) if t[0] == "var"}
        return Solutions(pairs.select(*[F.col(c).alias(n) for n, c in names.items()]), list(names), set(names))

    def join(self, a: Solutions, b: Solutions, how: str = "inner", filters: list = ()) -> Solutions:
        """Solutions of both; in a left join the filters are part of its condition and see the variables of both sides.

        A shared variable that may be unbound on the left is compatible with
        anything where it is: those rows are joined without it and take its
        value from the right. One that may be unbound on the right is refused.
        """
        if a.df is None:
            return b if how == "inner" else self.join(Solutions(self.g.sparkSession.range(1).select(F.lit(1).alias("_one")), [], set()), b, how, filters)
        shared = [n for n in a.names if n in b.names]
        if unsure := [n for n in shared if n not in b.sure]:
            raise SparqlError(f"a join on variables that may be unbound: {unsure}")
        # a variable is compared in a form that both sides have it in
        used = set().union(*map(_used, filters))
        a, b = self.terms(a, used | {n for n in shared if n not in b.raw}), self.terms(b, used | {n for n in shared if n not in a.raw})
        if loose := [n for n in shared if n not in a.sure]:
            n = loose[0]
            bound = self.join(Solutions(a.df.where(F.col(n).isNotNull()), a.names, a.sure | {n}, a.raw), b, how, filters)
            rest = [x for x in a.names if x != n]
            free = self.join(Solutions(a.df.where(F.col(n).isNull()).select(*(rest or [F.lit(1).alias("_one")])), rest, set(a.sure), a.raw - {n}), b, how, filters)
            return Solutions(bound.df.unionByName(free.df.select(*bound.names)), bound.names, a.sure | b.sure if how == "inner" else set(a.sure), bound.raw)
        names = a.names + [n for n in b.names if n not in shared]
        # plain strings are the keys; what a literal has besides, its datatype and language, is mostly constant and folds away
        right = b.df.select(*[F.col(n).alias(f"_r_{n}" if n in shared else n) for n in b.df.columns])
        cond = []
        for n in shared:
            x, y = F.col(n), F.col(f"_r_{n}")
            cond += [x == y] if n in a.raw else [x["v"] == y["v"], x["k"] == y["k"], x["dt"].eqNullSafe(y["dt"]), x["lang"].eqNullSafe(y["lang"])]
        cond += [evaluate(f, set(names)).truth() for f in filters]
        if not shared and how == "inner":
            df = a.df.crossJoin(right)
        else:
            df = a.df.join(right, reduce(lambda x, y: x & y, cond) if cond else F.lit(True), how)
        return Solutions(df.select(*(names or ["_one"])), names, a.sure | b.sure if how == "inner" else set(a.sure), a.raw | b.raw)

    @staticmethod
    def ordered(parts: list, names: set[str]) -> list:
        """Neighbouring patterns in an order in which each shares a variable with those before it, where there is one, so that no product is made."""
        out, run = [], []

        def flush() -> None:
            known = set(names) | {v for kind, *rest in out for v in _variables(kind, rest)}
            while run:
                at = next((i for i, (_, t) in enumerate(run) if {x[1] for x in (t[0], t[1], t[3]) if x[0] == "var"} & known), 0)
                part = run.pop(at)
                out.append(part)
                known |= {x[1] for x in (part[1][0], part[1][1], part[1][3]) if x[0] == "var"}

        for part in parts:
            if part[0] == "triple":
                run.append(part)
            else:
                flush()
                out.append(part)
        flush()
        return out

    def group(self, g: Group) -> Solutions:
        out, filters = Solutions(None, [], set()), []
        for kind, *rest in self.ordered(g.parts, set()):
            if kind == "triple":
                out = self.join(out, self.scan(rest[0], out))
            elif kind == "optional":
                sub = self.group(Group([p for p in rest[0].parts if p[0] != "filter"]))
                conditions = []
                for f in [p[1] for p in rest[0].parts if p[0] == "filter"]:
                    if _used(f) & (set(out.names) - set(sub.names)):
                        conditions.append(f)  # it sees what is bound outside
                    else:
                        sub = self._filter(sub, f)
                out = self.join(out, sub, "left", conditions)
            elif kind == "union":
                arms = [self.group(a) for a in rest[0]]
                names = list(dict.fromkeys(n for a in arms for n in a.names))
                raw = {n for n in names if all(n in a.raw for a in arms if n in a.names)}
                arms = [self.terms(a, set(a.names) - raw) for a in arms]
                rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [a.df.select(*a.names) for a in arms])
                out = self.join(out, Solutions(rows.select(*names), names, set.intersection(*[a.sure for a in arms]), raw))
            elif kind == "bind":
                out = self.terms(out, _used(rest[1]))
                value = evaluate(rest[1], set(out.names)).term()
                base = out.df if out.df is not None else self.g.sparkSession.range(1)
                out = Solutions(base.select(*out.names, value.alias(rest[0])), [*out.names, rest[0]], out.sure | ({rest[0]} if rest[1][0] in ("iri", "literal") else set()), out.raw)
            else:
                filters.append(rest[0])
        for f in filters:
            out = self._filter(out, f)
        return out

    def _filter(self, s: Solutions, e: tuple) -> Solutions:
        s = self.terms(s, _used(e))
        return Solutions(s.df.where(evaluate(e, set(s.names)).truth()), s.names, s.sure, s.raw)

    def _aggregated(self, q: Query, s: Solutions) -> Solutions:
        counts = lambda e: e[0] == "call" and e[1] == "COUNT" and e[2][0][0] == "var"  # noqa: E731  it needs no term
        s = self.terms(s, set().union(*[_used(e) for n, e in q.select if e != ("var", n) and not counts(e)]))

        def agg(e: tuple) -> Column:
            if e[0] == "call" and e[1] in AGGREGATES:
                if e[2][0] == ("*",):
                    return F.count("*").cast("decimal(38,10)")
                if counts(e) and e[2][0][1] in s.raw:
                    return (F.countDistinct(e[2][0][1]) if e[3] else F.count(e[2][0][1])).cast("decimal(38,10)")
                v = evaluate(e[2][0], set(s.names))
                if e[1] == "COUNT":
                    return (F.countDistinct(v.term()) if e[3] else F.count(v.term())).cast("decimal(38,10)")
                if e[1] in ("MIN", "MAX"):
                    return _extreme(v, F.min if e[1] == "MIN" else F.max)
                return {"SUM": F.sum, "AVG": F.avg}[e[1]](v.number())
            raise SparqlError("only aggregates and group variables can be selected")

        made = [(n, e) for n, e in q.select if e != ("var", n)]
        df = s.df.groupBy(*q.group).agg(*[agg(e).alias(n) for n, e in made])
        cols = [F.col(n) if (n, ("var", n)) in q.select and n in q.group else None for n in q.group]
        df = df.select(*[c for c in cols if c is not None], *[(F.col(n) if e[1] in ("MIN", "MAX") else F.when(F.col(n).isNotNull(), _struct(_plain(F.col(n)) if e[1] != "COUNT" else F.col(n).cast("long").cast("string"), "literal", XSD + ("integer" if e[1] == "COUNT" else "decimal")))).alias(n) for n, e in made])
        return Solutions(df, [n for n, _ in q.select], s.sure, s.raw & set(q.group))

    def run(self, text: str, lexical: bool = True) -> DataFrame:
        """Solutions of a SELECT (lexical forms, or whole terms), or the triples of a CONSTRUCT."""
        q = Parser(text).query()
        s = self.group(q.where)
        if q.form == "construct":
            from loomspan.terms import COLUMNS

            s = self.terms(s, set().union(*[_used(tuple(t)) for t in q.template]))
            value = lambda t: evaluate(t, set(s.names)).col
            made = [F.struct(value(a)["v"].alias("s"), value(a)["k"].alias("s_kind"), value(b)["v"].alias("p"), value(c)["v"].alias("o"), value(c)["k"].alias("o_kind"), value(c)["dt"].alias("o_dt"), value(c)["lang"].alias("o_lang")) for a, b, _, c in q.template]
            each = s.df.select(F.explode(F.array(*made)).alias("t")).select("t.*")
            return each.where("s is not null and s_kind <> 'literal' and p is not null and o is not null").select(*COLUMNS).distinct()
        if q.select is None:
            q.select = [(n, ("var", n)) for n in s.names]
        if q.group or any(e[0] == "call" and e[1] in AGGREGATES for _, e in q.select):
            s = self._aggregated(q, s)
        else:
            for n, e in q.select:
                if n not in s.names:
                    s = self.terms(s, _used(e))
                    s = Solutions(s.df.withColumn(n, evaluate(e, set(s.names)).term()), [*s.names, n], s.sure, s.raw)
        shown = [n for n, _ in q.select]
        # a sort key that no pattern binds orders nothing
        if q.order:
            s = self.terms(s, set(s.names))
        keys = [(evaluate(e, set(s.names)), down) for e, down in q.order if e[0] != "var" or e[1] in s.names]
        both = [(F.struct(v.number().alias("n"), v.text().alias("t")), down) for v, down in keys]
        named = [(c.alias(f"_k{i}"), f"_k{i}", down) for i, (c, down) in enumerate(both)]
        df = s.df.select(*shown, *[c for c, _, _ in named])
        if q.distinct:
            if not named:
                df = df.distinct()
            elif not any(down for *_, down in named):
                df = df.groupBy(*shown).agg(F.min(F.struct(*[k for _, k, _ in named])).alias("_k")).select(*shown, *[F.col("_k")[k].alias(k) for _, k, _ in named])
            else:
                # the row that sorts first, by a partial aggregate: a descending key is compared upside down
                keys = [_downward(F.col(k)) if d else F.col(k) for _, k, d in named]
                first = F.min_by(F.struct(*[F.col(k).alias(k) for _, k, _ in named]), F.struct(*[k.alias(f"_o{i}") for i, k in enumerate(keys)]))
                df = df.groupBy(*shown).agg(first.alias("_k")).select(*shown, *[F.col("_k")[k].alias(k) for _, k, _ in named])
        if named:
            df = df.orderBy(*[F.desc(k) if d else F.asc(k) for _, k, d in named])
        if q.limit is not None:
            df = df.limit(q.limit)
        df = self.terms(Solutions(df.select(*shown), shown, s.sure, s.raw & set(shown)), set(shown)).df  # after DISTINCT and LIMIT there are fewer
        return df.select(*[F.col(n)["v"].alias(n) if lexical else F.col(n) for n in shown])


def sparql(g: DataFrame, text: str, lexical: bool = True) -> DataFrame:
    return Engine(g).run(text, lexical)
