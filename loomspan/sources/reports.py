"""Text reports, graph drawings and query files."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import namespace_prefix
from loomspan.terms import SUBCLASS


def fixed_width(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """(value): one padded line a row."""
    return df.select(F.concat_ws(" | ", *[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ") for c, w in widths.items()]).alias("value"))


def markdown(df: DataFrame) -> DataFrame:
    """(value): a Markdown line a row; head() gives the first two."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown_head(columns: list[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]


def dot_edges(g: DataFrame, prefixes: dict[str, str], colours: dict[str, str]) -> DataFrame:
    """(value): the class hierarchy as lines of a DOT graph, blank nodes left out, nodes coloured by namespace."""
    e = g.where((F.col("p") == SUBCLASS) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")).select("s", "o").distinct()
    name = lambda c: namespace_prefix(F.col(c), prefixes)
    colour = F.lit("white")
    for prefix, c in colours.items():
        colour = F.when(F.col("n").startswith(prefixes[prefix]), c).otherwise(colour)
    nodes = e.select(F.col("s").alias("n")).unionByName(e.select(F.col("o").alias("n"))).distinct()
    node = nodes.select(F.concat(F.lit('  "'), name("n"), F.lit('" [style=filled, fillcolor="'), colour, F.lit('"];')).alias("value"))
    return node.unionByName(e.select(F.concat(F.lit('  "'), name("s"), F.lit('" -> "'), name("o"), F.lit('";')).alias("value")))


def split_blocks(text: str) -> list[str]:
    """Queries of a file that separates them with lines of # ---."""
    return [b.strip() for b in re.split(r"(?m)^# ---.*$", text) if re.search(r"(?im)^\s*(select|construct)\b", b)]


def split_headed(text: str) -> list[dict]:
    """[{id, title, sparql}] of a file whose queries have headers such as "# CQ1 — title"."""
    heads = list(re.finditer(r"(?m)^# ((?:CQ|LLM)\d+) — ?(.*)$", text))
    out = []
    for h, nxt in zip(heads, [*heads[1:], None], strict=True):
        body = text[h.end() : nxt.start() if nxt else len(text)]
        at = re.search(r"(?m)^PREFIX\b", body)
        if at:
            lines = [line for line in body[at.start() :].split("\n") if not line.startswith("# ---")]
            out.append({"id": h[1], "title": h[2].strip(), "sparql": "\n".join(lines).strip()})
    return out


def headed_queries(files: DataFrame, text: str = "text", key: str = "file") -> DataFrame:
    """(file, pos, id, title, sparql, blocks) of a table of query files: a row for each query under a header, and how many blocks its file has.

    A null or empty text has no queries; extra columns are ignored.
    """
    kind = files.schema[key].dataType.simpleString()

    def work(it):
        for b in it:
            for i, t in enumerate(b.column(1).to_pylist()):
                found = split_headed(t or "")
                n = len(found)
                cols = [b.column(0).slice(i, 1).take(pa.array([0] * n, pa.int32())), pa.array(range(n), pa.int32()), *[pa.array([q[c] for q in found], pa.string()) for c in ("id", "title", "sparql")], pa.array([len(split_blocks(t or ""))] * n, pa.int32())]
                yield pa.record_batch(cols, names=["key", "pos", "id", "title", "sparql", "blocks"])

    rows = files.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, f"key {kind}, pos int, id string, title string, sparql string, blocks int").withColumnRenamed("key", key)


def run_queries(g: DataFrame, blocks: list[dict]) -> list[dict]:
    """Each query's row count, up to three sample rows and the time; a query that fails is an error of its own."""
    import time

    from loomspan.operators.sparql import Engine

    engine, out = Engine(g), []
    for b in blocks:
        began = time.time()
        try:
            df = engine.run(b["sparql"])
            n = df.count()
            out.append({"id": b["id"], "status": "PASS" if n else "EMPTY", "rows": n, "sample": [r.asDict() for r in df.limit(3).collect()], "ms": round(1000 * (time.time() - began))})
        except Exception as e:  # noqa: BLE001  one bad query must not stop the others
            out.append({"id": b["id"], "status": "ERROR", "rows": 0, "error": str(e)[:300], "ms": round(1000 * (time.time() - began))})
    return out
