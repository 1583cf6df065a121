"""HTML to ordered paragraph events; what follows is window functions (operators.doctree)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHAPTER, ARTICLE, ANNEX = re.compile(r"cpt_[A-Z]+"), re.compile(r"art_\d+"), re.compile(r"anx_[A-Z]+")
CONTAINER = re.compile(r"\d{3}\.\d{3}(?:\.\d{3})*")
EVENT = "pos int, tag string, class string, chapter_id string, unit_id string, container_id string, text string"
VOID = {"br", "img", "hr", "meta", "link", "input", "col", "wbr", "source"}


class Events(HTMLParser):
    """Text of block elements with the ids of the divisions around it; scripts and styles are data and are left out."""

    def __init__(self, tags: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.divs, self.open, self.rows = tags, [], [], []
        self.quiet = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("script", "style"):
            self.quiet += 1
        elif tag == "div":
            self.divs.append(a.get("id") or "")
        if tag in self.tags:
            if tag == "p":  # a new paragraph ends one that was left open
                while self.open and self.open[-1][0] == "p":
                    self._close()
            self.open.append((tag, a.get("class"), list(self.divs), []))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.quiet = max(0, self.quiet - 1)
        elif tag == "div" and self.divs:
            while self.open and self.open[-1][0] != "div" and len(self.open[-1][2]) >= len(self.divs):  # what was left open in it ends with it
                self._close()
            self.divs.pop()
        if tag in self.tags and any(o[0] == tag for o in self.open):
            while self.open and self.open[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        if self.open and not self.quiet:
            self.open[-1][3].append(data)

    def close(self) -> None:
        super().close()
        while self.open:
            self._close()

    def _close(self) -> None:
        tag, cls, divs, parts = self.open.pop()
        last = lambda pattern: next((d for d in reversed(divs) if pattern.fullmatch(d)), None)
        text = re.sub(r"\s+", " ", "".join(parts)).strip()
        if text:
            self.rows.append((len(self.rows), tag, cls, last(CHAPTER), last(ARTICLE) or last(ANNEX), last(CONTAINER), text))


def events(pages: DataFrame, html: str = "html", key: str = "page_id", tags: tuple[str, ...] = ("p", "h1", "title", "li", "td")) -> DataFrame:
    """(key, pos, tag, class, chapter_id, unit_id, container_id, text) of each page's blocks, in order. A null page has none."""
    kind = pages.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in EVENT.split(", ")]

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, text in enumerate(b.column(1).to_pylist()):
                p = Events(frozenset(tags))
                p.feed(text or "")
                p.close()
                if p.rows:
                    keys = pa.array([0] * len(p.rows))
                    cols = [pa.array([r[k] for r in p.rows], pa.int32() if k == 0 else pa.string()) for k in range(7)]
                    yield pa.record_batch([b.column(0).slice(i, 1).take(keys), *cols], names=["key", *names])

    return pages.select(F.col(key).alias("key"), html).mapInArrow(work, f"key {kind}, {EVENT}").withColumnRenamed("key", key)


def first_block(pages: DataFrame, css_class: str, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, summary): the text of the first block of a class, else the first paragraph, else nothing."""
    e = events(pages, html, key, ("p", "div"))
    best = e.withColumn("_r", F.when(F.array_contains(F.split(F.coalesce("class", F.lit("")), " "), css_class), 0).when(F.col("tag") == "p", 1)).where("_r is not null")
    got = best.groupBy(key).agg(F.min_by("text", F.struct("_r", "pos")).alias("summary"))
    return pages.select(key).join(got, key, "left").withColumn("summary", F.coalesce("summary", F.lit("")))


def unit_number(unit: str = "unit_id"):
    """art_5 to 5, anx_IV to IV."""
    return F.regexp_replace(unit, r"^(art|anx|cpt)_", "")


def landed(pages: DataFrame, wanted: DataFrame, key: str = "url") -> DataFrame:
    """The expected keys that no page has: what a fetch failed to bring."""
    return wanted.join(pages.where("html is not null").select(key).distinct(), key, "left_anti")
