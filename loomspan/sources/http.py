"""Pages over HTTP: a Spark data source for numbered addresses, and fetching for tables of addresses.

Failures are rows, never exceptions: (url, status, html, error, attempts). A
page is asked for up to three times, with a pause that grows by the same step
each time; what a landing folder holds already is not asked for again.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomspan.sources.json_io import existing

PAGE = "url string, status int, html string, error string, attempts int"
_ARROW = pa.schema([("url", pa.string()), ("status", pa.int32()), ("html", pa.string()), ("error", pa.string()), ("attempts", pa.int32())])


@dataclass(frozen=True)
class Manner:
    """How pages are asked for: user agent, seconds until an attempt is given up, attempts, the step of the pauses between them, the pause after a page."""

    agent: str = "Mozilla/5.0 (compatible; loomspan)"
    timeout: float = 15.0
    attempts: int = 3
    step: float = 1.0
    pause: float = 0.0

    def __post_init__(self) -> None:
        if self.attempts < 1 or min(self.timeout, self.step, self.pause) < 0:
            raise ValueError("at least one attempt is made, and no time is negative")

    def get(self, url: str) -> tuple:
        """A row of PAGE. Anything but a status below 400 counts as a failure and is tried again."""
        status = error = None
        for turn in range(1, self.attempts + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout) as got:
                    body = got.read().decode(got.headers.get_content_charset() or "utf-8", "replace")
                time.sleep(self.pause)
                return (url, got.status, body, None, turn)
            except urllib.error.HTTPError as e:
                status, error = e.code, f"HTTP {e.code}"
            except Exception as e:  # any failure of a page is that page's row
                status, error = None, f"{type(e).__name__}: {e}"
            if turn < self.attempts:
                time.sleep(self.step * turn)
        time.sleep(self.pause)
        return (url, status, None, error, self.attempts)

    def batches(self, urls: Iterator[str], size: int = 16) -> Iterator[pa.RecordBatch]:
        """Rows of PAGE, a few at a time, so that a task never holds more."""
        rows: list[tuple] = []
        for url in urls:
            rows.append(self.get(url))
            if len(rows) == size:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class Numbers(InputPartition):
    """The addresses from one number up to another."""

    def __init__(self, low: int, high: int) -> None:
        super().__init__((low, high))
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        options = {k.lower(): v for k, v in options.items()}
        if "{}" not in options.get("url", ""):
            raise ValueError("option url needs {} where the number stands")
        self.url, self.low, self.high = options["url"], int(options.get("from", 1)), int(options["to"])
        self.each = max(int(options.get("pagesperpartition", 32)), 1)
        self.manner = Manner(options.get("agent", Manner.agent), *(t(options.get(k, getattr(Manner, k))) for k, t in (("timeout", float), ("attempts", int), ("step", float), ("pause", float))))

    def partitions(self) -> list[Numbers]:
        return [Numbers(i, min(i + self.each, self.high + 1)) for i in range(self.low, self.high + 1, self.each)] or [Numbers(0, 0)]

    def read(self, partition: Numbers) -> Iterator[pa.RecordBatch]:
        yield from self.manner.batches(self.url.replace("{}", str(i)) for i in range(partition.low, partition.high))


class NumberedPages(DataSource):
    """``numbered_pages``: the pages of an address with a number in it.

    Options: url with ``{}``; from (1) and to, both included; pagesPerPartition
    (32), the range of numbers that one task fetches; agent, timeout, attempts,
    step, pause as in Manner.
    """

    @classmethod
    def name(cls) -> str:
        return "numbered_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def numbered_pages(spark: SparkSession, url: str, to: int, **options) -> DataFrame:
    """The data source, registered and read."""
    spark.dataSource.register(NumberedPages)
    return spark.read.format("numbered_pages").options(url=url, to=to, **options).load()


def fetched(urls: DataFrame, manner: Manner = Manner(), url: str = "url") -> DataFrame:
    """PAGE for each distinct address of a table; null addresses have no page. Each task fetches its partition's addresses one after another."""
    rows = urls.select(F.col(url).cast("string").alias("url")).where("url is not null").distinct()
    return rows.mapInArrow(lambda it: manner.batches(u for b in it for u in b.column(0).to_pylist()), PAGE)


def land(urls: DataFrame, folder: str, manner: Manner = Manner(), url: str = "url") -> DataFrame:
    """Fetch what the folder lacks and append it there; returns the last row of each address, good ones before failures.

    A page that was fetched stays and is not asked for again, so a run that was
    broken off, or whose pages failed, is simply run again. A failure is kept as
    a row with its error.
    """
    spark = urls.sparkSession
    wanted = urls.select(F.col(url).cast("string").alias("url")).where("url is not null").distinct()
    if existing(spark, folder):
        good = spark.read.schema(PAGE).parquet(folder).where("error is null").select("url").distinct()
        wanted = wanted.join(good, "url", "left_anti")
    fetched(wanted, manner).write.mode("append").parquet(folder)
    every = spark.read.schema(PAGE).parquet(folder)
    best = every.groupBy("url").agg(F.max_by(F.struct("status", "html", "error", "attempts"), F.struct(F.col("error").isNull(), "attempts")).alias("p"))
    return best.select("url", "p.*")


def failures(pages: DataFrame) -> DataFrame:
    """(url, status, error, attempts) of pages that did not come."""
    return pages.where("error is not null").select("url", "status", "error", "attempts")
