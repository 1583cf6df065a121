"""Streaming ingest of event rows into a triple table, and windowed counts; an extension, as the batch path needs none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspan.terms import COLUMNS, TYPE, XSD, term_struct

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_triples(events: DataFrame, ns: str) -> DataFrame:
    """Triples of event rows without a shuffle, so that it works on streams; a repeated event repeats its triples."""
    s = F.concat(F.lit(ns + "event/"), F.col("event_id").cast("string"))
    k = F.get_json_object("props", "$.k")
    made = [term_struct(s, TYPE, F.lit(ns + "Event"), "iri"), term_struct(s, ns + "kind", F.col("event_type")), term_struct(s, ns + "by", F.concat(F.lit(ns + "user/"), F.col("user_id").cast("string")), "iri"), term_struct(s, ns + "k", k, dt=XSD + "integer")]
    return events.select(F.explode(F.array(*made)).alias("t")).select("t.*").where("s is not null and o is not null").select(*COLUMNS)


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(folder)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; the watermark bounds the state."""
    got = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def start(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a Parquet table, exactly once, and stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
