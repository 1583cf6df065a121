import time

from pyspark.sql import functions as F

from loomspan.operators.profile import profiled, stage_totals


def test_what_stages_cost(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 4).select("id", (F.col("id") % 10).alias("k")).write.parquet(path)
    t = spark.read.parquet(path)

    def slow():
        spark.range(4).select(F.udf(lambda x: time.sleep(20) or x, "long")("id")).collect()

    got = {
        r.stage: r
        for r in profiled(
            spark,
            [("read", lambda: t.select("id").write.format("noop").mode("overwrite").save()), ("group", lambda: t.repartition(3, "k").groupBy("k").count().collect()), ("bad", lambda: 1 / 0), ("slow", slow), ("none", lambda: None)],
            limit=6,
        ).collect()
    }
    assert (got["read"].status, got["read"].rows_read, got["read"].shuffle_rows) == ("done", 1000, 0) and got["read"].jobs == 1 and got["read"].seconds > 0
    assert (got["group"].rows_read, got["group"].shuffle_rows) == (1000, 1000) and got["group"].shuffle_mb > 0 and got["group"].execution_peak_mb > 0
    assert got["bad"].status == "failed" and got["bad"].error.startswith("ZeroDivisionError") and got["bad"].jobs == 0
    assert got["slow"].status == "timeout" and got["slow"].seconds < 15
    assert (got["none"].status, got["none"].tasks, got["none"].spill_mb) == ("done", 0, 0.0)
    total = stage_totals(spark.createDataFrame([tuple(got[k]) for k in ("read", "group", "bad")], got["read"].__fields__ and profiled(spark, []).schema)).first()
    assert (total.stages, total.unfinished, total.rows_read, total.shuffle_rows) == (3, 1, 2000, 1000)
    assert stage_totals(profiled(spark, [])).first().stages == 0
