from loomspan.plans.catalog import QUERIES


def test_every_order_is_replayed(spark, tmp_path):
    keys = [1, 2, 499, 500, 501, 60000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.id: r.answer for r in QUERIES["replayed_model"](spark, str(tmp_path)).collect()}
    assert got == {k: "{}" if k % 2 else f'{{"fine_eur": {k}}}' for k in keys}
