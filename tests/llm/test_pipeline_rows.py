def test_quality_stage_keeps_rows_by_their_own_text(spark, tmp_path):
    import corpus_pipeline as p

    good = "a plain text of more than ten words that says each thing only once here"
    rows = [(None, good, "en", "s", 1), (None, "bad", "en", "s", 1), (7, good + " and again", "en", "s", 1), (7, "too short", "en", "s", 1), (8, "short", "en", "s", 1), (9, good + " twice", "en", "s", 1), (9, good + " twice", "en", "s", 1), (10, None, "en", "s", 1)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = p.keep_good(spark, docs, str(tmp_path))
    assert left.columns == list(p.COLUMNS)
    want = [rows[i] for i in (0, 2, 5, 6)]
    assert sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)
