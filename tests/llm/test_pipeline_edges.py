import corpus_pipeline as p

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, name long"


def tables(spark, folder, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert p.run(spark, str(tmp_path)).count() == 0


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    a = " ".join(f"alpha{i}" for i in range(40))
    b = " ".join(f"beta{i}" for i in range(40)) + " mail me@where.example.org"
    rows = [(1, a), (1, a), (2, a), (None, a), (1, b), (None, None), (3, ""), (4, None), (None, b)]
    tables(spark, tmp_path, [(k, t, None, None, None, "r", 1) for k, t in rows])
    out = p.run(spark, str(tmp_path)).collect()
    # the copy under 2 goes; rows without a key stay; two texts under one key are two documents
    assert sorted((r.doc_id or 0, r.n_chars) for r in out) == sorted([(1, len(a)), (1, len(a)), (0, len(a)), (1, len(b)), (0, len(b))])
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    clean = p.replace_private(spark, docs, str(tmp_path))
    assert clean.columns == list(p.COLUMNS) and clean.count() == len(rows) and clean.where("text like '%where.example%'").count() == 0
