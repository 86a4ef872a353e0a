"""The pipeline's stages keep no more Python workers than tasks."""


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_language_id_scores_a_text_once(spark, data):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = cp.language_id(spark, docs, data)
    # a task holds a worker for each of these, and workers that it leaves stay for a minute
    assert plan_of(kept).count("ArrowEvalPython") == 1
    assert 0 < kept.count() <= docs.count()


def test_packing_plan_needs_no_python_rdd(spark):
    from quarry.llm import packing

    pieces = spark.createDataFrame([(k, 0, 0, n, 0, 0, r) for k, (n, r) in enumerate([(6, 0), (6, 1), (4, 0)])], packing.PIECES_DDL)
    pieces.write.mode("overwrite").parquet(path := packing.shared_dir(spark, "few"))
    found = packing.pack(spark.read.schema(packing.PIECES_DDL).parquet(path), 10)
    assert "ExistingRDD" not in plan_of(found)
    assert sorted((r.sequence_id, r.offset, r.length) for r in found.collect()) == [(0, 0, 6), (0, 6, 4), (1, 0, 6)]
    none = packing.pack(spark.read.schema(packing.PIECES_DDL).parquet(path).filter("length < 0"), 10)
    assert "ExistingRDD" not in plan_of(none) and none.collect() == []
