import corpus_pipeline as C


def test_without_labels_all_documents_stay(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string")
    for name, rows in (("none", []), ("unjoined", [(i, i % 2, i % 2) for i in range(100, 140)])):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        for stage in (C.quality_stage, C.toxicity_stage):
            out = stage(spark, docs, str(tmp_path / name))
            assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == list(range(20))
