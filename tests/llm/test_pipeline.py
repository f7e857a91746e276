import corpus_pipeline

from .test_packing import texts_of

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = docs.cache()
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    packed = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    assert texts_of(spark, packed) == {r.doc_id: r.text for r in docs.collect() if r.text}


def test_run_is_the_stages_in_turn(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["bin_id", "capacity", "used", "n_pieces", "doc_ids", "pieces", "ids"] and got.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "repeated_passages", "private_data", "packing"]


def test_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {d for r in got for d in r.doc_ids} >= {1, 6, 7, 8}
    odd.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
