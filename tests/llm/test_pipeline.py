import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "stage")
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    assert corpus_pipeline.STAGES[4][1](spark, mixed, SF).count() >= mixed.count()


def test_rows_fall_by_their_own_verdict(spark, tmp_path):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    ids = [None, None, None, 7, 7, 7, 8]
    texts = [words(0), words(1), words(1), words(2), words(3), words(2).replace(" ", "  "), words(4)]
    docs = spark.createDataFrame(list(zip(ids, texts, ["s"] * 7, strict=True)), "doc_id long, text string, source string")
    want = sorted([(-1, words(0)), (-1, words(1)), (7, words(2).replace(" ", "  ")), (7, words(3)), (8, words(4))])
    shown = lambda df: sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in df.collect())
    one = corpus_pipeline.written(corpus_pipeline.drop_copies(spark, docs, SF), "stage")
    assert shown(one) == want and shown(corpus_pipeline.drop_near_copies(spark, one, SF)) == want
    near = docs.select("doc_id", "source", "text").unionByName(spark.createDataFrame([(7, "s", words(4) + " more"), (None, "s", words(4) + " else")], "doc_id long, source string, text string"))
    assert shown(corpus_pipeline.drop_near_copies(spark, corpus_pipeline.written(corpus_pipeline.drop_copies(spark, near, SF), "stage"), SF)) == want
    assert max(r["count"] for r in corpus_pipeline.mix(spark, one, SF).groupBy("text").count().collect()) <= 3

    clean, foul = [f"{words(i)} calm" for i in range(60)], [f"{words(i)} vileword" for i in range(100, 130)]
    labelled = [(i, t) for i, t in enumerate(clean + foul)]
    spark.createDataFrame([(i, int(i >= 60)) for i, _ in labelled], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    extra = [(None, words(200) + " calm"), (None, words(201) + " vileword"), (500, words(202) + " calm"), (500, words(203) + " vileword")]
    left = shown(corpus_pipeline.drop_toxic(spark, spark.createDataFrame(labelled + extra, "doc_id long, text string"), str(tmp_path)))
    assert [x for x in left if x[0] in (-1, 500)] == [(-1, words(200) + " calm"), (500, words(202) + " calm")]
