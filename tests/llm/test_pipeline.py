import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_their_decisions_hold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for name, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == cp.COLUMNS
            seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[1] < seen[0]
    kept = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert len(kept) == seen[-1]


def test_near_duplicates_keep_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "en", "a", 1), (3, text + " end", "en", "b", 2), (3, text + " end", "en", "b", 2), (9, "else", "de", None, 3),
            (8, "", "en", "c", 0), (7, None, None, None, None), (None, text, "en", "d", 1)]
    out = cp.near_duplicate_stage(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert sorted((str(r.doc_id), r.lang) for r in out.collect()) == [("3", "en"), ("7", None), ("8", "en"), ("9", "de"), ("None", "en")]


def test_decontamination_drops_what_holds_a_passage(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(1, "before " + item, "en", "a", 1), (2, "clean text", "en", "a", 1), (None, None, None, None, None)]
    out = cp.decontamination_stage(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "None"]


def test_an_empty_table_stays_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_ids_on_several_texts_are_decided_text_by_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(7, a, "en", "a", 1), (9, a + " end", "en", "a", 1), (7, b, "en", "a", 1), (3, b, "en", "a", 1), (7, c, "en", "a", 1),
            (8, "", "en", "a", 0), (8, "", "de", "a", 0), (8, "", "en", "a", 0)]
    out = cp.near_duplicate_stage(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert sorted((r.doc_id, r.text, r.lang) for r in out.collect()) == sorted([
        (3, b, "en"), (7, a, "en"), (7, c, "en"), (8, "", "de"), (8, "", "en")])


def test_decontamination_keeps_clean_rows_of_a_contaminated_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(None, item, "en", "a", 1), (None, "clean", "en", "a", 1), (None, None, None, None, None),
            (4, "x " + item, "en", "a", 1), (4, "other text", "en", "a", 1)]
    out = cp.decontamination_stage(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == [("4", "other text"), ("None", "None"), ("None", "clean")]
