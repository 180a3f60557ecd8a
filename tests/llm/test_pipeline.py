import corpus_pipeline as pipeline
from lakeleaf.llm import language, toxicity

from .test_similar_texts import brute


def test_every_stage_takes_effect_and_keeps_the_columns(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == columns
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, after)
        before = after
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    before, after = seen["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(after) == {r.doc_id for r in toxicity.score(before, model).collect() if not r.predicted}
    before, after = seen["language"]
    found = language.identify(before, language.fit(before)).collect()
    assert ids(after) == {r.doc_id for r in found if r.lang_pred != "und" and r.score >= pipeline.LEAST_LANGUAGE_SCORE}
    before, after = seen["line_dedup"]
    assert ids(after) == ids(before)
    before, after = seen["simhash"]
    assert ids(after) == set(brute(sorted((r.doc_id, r.text) for r in before.collect()))[0])
    pieces = pipeline.STAGES[-1][1](spark, after, sf_dir).collect()
    assert {r.doc_id for r in pieces} == ids(after)


def test_stages_with_nulls_repeats_extra_columns_and_no_rows(spark, sf_dir):
    rows = [(1, None, None, None, None, 7), (None, "a line of text", "en", "src1", 14, 7), (2, "", "en", "src1", 0, 7), (2, "", "en", "src1", 0, 7), (3, "1 2 3", "xx", "src2", 5, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_dropped int")
    for df in (docs, docs.where("false")):
        for _, stage in pipeline.STAGES[:-1]:
            after = stage(spark, df, sf_dir)
            assert after.columns == df.columns and after.count() <= df.count()
        assert {r.doc_id for r in pipeline.pack(spark, df, sf_dir).collect()} == {r.doc_id for r in df.collect()}
    kept = pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 3, None]


def test_near_copies_are_told_apart_by_row_not_by_doc_id(spark, sf_dir):
    texts = [" ".join(f"{name}{i}" for i in range(60)) for name in "abcd"]
    rows = [(5, texts[0]), (5, texts[1]), (3, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[0]), (7, texts[3]), (None, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(5, texts[0]), (3, texts[1]), (None, texts[2]), (7, texts[3])], key=str)
