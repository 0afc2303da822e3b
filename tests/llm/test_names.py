"""Columns of any name pass every operator and stage: with dots and backticks, in other case, and with names that operators use themselves."""

import datetime

import pytest
from pyspark.sql import functions as F

from textsketch.llm import decontaminate, hmm, htmltext, itq, langid, licences, nearcopies, packing, quality, simhash, urlfilter

ODD = ["__id", "__same", "__leaks", "__url", "__at", "__key", "a.b", "tick`ed", "Lang_Pred", "QUALITY_SCORE", "id", "same", "_0", "_1", "on_0", "new_lang_pred", "block", "N", "found", "allowed", "pattern", "Main_Text", "key", "by", "__h", "__by"]


def odd(df):
    """df with columns of these names, whose values tell rows apart."""
    return df.toDF(*df.columns).select("*", *(F.concat(F.lit(f"{k}:"), F.monotonically_increasing_id().cast("string")).alias(c) for k, c in enumerate(ODD)))


def column(c):
    return F.col("`" + c.replace("`", "``") + "`")


@pytest.fixture(scope="module")
def docs(spark):
    text = "the cat and the dog went over the hill to see what there was to see on the other side of it "
    rows = [(1, text), (1, text), (2, text + "again"), (3, None), (4, ""), (None, text * 3), (5, "some benchmark words that must not be in any text at all")]
    return odd(spark.createDataFrame([(*r, "en") for r in rows], "doc_id bigint, text string, lang string")).persist()


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_all_columns_stay(spark, docs):
    model = quality.fit([("good words " * 30, 1)] * 8 + [("!!! $$ " * 30, 0)] * 8)
    languages = langid.fit([("the cat and the dog " * 20, "en"), ("le chat et la souris " * 20, "fr")])
    items = odd(spark.createDataFrame([(1, "benchmark words that must not be in any")], "item_id bigint, text string"))
    for got, gone in ((quality.score(docs, model), "quality_score"), (langid.identify(docs, languages), "lang_pred")):
        left = [c for c in docs.columns if c.lower() != gone]
        assert [c for c in got.columns if c in left] == left and got.count() == 7
        assert rows(got.select(*map(column, left))) == rows(docs.select(*map(column, left)))
    assert langid.keep(docs, languages, 0.1).columns == docs.columns and set(rows(langid.keep(docs, languages, 0.1))) < set(rows(docs))
    assert quality.keep(docs, model, 0.0).columns == docs.columns and rows(quality.keep(docs, model, 0.0)) == rows(docs)
    cleaned = decontaminate.clean(docs, items)
    assert cleaned.columns == docs.columns and rows(cleaned) == rows(docs.where("doc_id is null or doc_id <> 5"))
    for keep, n in ((simhash.keep_one, 5), (nearcopies.keep_one, 5)):
        one = keep(docs)
        assert one.columns == docs.columns and set(rows(one)) < set(rows(docs)) and one.count() <= n
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()} == {(5, 1)}


def test_other_columns_are_ignored(spark, docs):
    plain = docs.select("doc_id", "text", "lang")
    assert rows(simhash.near_duplicates(docs)) == rows(simhash.near_duplicates(plain))
    assert packing.pack(docs).count() == packing.pack(plain).count() == 7
    assert hmm.score(docs, F.lit(False)).count() == 7
    assert licences.scan(docs).count() == 0
    assert langid.train(docs).languages == langid.train(plain).languages
    labels = odd(spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int"))
    assert quality.train(docs, labels).constant == quality.train(plain, labels.select("doc_id", "quality")).constant
    vectors = odd(spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, None, 0)], "vec_id bigint, embedding array<double>, label int"))
    assert sorted((r.vec_id, r.component_id) for r in itq.near_duplicates(vectors).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_pages_and_urls(spark):
    d = datetime.date(2024, 1, 2)
    pages = odd(spark.createDataFrame([(1, "http://a.com/x", "<p>text</p>", d), (2, None, None, None)], "page_id bigint, url string, html string, fetched_at date"))
    got = htmltext.extract(pages)
    assert {r.page_id: r.main_text for r in got.collect()} == {1: "text", 2: ""} and "Main_Text" not in got.columns
    lists = odd(spark.createDataFrame([("spam", "a.com", "add", d)], "list string, pattern string, action string, at date").select("list", "action", "at", F.col("pattern").alias("own"))).withColumnRenamed("pattern", "other").withColumnRenamed("own", "pattern")
    judged = urlfilter.judge(pages, lists)
    assert judged.columns == [*pages.columns, "blocked", "reasons"] and {r.page_id: r.blocked for r in judged.collect()} == {1: True, 2: False}
    again = urlfilter.judge(judged.withColumnRenamed("blocked", "Blocked"), lists)
    assert rows(again) == rows(judged)


def test_every_stage_with_nulls_empty_tables_and_names(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "benchmark words that must not be in any"), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept[name] = {r.doc_id for r in out.collect()}
        assert set(rows(out)) <= set(rows(docs)), name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
    assert kept["quality"] == {1, 2, 3, 4, 5, None}  # one label: all are as good
    assert 3 not in kept["language"] and 4 not in kept["language"]
    assert {1, 5} <= kept["near_duplicates"] and kept["decontamination"] == {1, 2, 3, 4, None}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 7
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), str(tmp_path)).count() == 0
