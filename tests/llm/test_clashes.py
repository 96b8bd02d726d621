"""Input columns may have any name, those that the operators use inside as well."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import htmltext, sharding, simhash, stages, suffix_dedup

NAMES = ["__id", "__ID_", "__text", "__fp", "__keep", "__keep_fp", "__root", "__t", "__row", "__key", "__size", "__shard", "__piece",
         "__rank", "__start", "__n", "__url", "__html", "__toxic_score"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three four five six", "http://a/"), (2, "one two three four five six", "http://a/"),
            (3, "another text of seven words in all", None), (None, None, "http://b/")]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string")
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])


def rows_of(df, *more):
    return sorted((tuple(r[c] for c in ("doc_id", *more)) for r in df.collect()), key=repr)


def clashing(df):
    return [tuple(r[n] for n in NAMES) for r in df.collect()] == [tuple(range(len(NAMES)))] * df.count()


def test_simhash(docs):
    out = simhash.keep_one_per_group(docs)
    assert out.columns == docs.columns and rows_of(out) == [(1,), (3,), (None,)] and clashing(out)


def test_suffix_dedup(docs):
    long = docs.withColumn("text", F.repeat("text", 3))
    out = suffix_dedup.dedup_texts(long)
    assert out.columns == docs.columns and clashing(out)
    assert rows_of(out, "text")[:3] == [(1, "one two three four five six" * 3), (2, ""), (3, "another text of seven words in all" * 3)]


def test_html(docs):
    out = htmltext.extract(docs.withColumnRenamed("text", "html"))
    assert out.columns == [c for c in docs.columns if c != "text"] + ["text"] and clashing(out)
    assert rows_of(out, "text")[0] == (1, "one two three four five six")


def test_sharding(docs):
    out = sharding.shard_documents(docs, 2)
    assert out.columns == docs.columns + ["shard", "slot"] and rows_of(out) == [(1,), (2,), (3,), (None,)] and clashing(out)


def test_toxicity_stage_keeps_a_column_of_its_score(docs, monkeypatch):
    from tessera.llm import toxicity

    monkeypatch.setattr(toxicity, "train", lambda *a: None)
    monkeypatch.setattr(toxicity, "score_rows", lambda df, model, out: df.withColumn(out, F.lit(0.0)))
    monkeypatch.setattr(stages, "table", lambda *a: None)
    out = stages.drop_toxic(None, docs, "")
    assert out.columns == docs.columns and clashing(out)
