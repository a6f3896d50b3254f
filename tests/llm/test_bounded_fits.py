"""What one fit task gets stays bounded where one id repeats, in rows and in bytes."""

import time

import pytest
from pyspark.sql import functions as F

from scrivane.llm import language, quality, toxicity
from scrivane.llm._kit import bounded_rows


def hot(spark, n):
    """One labelled id in n rows of different texts, 40 ids of a row each, and the same text many times."""
    many = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("some plain words of document "), "id").alias("text"))
    few = spark.range(2, 42).select(F.col("id").alias("doc_id"), F.concat(F.lit("other plain words of document "), "id").alias("text"))
    same = spark.range(n).select(F.lit(50).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    return many.union(few).union(same).withColumn("lang", F.lit("en"))


def test_rows_are_bounded_and_weighted(spark):
    rows = hot(spark, 100_000).select(F.lit(0).alias("y"), "doc_id", "text").union(spark.createDataFrame([(1, 7, "x"), (1, 8, None), (1, 9, "y" * 500), (None, None, "z")], "y int, doc_id long, text string"))
    got = bounded_rows(rows, "y", "doc_id", "text", {0: 400, 1: 2}, longest=499)
    kept = {r["y"]: r for r in got.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("_f").alias("f")).collect()}
    assert 400 <= kept[0]["n"] <= 700 and 80_000 < kept[0]["f"] < 120_000
    assert kept[1]["n"] == 2 == kept[1]["f"] and got.where("y = 1 and doc_id = 9").isEmpty()
    assert got.columns == ["y", "doc_id", "text", "_f"] and bounded_rows(rows.where("false"), "y", "doc_id", "text", 5).isEmpty()


def test_bytes_are_bounded(spark):
    rows = spark.range(3000).select(F.lit(0).alias("y"), F.lit(1).alias("doc_id"), F.concat(F.repeat(F.lit("w "), 500), F.col("id")).alias("text"))
    got = bounded_rows(rows, "y", "doc_id", "text", 10_000, most_bytes=300_000).agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).head()
    assert 150_000 < got["b"] < 450_000


def test_few_rows_stay_as_they_are(spark):
    rows = spark.range(500).select((F.col("id") % 2).cast("int").alias("y"), F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    got = bounded_rows(rows, "y", "doc_id", "text", 200)
    assert got.count() == 500 and got.agg(F.max("_f")).head()[0] == 1.0


@pytest.mark.parametrize("fit", ["toxicity", "quality", "language"])
def test_fits_of_one_id_in_many_rows(spark, fit, monkeypatch):
    docs = hot(spark, 100_000)
    labels = docs.select("doc_id").distinct().withColumns({"toxic": F.lit(0), "quality": F.lit(1)}).union(spark.createDataFrame([(60, 1, 0)], "doc_id long, toxic int, quality int"))
    seen = []
    owner = {"toxicity": toxicity, "quality": quality, "language": language}[fit]
    real = owner.bounded_rows
    monkeypatch.setattr(owner, "bounded_rows", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    began = time.time()
    if fit == "toxicity":
        toxicity.train_toxicity(docs, labels)
    elif fit == "quality":
        quality.train_quality(docs, labels)
    else:
        assert language.train_language(docs)[0] == ["en"]
    assert time.time() - began < 60
    assert seen[0].count() < 9000
