"""Numbers, running sums and parts of documents against plain windows and joins."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scrivane.functions.requests import labelled_images
from scrivane.operators import ordered as O
from scrivane.operators import pages as G


def spread_rows():
    r = random.Random(3)
    rows = [("hot", i, "x" * (i % 7)) for i in range(20_000)]
    rows += [("sparse", r.randrange(-(10**12), 10**12), "y") for _ in range(300)]
    rows += [(None, i % 5, f"n{i}") for i in range(12)] + [("nulls", None, "b"), ("nulls", None, "a"), ("nulls", 0, None), ("", 1, "empty key")]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(spread_rows(), "doc string, page long, text string")


def test_running_equals_one_window_a_document(pages):
    w = Window.partitionBy("doc").orderBy(F.col("page").asc_nulls_first(), F.col("text").asc_nulls_first())
    size = F.coalesce(F.length("text"), F.lit(0))
    want = pages.select("doc", "page", "text", (F.row_number().over(w) - 1).alias("number"), F.count(F.lit(1)).over(Window.partitionBy("doc")).alias("of"), (F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("at"))
    n = O.numbered(pages, "doc", "page", ties=["text"], total="of")
    got = O.running(n, "doc", "page", weight=F.length("text"), ties=["text"], before="at")
    rows = lambda df: sorted(map(tuple, df.select("doc", "page", "text", "number", "of", "at").collect()), key=repr)
    assert rows(got) == rows(want)


def test_a_hot_document_is_spread_over_tasks(spark, pages):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = O.numbered(pages.where("doc = 'hot'"), "doc", "page").select(F.spark_partition_id().alias("task"), "number")
        tasks = got.groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(tasks) > 1 and max(t["count"] for t in tasks) < 20_000


@pytest.mark.parametrize("most", [1, 50, 1000, 1 << 30])
def test_parts_make_the_document_and_are_bounded(spark, pages, most):
    made = O.parts(pages, "doc", "page", "text", most=most).collect()
    want = {}
    for d, p, t in sorted(spread_rows(), key=lambda r: (r[0] or "", r[0] is None, r[1] is not None, r[1] or 0, r[2] or "")):
        want.setdefault(d, []).append(t or "")
    got = {}
    for r in sorted(made, key=lambda r: r["part"]):
        got.setdefault(r["doc"], []).append(r["content"])
        assert len(r["content"]) < most + 10
    assert {d: "\n".join(c) for d, c in got.items()} == {d: "\n".join(c) for d, c in want.items()}
    assert sum(r["n_pages"] for r in made) == pages.count()


def test_parts_of_a_document_of_a_million_pages(spark):
    pages = spark.range(1_000_000).select(F.lit(1).alias("doc"), "id", F.concat(F.lit("page "), "id").alias("text"))
    made = O.parts(pages, "doc", "id", "text", most=1 << 16).select("part", "first_page", "last_page", "n_pages", F.length("content").alias("n"), F.crc32(F.col("content").cast("binary")).alias("c"))
    rows = sorted(made.collect(), key=lambda r: r["part"])
    assert max(r["n"] for r in rows) < (1 << 16) + 20 and sum(r["n_pages"] for r in rows) == 1_000_000
    at = 0
    for r in rows:
        assert r["first_page"] == at
        at = r["last_page"] + 1
    import zlib

    for r in rows[::37]:
        assert zlib.crc32("\n".join(f"page {i}" for i in range(r["first_page"], r["last_page"] + 1)).encode()) == r["c"]


def test_markdown_parts_equal_the_whole(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 10, None), (1, 1, "a"), (2, 1, "")], "doc int, page_number int, page_content string")
    whole = {r["doc"]: r["m"] for r in G.assemble(pages, "doc").select("doc", G.markdown(F.col("pages")).alias("m")).collect()}
    block = O.page_block(F.col("page_number"), F.col("page_content"))
    made = sorted(O.parts(pages, "doc", separator="", block=block, most=30).collect(), key=lambda r: (r["doc"], r["part"]))
    assert {d: "".join(r["content"] for r in made if r["doc"] == d) for d in (1, 2)} == whole


def test_labels_and_empty_tables(spark, pages):
    none = pages.limit(0)
    assert O.parts(none, "doc", "page", "text").isEmpty() and G.batches(none, "doc", "page", 3).isEmpty()
    got = labelled_images(spark.createDataFrame([("a", 5), ("a", 2), ("b", 1)], "r string, p int"), "r", "p").collect()
    assert {(r["r"], r["p"]): r["label"] for r in got} == {("a", 2): "Image 1:", ("a", 5): "Image 2:", ("b", 1): None}
