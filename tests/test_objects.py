"""The object sink and listing: together or not at all, repeated without harm, dealt to tasks."""

import pytest
from pyspark.sql import functions as F

from scrivane.sources import files as IO
from scrivane.sources import objects as O

OBJECTS = "key string, content binary"


def shown(tmp_path):
    return sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and ".staging" not in str(p))


def test_objects_are_written_and_listed(spark, tmp_path):
    path = tmp_path / "out"
    rows = spark.range(300).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/e/"), "id").alias("key"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("content"))
    got = {r["key"]: (r["path"], r["error"]) for r in O.write_objects(rows, str(path)).collect()}
    assert len(got) == 300 and got["d1/e/8"] == (f"{path}/d1/e/8", None) and (path / "d1/e/8").read_text() == "é" * 8
    for folders in (1, 4, 64):
        listed = O.list_store(spark, str(path), folders)
        assert {(r["key"], r["size"]) for r in listed.collect()} == {(f"{path}/d{i % 7}/e/{i}", 2 * i) for i in range(300)}
        assert listed.rdd.getNumPartitions() >= min(folders, 7)
    assert O.list_store(spark, str(tmp_path / "none")).isEmpty()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    (tmp_path / "kept").write_bytes(b"old")
    for bad in ("../x", "", "a//b", None, "a/./b"):
        rows = spark.createDataFrame([(f"k{i}", b"x") for i in range(20)] + [("kept", b"new"), (bad, b"y")], OBJECTS)
        with pytest.raises(Exception, match="not a key"):
            O.write_objects(rows, str(tmp_path))
        assert shown(tmp_path) == ["kept"] and (tmp_path / "kept").read_bytes() == b"old"
    assert [p for p in (tmp_path / ".staging").iterdir() if p.suffix == ".json"] == []


def test_publishing_again_and_lost_attempts(spark, tmp_path):
    spark.dataSource.register(O.ObjectSink)
    rows = spark.createDataFrame([("a", b"1"), ("b/c", None)], OBJECTS).coalesce(1)
    rows.write.format(O.SINK).option("job", "j1").mode("append").save(str(tmp_path))
    assert shown(tmp_path) == []
    # What a lost attempt left in the job's folder does not count.
    (tmp_path / ".staging" / "j1" / "lost").mkdir()
    (tmp_path / ".staging" / "j1" / "lost" / "z").write_bytes(b"?")
    for _ in range(2):
        O.publish(spark, str(tmp_path), "j1")
        assert shown(tmp_path) == ["a", "b/c"] and (tmp_path / "a").read_bytes() == b"1" and (tmp_path / "b/c").read_bytes() == b""
    O.write_objects(spark.createDataFrame([("a", b"2")], OBJECTS), str(tmp_path))
    assert (tmp_path / "a").read_bytes() == b"2"
    assert O.write_objects(rows.where("false"), str(tmp_path)).isEmpty()
    with pytest.raises(FileNotFoundError):
        O.publish(spark, str(tmp_path), "never committed")


def test_markdown_uses_the_sink(spark, tmp_path):
    pages = F.array(F.struct(F.lit(1).alias("page_number"), F.lit("text").alias("page_content")))
    docs = spark.createDataFrame([("a.pdf",), ("b.x.pdf",), ("b.x.png",)], "file_name string").withColumn("pages", pages)
    got = {r["file_name"]: (r["path"], r["error"]) for r in IO.write_markdown(docs, str(tmp_path / "md")).collect()}
    assert got["a.pdf"] == (str(tmp_path / "md" / "a.md"), None) and got["b.x.pdf"] == got["b.x.png"] == (None, "several documents of this name")
    assert shown(tmp_path / "md") == ["a.md"]
