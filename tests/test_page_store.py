"""The page image store: looked up by an index, repaired, cleared, and read by path."""

import pytest
from pyspark.sql import functions as F

from scrivane.functions import pixels as P
from scrivane.operators import model as X
from scrivane.plans.pipelines import process_pages
from scrivane.sources import content as K
from scrivane.sources.page_store import PageStore, probe, stored_image_loader

IMAGE = P.encode_png(P.decode_png(P.encode_png(__import__("numpy").zeros((3, 5, 3), "uint8"))))
PAGES = "file_hash string, page_hash string, page_number int"


def pages_of(spark, n):
    return spark.range(n).select(F.concat(F.hex(F.pmod(F.xxhash64((F.col("id") / 5).cast("int")), F.lit(251))), F.lit("_"), (F.col("id") / 5).cast("int")).alias("file_hash"), F.concat(F.lit("p"), "id").alias("page_hash"), (F.col("id") % 5).cast("int").alias("page_number"))


def images(pages):
    return pages.select("file_hash", "page_hash", F.lit(IMAGE).alias("image"))


def test_a_lookup_looks_at_its_own_files_only(spark, tmp_path):
    looks, reads = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(path):
        looks.add(1)
        return probe(path)

    def reader(path):
        reads.add(1)
        return K.fetch(path)

    store = PageStore(spark, str(tmp_path / "img"), counted)
    pages = pages_of(spark, 400)
    store.add(images(pages))
    ten = pages.where("page_hash in ('p0', 'p41', 'p82', 'p123', 'p164', 'p205', 'p246', 'p287', 'p328', 'p369')")
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    found = store.lookup(ten)
    got = K.with_content(found, reader=reader).collect()
    assert len(got) == 10 and all(bytes(r["content"]) == IMAGE for r in got)
    assert looks.value == 10 and reads.value == 10
    status = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [status.apply(i).physicalPlanDescription() for i in range(before, status.length())]
    assert not any("binaryFile" in p for p in plans)
    assert len(store.index(ten).inputFiles()) <= 10 + 1 < len(store.index().inputFiles())
    assert store.lookup(spark.createDataFrame([("none", "p1")], "file_hash string, page_hash string")).isEmpty() and looks.value == 10


@pytest.mark.parametrize("harm", ["cut", "empty", "gone", "longer", "other"])
def test_harmed_files_are_made_again(spark, tmp_path, harm):
    store, made = PageStore(spark, str(tmp_path / "img")), []
    pages = spark.createDataFrame([("f1", "p1", 1), ("f1", "p2", 2), ("f2", "p1", 1), (None, "p", 1)], PAGES)

    def raster(missing):
        made.append(sorted(tuple(r) for r in missing.select("file_hash", "page_hash").collect()))
        return images(missing)

    store.with_paths(pages, raster).collect()
    file = tmp_path / "img" / "f1" / "f1" / "p2.png"
    whole = file.read_bytes()
    if harm == "gone":
        file.unlink()
    else:
        file.write_bytes({"cut": whole[:-5], "empty": b"", "longer": whole + b"x", "other": b"y" * len(whole)}[harm])
    got = {(r["file_hash"], r["page_hash"]): r["image_path"] for r in store.with_paths(pages, raster).collect()}
    assert made == [[("f1", "p1"), ("f1", "p2"), ("f2", "p1")], [("f1", "p2")]] and file.read_bytes() == whole
    assert got[None, "p"] is None and got["f1", "p2"] == str(file) and len(got) == 4


def test_completeness_and_clearing(spark, tmp_path):
    store = PageStore(spark, str(tmp_path / "img"))
    expected = spark.createDataFrame([("f1", 2), ("f2", 2), ("f3", 0), ("f4", 1)], "file_hash string, expected int")
    assert {r["file_hash"]: r["complete"] for r in store.complete(expected).collect()} == {"f1": False, "f2": False, "f3": True, "f4": False}
    store.add(images(spark.createDataFrame([("f1", "p1", 1), ("f1", "p2", 2), ("f2", "p1", 1)], PAGES)))
    assert {r["file_hash"]: r["complete"] for r in store.complete(expected).collect()} == {"f1": True, "f2": False, "f3": True, "f4": False}
    assert store.clear("f1") and not store.clear("f1") and not (tmp_path / "img" / "f1" / "f1").exists()
    assert [(r["file_hash"], r["page_hash"], r["length"]) for r in store.index().collect()] == [("f2", "p1", len(IMAGE))]
    for bad in ("../img", "", "a/b"):
        with pytest.raises(ValueError):
            store.clear(bad)
    with pytest.raises(Exception, match="not a hash"):
        store.add(images(spark.createDataFrame([("../x", "p", 1)], PAGES)))


def test_a_store_without_an_index_is_indexed(spark, tmp_path):
    (tmp_path / "img" / "ab" / "abc").mkdir(parents=True)
    (tmp_path / "img" / "ab" / "abc" / "p1.png").write_bytes(IMAGE)
    (tmp_path / "img" / "ab" / "abc" / "p2.png").write_bytes(b"no image")
    store = PageStore(spark, str(tmp_path / "img"))
    store.reindex()
    got = store.lookup(spark.createDataFrame([("abc", "p1", 1), ("abc", "p2", 2)], PAGES)).collect()
    assert [tuple(r) for r in got] == [("abc", "p1", str(tmp_path / "img" / "ab" / "abc" / "p1.png"))]


def test_stored_images_reach_the_model_by_path(spark, tmp_path):
    class Seeing(X.StubModel):
        def call(self, request):
            return X.Answer(str(P.decode_png(request.images[0]).shape) if request.images else "none")

    pages = spark.createDataFrame([("f1", "p1", 1, "a"), ("f1", "p2", 2, "b")], PAGES + ", text string")
    shown = PageStore(spark, str(tmp_path / "img")).with_paths(pages, lambda missing: images(missing).where("page_hash = 'p1'"))
    got = process_pages(shown, Seeing, "p", images=["image_path"], load=stored_image_loader()).head()
    assert got["content"] == "(3, 5, 3)\nnone" and got["failed_pages"] == 0
