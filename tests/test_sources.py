from pyspark.sql import functions as F

from scrivane.operators import cache as C
from scrivane.operators import model as X
from scrivane.plans.pipelines import process_pages
from scrivane.sources import files as IO
from scrivane.sources.content import with_content
from scrivane.streaming.ingest import ingest, new_files


def folder(tmp_path):
    d = tmp_path / "in"
    (d / "deep").mkdir(parents=True)
    (d / "a.PDF").write_bytes(b"one\ftwo")
    (d / "b.png").write_bytes(b"\x89PNG")
    (d / "c.txt").write_bytes(b"skip")
    (d / "deep" / "d.pdf").write_bytes(b"not scanned")
    (d / "broken.pdf").write_bytes(b"\xff\xfe")
    return str(d)


def test_scan_is_flat_and_routes(spark, tmp_path):
    got = {r["file_name"]: (r["media_type"], r["status"]) for r in IO.scan_folder(spark, folder(tmp_path)).collect()}
    assert got == {"a.PDF": ("pdf", "ok"), "b.png": ("image", "ok"), "c.txt": (None, "skipped"), "broken.pdf": ("pdf", "ok")}


def test_decode_selects_pages_and_keeps_errors(spark, tmp_path):
    files = IO.with_hash(IO.scan_folder(spark, folder(tmp_path))).where("media_type = 'pdf'").withColumn("wanted", F.array(F.lit(1)))
    got = {(r["path"].rsplit("/", 1)[1], r["page_number"], r["text"], r["error"] is None) for r in IO.decode_pages(files, IO.TextDecoder, "wanted").collect()}
    assert got == {("a.PDF", 2, "two", True), ("broken.pdf", None, None, False)}


def test_probe_never_raises(spark, tmp_path):
    got = {r["path"].rsplit("/", 1)[1]: (r["status"], dict(r["info"]).get("number_of_pages")) for r in IO.probe(IO.scan_folder(spark, folder(tmp_path)).where("media_type = 'pdf'"), IO.TextDecoder).collect()}
    assert got == {"a.PDF": ("success", "2"), "broken.pdf": ("error", None)}


def test_stream_processes_each_file_once(spark, tmp_path):
    path, cache, calls = folder(tmp_path), C.CacheTable(spark, str(tmp_path / "cache")), spark.sparkContext.accumulator(0)

    class Counting(X.StubModel):
        def call(self, request):
            calls.add(1)
            return super().call(request)

    def process(files):
        assert "content" not in files.columns
        pages = IO.decode_pages(with_content(files), IO.TextDecoder).where("error is null").drop("image")
        made = process_pages(pages, Counting, "p")
        return files.select("file_hash", "cache_key").join(made, "file_hash").select("cache_key", F.to_json(F.struct("content")).alias("value"))

    for _ in range(2):
        ingest(new_files(spark, path, "*.PDF"), cache, process, "p", str(tmp_path / "check")).awaitTermination()
    assert cache.read().count() == 1 and calls.value == 2


def test_objects_json_and_counts(spark, tmp_path):
    base = tmp_path / "store"
    (base / "images").mkdir(parents=True)
    (base / "images" / "p.png").write_bytes(b"x")
    (base / "a.pdf").write_bytes(b"12345")
    (base / "b.PDF").write_bytes(b"1")
    got = {r["key"].rsplit("/", 1)[1]: r["size"] for r in IO.list_objects(spark, str(base)).collect()}
    assert got == {"a.pdf": 5, "b.PDF": 1}
    counts = {r["extension"]: r["files"] for r in IO.file_extension_counts(IO.scan_folder(spark, folder(tmp_path))).collect()}
    assert counts == {"pdf": 2, "png": 1, "txt": 1}
    IO.write_json(spark.createDataFrame([("f", [1, 2])], "file_name string, pages array<int>"), str(tmp_path / "json"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "json")).select("file_name", "pages").collect()] == [("f", [1, 2])]
    hashed = IO.with_hash(IO.scan_folder(spark, str(base))).where("file_name = 'a.pdf'").head()["file_hash"]
    import hashlib

    assert hashed == hashlib.sha256(b"12345").hexdigest()
