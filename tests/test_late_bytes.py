"""Content is read in the task that needs it: no exchange of a pipeline carries it, and failures stay rows."""

import re
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivane.functions import pixels as P
from scrivane.operators import cache as C
from scrivane.operators import model as X
from scrivane.plans.pipelines import process_images, process_videos, transcribe_videos
from scrivane.sources import content as K
from scrivane.sources import files as IO
from scrivane.sources import images as I
from scrivane.streaming.ingest import ingest, new_files

BYTES = {"content", "image", "images", "audio", "data"}


class Plans:
    """The columns that exchanges carried in all executions since it was made."""

    def __init__(self, spark):
        self.spark, self.store = spark, spark._jsparkSession.sharedState().statusStore()
        self.before = self.store.executionsCount()

    def exchanged(self):
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        made = self.store.executionsList()
        texts = [made.apply(i).physicalPlanDescription() for i in range(self.before, made.length())]
        blocks = [b for t in texts for b in re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*?)\]\n", t)]
        assert texts and blocks
        # An aggregate's buffers go by other names than the columns that they hold.
        return {re.sub(r"#.*", "", c).strip() for b in blocks for c in b.split(",")} | {c for t in texts for c in re.findall(r"partial_\w+\((\w+)#", t)}


def picture(high, wide, channels=3):
    return np.random.default_rng(high).integers(0, 255, (high, wide, channels), dtype=np.uint8)


def test_the_check_sees_bytes_that_travel(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x")
    plans = Plans(spark)
    IO.with_hash(IO.scan_folder(spark, str(tmp_path))).dropDuplicates(["file_hash"]).collect()
    assert "content" in plans.exchanged()


def test_images_stay_in_their_task(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for name, pixels in {"a.png": picture(20, 30), "b.png": picture(20, 30), "c.png": picture(5, 2500, 4)}.items():
        (d / name).write_bytes(P.encode_png(pixels))
    (d / "broken.png").write_bytes(b"no image")

    class Seeing(X.StubModel):
        def call(self, request):
            return X.Answer(str(P.decode_png(request.images[0]).shape))

    files = IO.with_hash(IO.scan_folder(spark, str(d))).where("media_type = 'image'")
    cache, plans = C.CacheTable(spark, str(tmp_path / "c")), Plans(spark)
    for _ in range(2):
        got = sorted((r["content"] or "", r["failed_pages"]) for r in process_images(files, Seeing, "p", cache).collect())
        assert got == [("", 1), ("(20, 30, 3)", 0), ("(4, 2000, 3)", 0)]
    assert not plans.exchanged() & BYTES and cache.read().count() == 2


def test_videos_stay_in_their_task_and_are_read_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    class Frames:
        def frames(self, content, positions):
            return (b"%s@%d;" % (content, p) for p in positions)

    class Showing(X.StubModel):
        def call(self, request):
            return X.Answer(b"".join(request.images).decode() or "synthesis")

    def reader(path):
        reads.add(1)
        return K.fetch(path)

    for k in "ab":
        (tmp_path / f"{k}.mp4").write_bytes(k.encode())
    videos = IO.with_hash(IO.scan_folder(spark, str(tmp_path))).select(F.col("file_hash").alias("k"), "path", F.lit(150.0).alias("duration"), F.lit(10.0).alias("fps"), "content")
    segments = spark.createDataFrame([], "k string, seg_idx int, start double, end double, text string")
    plans = Plans(spark)
    got = process_videos(videos, segments, Showing, "P", key="k", decoder=Frames, reader=reader).collect()
    assert [(r["n_chunks"], r["failed_chunks"], r["answer"]) for r in got] == [(3, 0, "synthesis")] * 2
    assert not plans.exchanged() & BYTES and reads.value == 2


def test_audio_stays_in_its_task(spark, tmp_path):
    class Tracks:
        def audio(self, content):
            return b"mp3:" + content

    class Words:
        name = "w"

        def transcribe(self, audio, language):
            return '{"segments": [{"start": 0, "end": 1, "text": "%s"}], "language": "en", "duration": 1, "text": "t"}' % audio.decode()

    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.mp4").write_bytes(b"one")
    cache, plans = C.CacheTable(spark, str(tmp_path / "c")), Plans(spark)
    videos = IO.with_hash(IO.scan_folder(spark, str(tmp_path / "v")))
    got = transcribe_videos(videos, cache, Tracks, Words).collect()
    assert got[0]["transcript"]["segments"][0]["text"] == "mp3:one" and "content" not in got[0].asDict()
    assert not plans.exchanged() & BYTES


def test_ingestion_shuffles_no_content(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.txt", "b.txt", "same.txt"):
        (tmp_path / "in" / name).write_bytes(name[:1].replace("s", "a").encode())
    cache, plans = C.CacheTable(spark, str(tmp_path / "c")), Plans(spark)
    process = lambda files: K.with_content(files).select("cache_key", F.col("content").cast("string").alias("value"))
    ingest(new_files(spark, str(tmp_path / "in"), "*.txt"), cache, process, "p", str(tmp_path / "check")).awaitTermination()
    assert sorted(r["value"] for r in cache.read().collect()) == ["a", "b"]
    assert not plans.exchanged() & BYTES


def test_content_by_path(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "BATCH_BYTES", 4)
    (tmp_path / "a b.bin").write_bytes(b"12345")
    (tmp_path / "empty").write_bytes(b"")
    rows = [(1, f"file:{tmp_path}/a b.bin"), (2, f"{tmp_path}/empty"), (3, f"file://{tmp_path}/none"), (4, None), (5, "nosuch://x/y"), (6, f"file://{tmp_path}/a b.bin")]
    df = spark.createDataFrame(rows, "i int, path string").withColumn("content", F.lit("clash")).coalesce(1)
    got = {r["i"]: (r["content"], (r["content_error"] or "").split(":")[0]) for r in K.with_content(df).collect()}
    assert got[1] == got[6] == (b"12345", "") and got[2] == (b"", "") and got[3] == (None, "FileNotFoundError") and got[4] == (None, "") and got[5][0] is None and got[5][1]
    assert K.with_content(df.where("false")).isEmpty()


def test_a_loader_holds_one_file(tmp_path):
    held, most, reads = [], [], []

    def take(content, n):
        held.append(content)
        most.append(len(held))
        time.sleep(0.001)
        held.pop()
        return [content] * n

    loader = K.Loader(take, lambda path: reads.append(path) or path.encode())
    threads = [threading.Thread(target=lambda p=p: loader(p, 2)) for p in ["a"] * 5 + ["b"] * 5]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert max(most) == 1 and loader(None, 1) == [] and loader("c", 2) == [b"c", b"c"]

    def broken(path):
        raise OSError(path)

    with pytest.raises(OSError):
        K.Loader(take, broken)("a", 1)


# Limits before the call.


def test_requests_are_fitted_or_refused_before_the_call(spark):
    calls = spark.sparkContext.accumulator(0)

    class Counting(X.StubModel):
        def call(self, request):
            calls.add(1)
            return X.Answer(" ".join(str(P.decode_png(i).shape[:2]) for i in request.images))

    shapes = {"small": [(9, 7)], "large": [(3136, 4)], "exact": [(1568, 2)], "too large": [(8001, 1)], "two": [(2000, 2), (3, 3)], "two large": [(2001, 2), (3, 3)], "broken": [], "none": []}
    rows = [(k, "look", [bytearray(P.encode_png(picture(*s))) for s in v] if k != "broken" else [bytearray(b"x")]) for k, v in shapes.items()]
    df = spark.createDataFrame(rows, "k string, prompt string, images array<binary>")
    got = {r["k"]: (r["result"], r["error"]) for r in X.map_model(df, I.limited(Counting), keys=["k"], images="images", attempts=1).collect()}
    assert got["small"] == ("(9, 7)", None) and got["large"] == ("(1568, 2)", None) and got["exact"] == ("(1568, 2)", None) and got["two"] == ("(1568, 1) (3, 3)", None) and got["none"] == ("", None)
    refused = "ValueError: image refused: dimensions"
    assert got["too large"] == got["two large"] == (None, refused) and got["broken"] == (None, "ValueError: no PNG")
    assert calls.value == 5


@pytest.mark.parametrize("case", [(8000, 8000, 1, 10), (8001, 1, 1, 10), (2000, 2000, 2, 10), (1, 2001, 2, 10), (10, 10, 1, 3932160), (10, 10, 1, 3932161), (10, 10, 101, 5)])
def test_refusals_equal_the_column_form(spark, case):
    from scrivane.functions.media import base64_length, image_error

    w, h, n, size = case
    want = spark.range(1).select(image_error(F.lit(w), F.lit(h), F.lit(n), base64_length(F.lit(size))).alias("e")).head()["e"]
    assert I.refused(w, h, n, size) == want


def test_many_images_and_large_files_are_refused(monkeypatch):
    small = P.encode_png(picture(2, 2))
    with pytest.raises(ValueError, match="too many images"):
        I.within_limits([small] * 101, I.PngCodec())
    monkeypatch.setattr(I, "MOST_BASE64", 40)
    with pytest.raises(ValueError, match="file size"):
        I.within_limits([P.encode_png(picture(30, 30))], I.PngCodec())
