import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scrivane.operators import cache as C
from scrivane.operators import model as X
from scrivane.operators import pages as G
from scrivane.operators import timeline as L
from scrivane.plans.pipelines import capture_template, process_pages, process_videos


def test_selected_pages(spark):
    d = spark.createDataFrame([([1, 1, 3, 3], 5), ([0, 2, 4], 5), ([3], 10)], "i array<int>, n int")
    assert [r["v"] for r in d.select(G.selected_pages(F.col("i"), F.col("n")).alias("v")).collect()] == [[1, 3], [0, 2, 4], [3]]
    for bad in ([0, 5, 10], [-1, 0]):
        b = spark.createDataFrame([(bad, 5)], "i array<int>, n int")
        with pytest.raises(PySparkException):
            b.select(G.selected_pages(F.col("i"), F.col("n"))).collect()
        assert b.select(G.selection_error(F.col("i"), F.col("n")).alias("e")).collect()[0]["e"]


def test_assemble_sorts_pages_as_numbers(spark):
    p = spark.createDataFrame([("d", str(i), f"t{i} x") for i in (10, 2, 1)], "d string, page_number string, page_content string")
    r = G.assemble(p, "d").collect()[0]
    assert [x["page_number"] for x in r["pages"]] == [1, 2, 10] and r["content"] == "t1 x\nt2 x\nt10 x" and r["total_words"] == 6


def test_lookup_order(spark):
    cache = spark.createDataFrame([("a", "file", "af"), ("a", "s3", "as"), ("b", "file", "bf"), ("c", "s3", "")], "cache_key string, tier string, value string")
    asked = spark.createDataFrame([(1, ["a", "b"], False), (2, ["x", "b"], False), (3, ["a"], True), (4, ["c", "x"], None)], "request_id int, keys array<string>, bypass boolean")
    got = {r["request_id"]: (r["value"], r["hit_tier"]) for r in C.lookup(asked, cache, bypass="bypass").collect()}
    assert got == {1: ("as", "s3"), 2: ("bf", "file"), 3: (None, None), 4: (None, None)}


def test_cache_table(spark, tmp_path):
    t = C.CacheTable(spark, str(tmp_path / "cache"))
    assert t.read().isEmpty()
    t.write(spark.createDataFrame([("k1", "1"), ("k2", "2"), (None, "3")], "cache_key string, value string"))
    t.write(spark.createDataFrame([("k1", "new")], "cache_key string, value string"))
    assert {(r["cache_key"], r["value"]) for r in t.read().collect()} == {("k1", "new"), ("k2", "2")}
    t.invalidate(spark.createDataFrame([("k2",)], "cache_key string"))
    assert [r["cache_key"] for r in t.read().collect()] == ["k1"]
    t.clear()
    assert t.read().isEmpty()


def test_broken_partial_json_has_no_pages(spark):
    d = spark.createDataFrame([("k", "{broken"), ("m", '{"2": {"page_number": 2, "page_content": "c", "page_hash": "h"}}')], "cache_key string, value string")
    assert [tuple(r) for r in C.from_partial_json(d).collect()] == [("m", 2, "c", "h")]


def test_chunk_count_is_not_a_ceiling(spark):
    d = spark.createDataFrame([(60.0,), (60.5,), (61.0,), (0.0,), (300.0,)], "duration double")
    assert [r["n"] for r in d.select(L.n_chunks(F.col("duration"), 60).alias("n")).collect()] == [1, 1, 2, 1, 5]


def test_overlap(spark):
    chunks = spark.createDataFrame([("v", i, 60.0 * i, 60.0 * (i + 1)) for i in range(3)], "k string, chunk_idx int, start_sec double, end_sec double")
    spans = [(0.0, 10.0), (10.0, 25.0), (55.0, 70.0), (70.0, 80.0), (120.0, 130.0), (60.0, 60.0), (90.0, 90.0), (59.0, 181.0), (30.0, 60.0)]
    segments = spark.createDataFrame([("v", n, s, e, "t") for n, (s, e) in enumerate(spans)], "k string, seg_idx int, start double, end double, text string")
    pairs = lambda d: sorted((r["chunk_idx"], r["seg_idx"]) for r in d.collect())
    fast = pairs(L.overlap_join(chunks, segments, "k", 60.0))
    assert fast == pairs(L.overlap_join_nested(chunks, segments, "k"))
    assert [s for c, s in fast if c == 1 and s < 5] == [2, 3]


def test_fold(spark):
    r = spark.createDataFrame([("a", 0, 0.0, 10.0, 10.0, "only"), ("b", 1, 60.0, 90.0, 90.0, "two"), ("b", 0, 0.0, 60.0, 90.0, "one")], "k string, chunk_idx int, start_sec double, end_sec double, duration double, result string")
    got = {x["k"]: x for x in L.fold(r, "k", "P", 0.5).collect()}
    assert got["a"]["answer"] == "only" and got["a"]["prompt"] is None
    assert got["b"]["answer"] is None and got["b"]["prompt"].index("one") < got["b"]["prompt"].index("two") and got["b"]["prompt"].endswith("P")


def test_model_rows(spark):
    rows = spark.createDataFrame([(1, "fine"), (2, "FILTER me"), (3, "FAIL"), (4, None)], "id int, prompt string")
    got = {r["id"]: r for r in X.map_model(rows, lambda: X.StubModel("FILTER", "FAIL"), keys=["id"]).collect()}
    assert got[1]["tries"] == 1 and got[1]["error"] is None and got[1]["total_tokens"] == 2
    assert got[2]["tries"] == 2 and got[2]["result"].startswith("stub:")
    assert got[3]["tries"] == 2 and got[3]["result"] is None and "stub failure" in got[3]["error"]
    assert got[4]["error"] is None


def test_provider_parameters():
    r = X.Request("hi", [b"1", b"2"])
    a = X.Provider("anthropic", "m", "k").parameters(r)
    assert [c["type"] for c in a["messages"][0]["content"]] == ["text", "image", "text", "image", "text"] and a["max_tokens"] == 4096
    chat = X.Provider("chat", "o1", "k", reasoning_effort="high").parameters(X.Request("hi"))
    assert "temperature" not in chat and chat["max_completion_tokens"] == 4096
    assert "max_tokens" in X.Provider("gemini", "gpt-5-like", "k").parameters(X.Request("hi"))
    talk = X.Request("", messages=[{"role": "system", "content": "a"}, {"role": "user", "content": "u"}, {"role": "system", "content": "b"}])
    made = X.Provider("responses", "gpt-5", "k").parameters(talk)
    assert made["instructions"] == "b" and made["input"] == [{"role": "user", "content": "u"}] and made["store"] is False
    with pytest.raises(ValueError):
        X.Provider("chat", "m").check()


def test_provider_choice():
    assert X.provider_from({"OPENAI_API_KEY": "k", "GEMINI_API_KEY": "g"}).kind == "gemini"
    assert X.provider_from({"USE_VISION": "openai", "OPENAI_API_KEY": "k", "OPENAI_USE_RESPONSES_API": "true"}).kind == "responses"
    assert X.provider_from({"USE_VISION": "unknown", "ANTHROPIC_API_KEY": "k"}).kind == "anthropic"
    with pytest.raises(ValueError):
        X.provider_from({})


def test_second_run_calls_nothing(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    class Counting(X.StubModel):
        def call(self, request):
            calls.add(1)
            return super().call(request)

    cache = C.CacheTable(spark, str(tmp_path / "cache"))
    pages = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b")], "file_hash string, page_number int, text string")
    first = process_pages(pages, Counting, "p", cache).collect()
    assert calls.value == 2
    assert process_pages(pages, Counting, "p", cache).collect() == first and calls.value == 2
    more = spark.createDataFrame([("f", 1, "a"), ("f", 2, "changed")], "file_hash string, page_number int, text string")
    process_pages(more, Counting, "p", cache).collect()
    assert calls.value == 3


def test_each_chunk_is_called_once(spark):
    calls = spark.sparkContext.accumulator(0)

    class Counting(X.StubModel):
        def call(self, request):
            calls.add(1)
            return super().call(request)

    videos = spark.createDataFrame([("a", 30.0, 25.0), ("b", 150.0, 25.0)], "k string, duration double, fps double")
    segments = spark.createDataFrame([("b", 0, 50.0, 70.0, "t")], "k string, seg_idx int, start double, end double, text string")
    got = {r["k"]: r["n_chunks"] for r in process_videos(videos, segments, Counting, "P", key="k").collect()}
    assert got == {"a": 1, "b": 3} and calls.value == 1 + 3 + 1


def test_frames_reach_the_model_and_failures_stay(spark, tmp_path):
    class Frames:
        def frames(self, content, positions):
            if content == b"bad" or content == b"half" and positions[0] > 0:
                raise ValueError("broken")
            return (b"%s@%d;" % (content, p) for p in positions)

    class Showing(X.StubModel):
        def call(self, request):
            if "FAIL" in request.prompt or b"".join(request.images).startswith(b"deaf"):
                raise RuntimeError("no")
            return X.Answer(b"".join(request.images).decode() or "synthesis")

    rows = [("a", 6.0, 25.0, b"one"), ("b", 66.0, 10.0, b"two"), ("c", 66.0, 10.0, b"half"), ("d", 66.0, 10.0, b"bad"), ("e", 6.0, 25.0, b"deaf"), ("f", 1.0, 25.0, b"short")]
    for k, _, _, content in rows:
        (tmp_path / k).write_bytes(content)
    rows = [(k, d, f, f"file:{tmp_path}/{k}") for k, d, f, _ in rows] + [("g", 6.0, 25.0, f"{tmp_path}/none")]
    videos = spark.createDataFrame(rows, "k string, duration double, fps double, path string")
    segments = spark.createDataFrame([], "k string, seg_idx int, start double, end double, text string")
    got = {r["k"]: tuple(r)[1:] for r in process_videos(videos, segments, Showing, "P", key="k", decoder=Frames).collect()}
    assert got["a"] == (1, 0, "one@0;one@50;one@100;", None) and got["b"] == (2, 0, "synthesis", None) and got["f"] == (1, 0, "synthesis", None)
    assert got["c"][:3] == (1, 1, "synthesis") and got["c"][3] == "ValueError: broken"
    assert got["d"] == (0, 2, None, "ValueError: broken") and got["e"] == (0, 1, None, "RuntimeError: no")
    assert got["g"][:3] == (0, 1, None) and got["g"][3].startswith("FileNotFoundError")
    # Without frames: a video whose chunks all fail stays too.
    none = process_videos(videos, segments, Showing, "FAIL", key="k").collect()
    assert len(none) == 7 and all(r["n_chunks"] == 0 and r["failed_chunks"] > 0 and r["answer"] is None and r["error"] == "RuntimeError: no" for r in none)


def test_capture_template(spark):
    docs = spark.createDataFrame([("f", "content")], "file_hash string, content string")
    assert capture_template(docs, X.StubModel, "a: string").collect()[0]["result"].startswith("stub:")


def test_a_local_model_is_called_without_threads(spark):
    import threading

    class Here(X.StubModel):
        def call(self, request):
            return X.Answer(threading.current_thread().name)

    class There(Here):
        local = False

    rows = spark.range(50).select("id", F.lit("x").alias("prompt"))
    names = lambda factory: {r["result"].split("_")[0] for r in X.map_model(rows, factory, keys=["id"]).collect()}
    assert names(Here) == {"MainThread"} and names(There) != {"MainThread"}
