import pytest
from pyspark.sql import functions as F

from scrivane.functions import keys as K
from scrivane.functions import media as M
from scrivane.functions import prompts as P
from scrivane.functions import requests as R
from scrivane.functions import text as T
from scrivane.functions import transcript as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize(("raw", "want"), [
    ("a " + "QUJD" * 15 + "== b", "a  b"), ("x" + "&nbsp;" * 10 + "y", "x y"), ("x" + "&nbsp;" * 5 + "y", "x y"), ("x" + "&nbsp;" * 4 + "y", "x" + "&nbsp;" * 4 + "y"),
    ("", ""), (None, None), ("　 a\x1f", "a"), ("&NBSP;&nbsp;&Nbsp;&nbsp;&nbsp;", ""), ("A" * 49, "A" * 49), ("A" * 50, ""),
])
def test_clean(spark, raw, want):
    assert one(spark, T.clean(F.lit(raw).cast("string"))) == want


def test_clean_keeps_other_fields(spark):
    pages = F.array(F.struct(F.lit(1).alias("page_number"), F.lit(" a ").alias("page_content")))
    assert [p.asDict() for p in one(spark, T.clean_pages(pages))] == [{"page_number": 1, "page_content": "a"}]


@pytest.mark.parametrize(("raw", "want"), [("a b c\x1fd", 4), ("", 0), (None, 0), ("  ", 0), (" a\n\nb ", 2)])
def test_word_count_splits_at_any_white_space(spark, raw, want):
    assert one(spark, T.word_count(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("raw", "n", "want"), [("sk-1234567890abcdef", 4, "sk-1" + "*" * 15), ("abc", 5, "abc"), (None, 4, ""), ("", 4, "")])
def test_mask(spark, raw, n, want):
    assert one(spark, T.mask_secret(F.lit(raw).cast("string"), n)) == want


@pytest.mark.parametrize(("sec", "want"), [(0, "00:00"), (65, "01:05"), (300, "05:00"), (3661, "61:01"), (59.99, "00:59")])
def test_clock(spark, sec, want):
    assert one(spark, S.clock(F.lit(float(sec)))) == want


@pytest.mark.parametrize(("start", "want"), [(65.5, "[01:05.50] t"), (0.0, "[00:00.00] t"), (623.4, "[10:23.40] t"), (0.125, "[00:00.12] t"), (2.675, "[00:02.67] t"), (4.985, "[00:04.99] t"), (59.999, "[00:60.00] t")])
def test_lrc_rounds_the_binary_value(spark, start, want):
    assert spark.createDataFrame([(start, "t")], "s double, t string").select(S.lrc_line("s", "t").alias("v")).collect()[0]["v"] == want


def test_context_is_empty_without_segments(spark):
    assert one(spark, S.prompt_context(S.lrc_document(F.array().cast("array<string>")))) == ""
    assert one(spark, S.prompt_context(F.lit("[x]"))) == "\n--- Video Audio Transcription ---\n[x]\n---\n"


def test_transcript_defaults_and_bad_json(spark):
    t = one(spark, S.parse(F.lit('{"segments": [{"text": "a"}, {"start": 1.5}]}')))
    assert [(s["start"], s["end"], s["text"]) for s in t["segments"]] == [(0.0, 0.0, "a"), (1.5, 0.0, "")]
    assert (t["language"], t["duration"], t["full_text"]) == ("", 0.0, "")
    assert one(spark, S.parse(F.lit("{broken"))) is None


def test_speech_response_drops_blank_segments(spark):
    t = one(spark, S.speech_response(F.lit('{"language":"en","duration":3,"text":" a b ","segments":[{"start":0,"end":1,"text":" a "},{"start":1,"end":2,"text":"  "},{"text":"b"}]}')))
    assert [s["text"] for s in t["segments"]] == ["a", "b"] and t["full_text"] == "a b" and t["duration"] == 3.0


def test_keys(spark):
    assert one(spark, K.page_suffix(F.array(F.lit(0), F.lit(2), F.lit(4)))) == "_pages_0_2_4"
    assert one(spark, K.page_suffix(F.lit(None).cast("array<int>"))) == ""
    assert one(spark, K.video_key(F.lit(None).cast("string"), F.lit("p"), 0.5)) is None
    assert one(spark, K.transcript_key(F.lit("h"), F.lit("m"), F.lit(""))) == "h_m_auto"
    assert one(spark, K.page_hash(F.lit(3), F.lit(""))) == "p3_e3b0c44298fc1c14"


def test_page_prompt_adds_text_only_if_not_blank(spark):
    assert one(spark, P.page_prompt(F.lit("p"), F.lit(" \n　"))) == "p"
    assert one(spark, P.page_prompt(F.lit("p"), F.lit(None).cast("string"))) == "p"
    assert one(spark, P.page_prompt(F.lit("p"), F.lit("x"))).endswith("<text_content>\nx\n</text_content>")


def test_chunk_prompt(spark):
    args = [F.lit(x) for x in ("Describe the scene", 1, 5, 60.0, 120.0, 300.0, 30)]
    made = one(spark, P.chunk_prompt(*args, F.lit(None).cast("string"), 0.5))
    assert "Chunk 2/5" in made and "01:00 to 02:00" in made and "1 frame every 2.0 seconds" in made and made.endswith("(01:00 - 02:00).")
    args[2] = F.lit(1)
    assert "Note:" not in one(spark, P.chunk_prompt(*args, F.lit(None).cast("string"), 0.5))


@pytest.mark.parametrize(("model", "want"), [("gpt-5", True), ("gpt-5.2", True), ("o1", True), ("o3-mini", True), ("gpt-4.1", False), ("gpt-4-turbo", False), (None, False)])
def test_reasoning(spark, model, want):
    assert one(spark, R.is_reasoning(F.lit(model).cast("string"))) is want


def test_chat_parameters(spark):
    p = lambda m, e: one(spark, R.chat_parameters(F.lit(m), F.lit(9), F.lit(e).cast("string"), F.lit(0.5)))
    assert p("gpt-4.1", "high").asDict() == {"model": "gpt-4.1", "max_tokens": 9, "max_completion_tokens": None, "reasoning_effort": None, "temperature": 0.5}
    assert p("o1", "none")["temperature"] == 0.5 and p("o1", "high")["temperature"] is None and p("o1", None)["temperature"] is None


def test_response_parameters():
    assert R.response_parameters("gpt-5", 9, 0.1, "none") == {"model": "gpt-5", "store": False, "max_output_tokens": 9, "reasoning": {"effort": "none"}, "temperature": 0.1}
    assert R.response_parameters("gpt-4.1", 9, 0.1, previous="r1") == {"model": "gpt-4.1", "store": False, "max_output_tokens": 9, "previous_response_id": "r1", "temperature": 0.1}
    assert R.token_limit({"max_tokens": 1, "max_output_tokens": 3}, 7) == 3 and R.token_limit({}, 7) == 7


def test_last_system_message_wins(spark):
    m = spark.createDataFrame([(1, 0, "system", "a"), (1, 1, "user", "u"), (1, 2, "system", "b"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert sorted(tuple(r) for r in R.system_instructions(m).collect()) == [(1, "b", 1), (2, None, 1)]


def test_media(spark):
    assert one(spark, M.codec_name(F.lit(0x31637661))) == "avc1"
    assert one(spark, M.duration(F.lit(100), F.lit(0.0))) == 0.0
    assert tuple(one(spark, M.fitted(F.lit(4000), F.lit(1000), 2000))) == (2000, 500)
    assert one(spark, M.media_type(F.lit("a/foojpg"))) is None and one(spark, M.media_type(F.lit("x.PDF"))) == "pdf"
    assert one(spark, M.image_error(F.lit(2001), F.lit(5), F.lit(2), F.lit(4))) == "dimensions" and one(spark, M.image_error(F.lit(2001), F.lit(5), F.lit(1), F.lit(4))) is None


def test_clock_is_that_of_format_string_without_its_cost(spark, sf):
    from scrivane.plans import catalog

    odd = [None, 0.0, -0.0, 9.99, 10.0, 59.999, 60.0, 599.9, 600.0, 5999.0, 6000.0, 359999.5, -1.0, -0.5, -61.0, -700.0, float("nan")]
    d = spark.createDataFrame([(x,) for x in odd], "x double").union(spark.range(0, 400000, 7).select(F.col("id") / 3))
    plain = F.format_string("%02d:%02d", F.floor(F.col("x") / 60), F.floor(F.col("x") % 60))
    assert d.where(~plain.eqNullSafe(S.clock(F.col("x")))).isEmpty()
    made = catalog.queries()["chunk_prompt"](spark, sf)
    assert "format_string" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.select(F.spark_partition_id().alias("task")).distinct().count() > 1
