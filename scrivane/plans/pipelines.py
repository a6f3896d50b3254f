"""Whole pipelines: pages to documents, template capture, videos by chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.functions import keys as K
from scrivane.functions import prompts as P
from scrivane.functions import text as T
from scrivane.functions import transcript as S
from scrivane.operators import cache as C
from scrivane.operators import model as X
from scrivane.operators import timeline as L
from scrivane.operators.limits import Leases
from scrivane.sources.content import Reader, distinct_files, fetch, with_content
from scrivane.sources.files import AudioExtractor, FrameDecoder, extract_audio, frame_loader
from scrivane.sources.images import ImageCodec, PngCodec, image_loader

#: Fixed values of a video job: seconds of a video, frames a second, seconds of a chunk.
MOST_SECONDS, FRAME_RATE, CHUNK_SECONDS = 300, 0.5, 60
#: Chunks whose transcripts lie in one row before chunks are made of it.
CONTEXT_BLOCK = 64


def process_pages(pages: DataFrame, factory: Callable[[], X.Model], prompt: str = P.DEFAULT_PROMPT, cache: C.CacheTable | None = None, *, images: list[str] | None = None, load: Callable[[], Callable[..., list[bytes]]] | None = None, limit: Leases | None = None) -> DataFrame:
    """Pages (file_hash, page_number, text, and image where there is one) to assembled documents.

    Images are better not carried: with ``images`` and ``load`` they are made from
    those columns right before the call (see map_model).

    Stored pages of the same file, prompt and page hash are used again; only the
    others go to the model. New answers are written to the cache before anything
    reads them. Pages whose call failed are left out of the document's content
    and counted in ``failed_pages``. ``limit`` bounds the calls of the whole job
    (see map_model), as in the other pipelines here.
    """
    base = pages.withColumns({"cache_key": F.concat_ws("_", K.cache_key(F.col("file_hash"), F.lit(prompt)), K.page_hash(F.col("page_number"), F.col("text"))), "prompt": P.page_prompt(F.lit(prompt), F.col("text"))})
    done = cache.read(base).select("cache_key", F.col("value").alias("result")) if cache else None
    todo = base.join(done.select("cache_key"), "cache_key", "left_anti") if done is not None else base
    keys = ["file_hash", "page_number", "cache_key"]
    made = X.map_model(todo, factory, keys=keys, images=images or ("image" if "image" in pages.columns else None), load=load, limit=limit)
    made = made.withColumn("page_content", T.clean(T.strip(F.col("result"))))
    if cache is not None:
        # The call's answers exist once: write them, then read them back.
        cache.write(made.where("error is null").select("cache_key", F.col("page_content").alias("value")))
        stored = cache.read(base).select("cache_key", F.col("value").alias("page_content"))
        made = base.select(*keys).join(stored, "cache_key", "left").withColumn("error", F.when(F.col("page_content").isNull(), "failed"))
    # One aggregation, so that without a cache every page is still called once only.
    fine = F.col("error").isNull()
    page = F.when(fine, F.struct(F.col("page_number").cast("int").alias("page_number"), "page_content"))
    out = made.groupBy("file_hash").agg(
        F.count_if(~fine).alias("failed_pages"), F.array_sort(F.collect_list(page)).alias("pages"),
        F.sum(F.when(fine, T.word_count(F.col("page_content")))).alias("total_words"), F.count_if(fine).alias("n_pages"),
    )
    return out.withColumn("content", F.array_join(F.transform("pages", lambda p: F.coalesce(p["page_content"], F.lit(""))), "\n"))


def capture_template(documents: DataFrame, factory: Callable[[], X.Model], template: str, key: str = "file_hash", limit: Leases | None = None) -> DataFrame:
    """One more call for each document: its content in the form of a template; the answer is the model's text as it is."""
    return X.map_model(documents.withColumn("prompt", P.template_prompt(F.lit(template), F.col("content"))), factory, keys=[key], limit=limit)


def process_videos(videos: DataFrame, segments: DataFrame, factory: Callable[[], X.Model], prompt: str, *, key: str = "video_hash", chunk: float = CHUNK_SECONDS, rate: float = FRAME_RATE, decoder: Callable[[], FrameDecoder] | None = None, path: str = "path", reader: Reader = fetch, limit: Leases | None = None) -> DataFrame:
    """Videos (key, duration, fps) and transcript segments to one answer for each video.

    Chunks are independent and run in parallel; each gets the segments that
    overlap it. One chunk's answer is the video's; several are put together by a
    further call. With a ``decoder`` the task that asks about a chunk reads the video
    at ``path`` and decodes the chunk's frames; the plan carries paths and frame
    positions only, and the chunks of a video go to one task, which reads it once.
    Without one the answer comes from the text alone. Returns the key, n_chunks (those
    answered), failed_chunks, answer and error, one row for each video: a chunk whose
    frames or call failed is counted, and error is the synthesis' or else the first
    such chunk's.
    """
    tasks = int(videos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = videos.select(key, "duration", "fps", *([F.col(path).alias("_path")] if decoder else []))
    frames = F.floor((F.col("end_sec") - F.col("start_sec")) * rate).cast("int")
    # Transcripts meet blocks of chunks, which are few, and no chunk is sorted or sent for them.
    spoken = L.touched_chunks(columns, segments.withColumn("line", S.lrc_line(F.col("start"), F.col("text"))), key, chunk)
    spoken = spoken.withColumn("_block", F.floor(F.col("chunk_idx") / CONTEXT_BLOCK).cast("int")).repartition(tasks, key, "_block")
    ordered = F.array_sort(F.collect_list(F.struct("seg_idx", "start", "end", "text", "line")))
    lrc = spoken.groupBy(key, "_block", "chunk_idx").agg(ordered.alias("l")).withColumn("context", S.prompt_context(S.lrc_document(F.transform("l", lambda x: x["line"]))))
    lrc = lrc.groupBy(key, "_block").agg(F.map_from_entries(F.collect_list(F.struct("chunk_idx", "context"))).alias("_contexts"))
    blocks = L.chunk_blocks(columns, chunk, CONTEXT_BLOCK).repartition(tasks, key, "_block").join(lrc, [key, "_block"], "left")
    asked = L.block_chunks(blocks, chunk, CONTEXT_BLOCK).withColumn("context", F.try_element_at("_contexts", F.col("chunk_idx"))).drop("_contexts")
    text = P.chunk_prompt(F.lit(prompt), F.col("chunk_idx"), F.col("total_chunks"), F.col("start_sec"), F.col("end_sec"), F.col("duration"), frames, F.col("context"), rate)
    asked = asked.withColumn("prompt", text)
    keys = [key, "chunk_idx", "start_sec", "end_sec", "duration"]
    if decoder is None:
        answers = X.map_model(asked, factory, keys=keys, limit=limit)
    else:
        at = L.range_frame_plan(L.chunk_plan(columns, chunk), rate).groupBy(key, "chunk_idx").agg(F.array_sort(F.collect_list("frame_position")).alias("positions"))
        shown = asked.join(at, [key, "chunk_idx"], "left")
        # A number of partitions of its own: tasks are few megabytes, but each waits for many calls.
        shown = shown.repartition(tasks, key).sortWithinPartitions(key, "chunk_idx")
        answers = X.map_model(shown, factory, keys=keys, images=["_path", "positions"], load=frame_loader(decoder, reader=reader), limit=limit)
    # Answers travel once, with none of them put together before.
    folded = L.fold(answers.repartition(tasks, key), key, prompt, rate)
    # One pass over the chunks' answers: a single chunk's answer is taken as it is, and where there is none nothing is asked.
    folded = folded.withColumn("answer", F.when(F.col("n_chunks") == 0, "").otherwise(F.col("answer")))
    made = X.map_model(folded, factory, keys=[key, "n_chunks", "failed_chunks", "chunk_error"], known="answer", limit=limit)
    return made.select(key, "n_chunks", "failed_chunks", F.when(F.col("n_chunks") > 0, F.col("result")).alias("answer"), F.coalesce("error", "chunk_error").alias("error"))


def process_images(files: DataFrame, factory: Callable[[], X.Model], prompt: str = P.DEFAULT_PROMPT, cache: C.CacheTable | None = None, codec: Callable[[], ImageCodec] = PngCodec, *, reader: Reader = fetch, limit: Leases | None = None) -> DataFrame:
    """Image files (path, file_hash) to documents of one page each; files that cannot be read or decoded are in ``failed_pages`` and have no content.

    Transparency is laid on white and the longer side is a page's at most. A file
    that repeats is asked about once. Files are told apart, and looked up in the
    cache, by hash and path; the task that asks about one reads and decodes it.
    """
    pages = distinct_files(files, "file_hash").select("file_hash", F.lit(1).alias("page_number"), F.lit("").alias("text"), "path")
    made = process_pages(pages, factory, prompt, cache, images=["path"], load=image_loader(codec, reader=reader), limit=limit)
    return made.withColumn("content", F.when(F.col("n_pages") > 0, F.col("content")))


def transcribe_videos(videos: DataFrame, cache: C.CacheTable, extractor: Callable[[], AudioExtractor], transcriber: Callable[[], X.Transcriber], *, model: str = "whisper-1", language: str | None = None, reader: Reader = fetch) -> DataFrame:
    """Videos (file_hash, path) with ``transcript``: the stored one, else one made now and stored; null where that fails.

    The key is the file's, the model's and the language's, so a transcript serves
    every prompt. A column ``content`` is left out: videos are read where their
    audio is extracted, and only those without a stored transcript.
    """
    work = videos.drop("content").withColumn("cache_key", K.transcript_key(F.col("file_hash"), F.lit(model), F.lit(language)))

    def compute(misses: DataFrame) -> DataFrame:
        read = with_content(misses.select("cache_key", "path"), reader=reader)
        spoken = X.map_transcriber(extract_audio(read, extractor, key="cache_key"), transcriber, key="cache_key", audio="audio", language=language)
        return spoken.select("cache_key", F.when(F.col("response").isNotNull(), S.to_json(S.speech_response(F.col("response")))).alias("value"))

    return C.get_or_compute(work, cache, compute).withColumn("transcript", S.parse(F.col("value"))).drop("value", "cache_key")


def transcript_segments(transcribed: DataFrame, key: str) -> DataFrame:
    """The segments of each transcript, as process_videos takes them."""
    parts = transcribed.select(key, F.posexplode("transcript.segments").alias("seg_idx", "s"))
    return parts.select(key, "seg_idx", "s.start", "s.end", "s.text")


def answer_videos(videos: DataFrame, segments: DataFrame, cache: C.CacheTable, factory: Callable[[], X.Model], prompt: str, *, key: str = "file_hash", rate: float = FRAME_RATE, transcription_model: str | None = None, bypass: bool = False, **options) -> DataFrame:
    """Videos with ``answer``: the stored one of the same file, prompt, rate and transcription, else process_videos', stored first.

    ``key`` is the file's hash. An answer with failed chunks is stored like any
    other; a video without an answer is not. A column ``content`` is left out.
    """
    work = videos.drop("content").withColumn("cache_key", K.video_key(F.col(key), F.lit(prompt), rate, transcription_model))

    def compute(misses: DataFrame) -> DataFrame:
        made = process_videos(misses, segments, factory, prompt, key=key, rate=rate, **options)
        value = F.when(F.col("answer").isNotNull(), F.to_json(F.struct(F.col("answer").alias("result"))))
        return misses.select(key, "cache_key").join(made.select(key, value.alias("value")), key).select("cache_key", "value")

    found = C.get_or_compute(work, cache, compute, bypass=bypass)
    return found.withColumn("answer", F.get_json_object("value", "$.result")).drop("value", "cache_key")
