"""Content hashes, cache keys and storage paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    """SHA-256 of a file's bytes, hexadecimal."""
    return F.sha2(content, 256)


def cache_key(file_hash: Column, prompt: Column) -> Column:
    return F.concat_ws("_", file_hash, F.sha2(prompt.cast("binary"), 256))


def page_suffix(indexes: Column) -> Column:
    """``_pages_0_2_4`` wherever pages were asked for, also for all of them; empty for null."""
    return F.coalesce(F.concat(F.lit("_pages_"), F.array_join(indexes, "_")), F.lit(""))


def page_hash(number: Column, text: Column) -> Column:
    """``p{number}_`` and the first 16 digits of the text's SHA-256."""
    return F.concat(F.lit("p"), number.cast("string"), F.lit("_"), F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 16))


def video_key(file_hash: Column, prompt: Column, frame_rate: float, transcription_model: str | None = None) -> Column:
    """Null where there is no file hash, so that nothing is stored under a key of another file."""
    parts = [file_hash, F.sha2(prompt.cast("binary"), 256), F.lit(str(frame_rate))]
    if transcription_model:
        parts.append(F.lit(f"transcribe_{transcription_model}"))
    return F.when(file_hash.isNotNull(), F.concat_ws("_", *parts))


def transcript_key(file_hash: Column, model: Column, language: Column) -> Column:
    return F.when(file_hash.isNotNull(), F.concat_ws("_", file_hash, model, F.coalesce(F.nullif(language, F.lit("")), F.lit("auto"))))


def partial_path(key: Column) -> Column:
    return F.concat(key, F.lit("_partial.json"))


def entry_path(key: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), key, F.lit(".json"))


def image_folder(base: str, file_hash: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), file_hash)
