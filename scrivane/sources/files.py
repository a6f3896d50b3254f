"""Files as tables: scans, routing, probes, decoders, sinks."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.functions.keys import content_hash
from scrivane.functions.media import AUDIO_SOURCE_FORMATS, FRAME_SIDE, extension, media_type
from scrivane.operators.pages import markdown
from scrivane.sources.content import Loader, Reader, fetch
from scrivane.sources.objects import list_store, write_objects


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files right in a folder: path, file_name, length, modificationTime, content, media_type, status.

    Files of other types stay, with status ``skipped``; filter them before the
    content is needed. Works on any store Spark can read, ``s3a://`` included.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    kind = media_type(F.col("path"))
    return files.withColumns({"file_name": F.regexp_extract("path", r"([^/]+)$", 1), "media_type": kind, "status": F.when(kind.isNull(), "skipped").otherwise("ok")})


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("file_hash", content_hash(F.col("content")))


def listed_objects(objects: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Keys below a prefix, without the prefix itself and without stored page images."""
    return objects.where(F.col(key).startswith(prefix) & (F.col(key) != prefix) & ~F.col(key).contains("/images/"))


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """key and size of all objects below a path, page images left out; contents are not read."""
    return list_store(spark, path).where(~F.col("key").contains("/images/")).select("key", "size")


class PageDecoder(Protocol):
    """Decodes a file's bytes; pages outside ``wanted`` (zero-based, or None for all) are not decoded."""

    def pages(self, content: bytes, wanted: list[int] | None) -> Iterator[tuple[int, str, bytes | None]]: ...

    def info(self, content: bytes) -> dict[str, Any]: ...


PAGES = "path string, file_hash string, page_number int, text string, image binary, error string"


def decode_pages(files: DataFrame, factory: Callable[[], PageDecoder], indexes: str | None = None) -> DataFrame:
    """One row for each page of each file, and one row with an error for a file that cannot be decoded.

    ``indexes``: a column of wanted zero-based pages; they are pushed into the decoder.
    """
    cols = ["path", "file_hash", "content", *([indexes] if indexes else [])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = factory()
        names = [c.split()[0] for c in PAGES.split(", ")]
        for part in parts:
            for r in part.itertuples(index=False):
                wanted = getattr(r, indexes) if indexes else None
                try:
                    rows = [(r.path, r.file_hash, i + 1, text, image, None) for i, text, image in decoder.pages(bytes(r.content), None if wanted is None else list(wanted))]
                except Exception as e:  # noqa: BLE001  the row carries it
                    rows = [(r.path, r.file_hash, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names).astype({"page_number": "Int32"})

    return files.select(*cols).mapInPandas(run, PAGES)


def probe(files: DataFrame, factory: Callable[[], PageDecoder]) -> DataFrame:
    """Metadata of each file: status (success or error), message, and info as a map with lower-case names; never raises."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = factory()
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    info = {str(k).lower(): str(v) for k, v in decoder.info(bytes(content)).items() if v}
                    out.append((path, "success", None, info))
                except Exception as e:  # noqa: BLE001
                    out.append((path, "error", f"{type(e).__name__}: {e}", {}))
            yield pd.DataFrame(out, columns=["path", "status", "message", "info"])

    probed = files.select("path", "content").mapInPandas(run, "path string, status string, message string, info map<string,string>")
    stat = files.select("path", F.col("length").alias("file_size_bytes"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified_at"))
    return probed.join(stat, "path")


class TextDecoder:
    """Decodes plain text; a form feed ends a page. For tests and text files."""

    def pages(self, content: bytes, wanted: list[int] | None) -> Iterator[tuple[int, str, bytes | None]]:
        for i, page in enumerate(content.decode("utf-8").split("\f")):
            if wanted is None or i in wanted:
                yield i, page, None

    def info(self, content: bytes) -> dict[str, Any]:
        return {"number_of_pages": content.decode("utf-8").count("\f") + 1}


class PdfDecoder:
    """PDF pages as text and PNG. Needs a PDF library on the workers, which this environment lacks, so it is not exercised by the tests."""

    def __init__(self, dpi: int = 333):
        import fitz

        self.library, self.dpi = fitz, dpi

    def pages(self, content: bytes, wanted: list[int] | None) -> Iterator[tuple[int, str, bytes | None]]:
        with self.library.open(stream=content, filetype="pdf") as doc:
            for i in range(len(doc)) if wanted is None else wanted:
                zoom = self.dpi / 72
                yield i, doc[i].get_text(), doc[i].get_pixmap(matrix=self.library.Matrix(zoom, zoom)).tobytes("png")

    def info(self, content: bytes) -> dict[str, Any]:
        with self.library.open(stream=content, filetype="pdf") as doc:
            out = {"number_of_pages": len(doc), **(doc.metadata or {})}
            if len(doc):
                r = doc[0].rect
                out |= {"page_width": r.width, "page_height": r.height, "page_size": f"{r.width}x{r.height}"}
            return out


class FrameDecoder(Protocol):
    """Decodes a video's bytes: the frames at the given positions, in their order, as encoded images."""

    def frames(self, content: bytes, positions: list[int]) -> Iterator[bytes]: ...

    def info(self, content: bytes) -> dict[str, Any]: ...


def decode_frames(plan: DataFrame, factory: Callable[[], FrameDecoder], *, key: str, content: str = "content") -> DataFrame:
    """The frames of each row's range: key, chunk_idx, images (an array of binary) and error.

    ``plan``: key, the video's bytes, and ranges (an array of structs of chunk_idx
    and positions). A range with a frame that cannot be decoded has an error and no images.
    """
    kind = dict(plan.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = factory()
        for part in parts:
            for k, raw, ranges in zip(part[key], part[content], part["ranges"], strict=True):
                for r in ranges:
                    positions = [int(p) for p in r["positions"]]
                    try:
                        images = list(decoder.frames(bytes(raw), positions))
                        if len(images) != len(positions):
                            raise ValueError(f"{len(images)} of {len(positions)} frames decoded")
                        out = (k, r["chunk_idx"], images, None)
                    except Exception as e:  # noqa: BLE001  the row carries it
                        out = (k, r["chunk_idx"], None, f"{type(e).__name__}: {e}")
                    yield pd.DataFrame([out], columns=[key, "chunk_idx", "images", "error"])

    return plan.select(key, content, "ranges").mapInPandas(run, f"`{key}` {kind}, chunk_idx int, images array<binary>, error string")


def frame_loader(factory: Callable[[], FrameDecoder], *, reader: Reader = fetch) -> Callable[[], Loader]:
    """For map_model: a video's path and frame positions (null or none: no images) to the frames; a frame that cannot be decoded is an error."""

    def make() -> Loader:
        decoder = factory()

        def take(content: bytes, positions) -> list[bytes]:
            wanted = [] if positions is None else [int(p) for p in positions]
            images = list(decoder.frames(content, wanted)) if wanted else []
            if len(images) != len(wanted):
                raise ValueError(f"{len(images)} of {len(wanted)} frames decoded")
            return images

        return Loader(take, reader)

    return make


class VideoDecoder:
    """Video frames as JPEG, the longer side FRAME_SIDE at most. Needs OpenCV on the workers, which this environment lacks, so it is not exercised by the tests."""

    def __init__(self, side: int = FRAME_SIDE):
        import cv2

        self.library, self.side = cv2, side

    @contextmanager
    def _opened(self, content: bytes) -> Iterator[Any]:
        with tempfile.NamedTemporaryFile(suffix=".video") as f:
            f.write(content)
            f.flush()
            video = self.library.VideoCapture(f.name)
            try:
                if not video.isOpened():
                    raise ValueError("cannot open the video")
                yield video
            finally:
                video.release()

    def frames(self, content: bytes, positions: list[int]) -> Iterator[bytes]:
        cv = self.library
        with self._opened(content) as video:
            for p in positions:
                video.set(cv.CAP_PROP_POS_FRAMES, p)
                fine, image = video.read()
                if not fine:
                    raise ValueError(f"cannot read frame {p}")
                high, wide = image.shape[:2]
                ratio = min(1.0, self.side / max(high, wide))
                if ratio < 1:
                    image = cv.resize(image, (int(wide * ratio), int(high * ratio)), interpolation=cv.INTER_AREA)
                fine, data = cv.imencode(".jpg", image)
                if not fine:
                    raise ValueError(f"cannot encode frame {p}")
                yield data.tobytes()

    def info(self, content: bytes) -> dict[str, Any]:
        cv = self.library
        with self._opened(content) as video:
            n, fps = video.get(cv.CAP_PROP_FRAME_COUNT), video.get(cv.CAP_PROP_FPS)
            return {"frame_count": int(n), "fps": fps, "duration": n / fps if fps > 0 else 0.0, "width": int(video.get(cv.CAP_PROP_FRAME_WIDTH)), "height": int(video.get(cv.CAP_PROP_FRAME_HEIGHT))}


def write_markdown(documents: DataFrame, path: str, name: str = "file_name") -> DataFrame:
    """Write ``<stem>.md`` for each document under ``path``, a folder or address that all workers reach; returns file_name, path and error.

    Documents that share a stem are an error of theirs and not written, so none
    overwrites another. The files appear together, once, when all are written.
    """
    key = F.concat(F.regexp_replace(F.col(name), r"\.[^.]*$", ""), F.lit(".md"))
    names = documents.select(F.col(name).alias("file_name"), key.alias("key"))
    single = names.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    texts = documents.select(key.alias("key"), markdown(F.col("pages")).alias("content"))
    done = write_objects(texts.join(single.where("n = 1"), "key", "left_semi"), path)
    several = F.when(F.col("n") > 1, "several documents of this name")
    return names.join(single, "key").join(done, "key", "left").select("file_name", "path", F.coalesce("error", several).alias("error"))


def delete_object(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder of any store that Spark writes to; False where it was missing or could not be deleted."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
    except Exception:  # noqa: BLE001  a failed deletion is no error
        return False


class AudioExtractor(Protocol):
    """Takes the audio track out of a video's bytes; raises where there is none."""

    def audio(self, content: bytes) -> bytes: ...


class FfmpegAudio:
    """The audio track as MP3, by the ffmpeg program on the workers, which this environment lacks."""

    def __init__(self, program: str = "ffmpeg"):
        if shutil.which(program) is None:
            raise RuntimeError(f"{program} is not installed")
        self.program = program

    def audio(self, content: bytes) -> bytes:
        with tempfile.NamedTemporaryFile(suffix=".video") as f:
            f.write(content)
            f.flush()
            made = subprocess.run([self.program, "-v", "error", "-i", f.name, "-vn", "-f", "mp3", "pipe:1"], capture_output=True)
        if made.returncode or not made.stdout:
            raise ValueError(made.stderr.decode("utf-8", "replace").strip()[-300:] or "no audio track")
        return made.stdout


def extract_audio(videos: DataFrame, factory: Callable[[], AudioExtractor], *, key: str, path: str = "path", content: str = "content") -> DataFrame:
    """The key with ``audio`` and ``audio_error``: of another format, without a track, or undecodable."""
    kind = dict(videos.dtypes)[key]
    fits = extension(F.col(path)).isin(*AUDIO_SOURCE_FORMATS)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = factory()
        for part in parts:
            out = []
            for k, raw, ok in zip(part[key], part[content], part["_fits"], strict=True):
                try:
                    if not ok:
                        raise ValueError("unsupported video format")
                    if raw is None:
                        raise ValueError("no content")
                    out.append((k, made.audio(bytes(raw)), None))
                except Exception as e:  # noqa: BLE001  the row carries it
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "audio", "audio_error"])

    return videos.select(key, content, fits.alias("_fits")).mapInPandas(run, f"`{key}` {kind}, audio binary, audio_error string")


def write_json(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def file_extension_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(extension(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).alias("files"))
