"""Image files as rows: decoded, flattened on white, fitted to a longest side and encoded for a model."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.functions import pixels as P
from scrivane.functions.media import MOST_BASE64, MOST_IMAGES, PAGE_SIDE, PROVIDER_SIDE, SIDE_ALONE, SIDE_IN_BATCH
from scrivane.operators.model import Answer, Model, Request
from scrivane.sources.content import Loader, Reader, fetch, with_content
from scrivane.sources.page_store import PageStore

#: Fixed value: quality of encoded JPEG.
QUALITY = 95


class ImageCodec(Protocol):
    """Decodes an image file to rows, columns, channels (grey, RGB, either with transparency), and encodes grey or RGB."""

    def decode(self, content: bytes) -> np.ndarray: ...

    def encode(self, pixels: np.ndarray) -> bytes: ...


class PngCodec:
    """PNG without any library; encodes PNG."""

    def decode(self, content: bytes) -> np.ndarray:
        return P.decode_png(content)

    def encode(self, pixels: np.ndarray) -> bytes:
        return P.encode_png(pixels)


class PillowCodec:
    """All formats that an imaging library on the workers reads; encodes JPEG. This environment lacks the library, so the tests run it against a stand-in."""

    def __init__(self, quality: int = QUALITY):
        from PIL import Image

        self.library, self.quality = Image, quality

    def decode(self, content: bytes) -> np.ndarray:
        with self.library.open(io.BytesIO(content)) as image:
            kept = image if image.mode in ("L", "LA", "RGB", "RGBA") else image.convert("RGB")
            made = np.asarray(kept, np.uint8)
        return made if made.ndim == 3 else made[:, :, None]

    def encode(self, pixels: np.ndarray) -> bytes:
        out = io.BytesIO()
        self.library.fromarray(pixels if pixels.shape[2] == 3 else pixels[:, :, 0]).save(out, format="JPEG", quality=self.quality)
        return out.getvalue()


PREPARED = "page_number int, text string, image binary, media_type string, width int, height int, error string"
_NAMES = [c.split()[0] for c in PREPARED.split(", ")]


def image_loader(codec: Callable[[], ImageCodec] = PngCodec, *, side: int = PAGE_SIDE, reader: Reader = fetch) -> Callable[[], Loader]:
    """For map_model: a path to its image, laid on white, fitted to ``side`` and encoded."""

    def make() -> Loader:
        made = codec()
        return Loader(lambda content: [made.encode(P.resized(P.flattened(made.decode(content)), side))], reader)

    return make


def refused(width: int, height: int, images: int, size: int) -> str | None:
    """media.image_error for one image of a request: its sides, the request's images, and its encoded bytes."""
    most = SIDE_IN_BATCH if images > 1 else SIDE_ALONE
    if images > MOST_IMAGES:
        return "too many images"
    if max(width, height) > most:
        return "dimensions"
    return "file size" if 4 * -(-size // 3) > MOST_BASE64 else None


def within_limits(images: list[bytes], codec: ImageCodec) -> list[bytes]:
    """A request's images as a hosted model takes them: the longer side PROVIDER_SIDE at most; a ValueError for one beyond the limits.

    Sides are checked as they come, the encoded size as it is sent. An image that
    needs no change stays as it is.
    """
    out = []
    for raw in images:
        pixels = codec.decode(raw)
        high, wide, _ = pixels.shape
        why = refused(wide, high, len(images), 0)
        if why is None:
            sent = raw if max(wide, high) <= PROVIDER_SIDE else codec.encode(P.resized(P.flattened(pixels), PROVIDER_SIDE))
            why = refused(0, 0, len(images), len(sent))
            out.append(sent)
        if why is not None:
            raise ValueError(f"image refused: {why}")
    return out


class Limited:
    """A model whose requests' images are fitted and checked before the call; a refused image is the row's error and costs no call."""

    def __init__(self, model: Model, codec: ImageCodec):
        self.model, self.codec, self.name = model, codec, model.name

    def call(self, request: Request) -> Answer:
        return self.model.call(replace(request, images=within_limits(request.images, self.codec)))


def limited(factory: Callable[[], Model], codec: Callable[[], ImageCodec] = PngCodec) -> Callable[[], Model]:
    """``factory`` for map_model with the limits of hosted models kept."""
    return lambda: Limited(factory(), codec())


def _prepared(decode: Callable[[], np.ndarray], encode: Callable[[np.ndarray], bytes], side: int) -> tuple:
    try:
        made = P.resized(P.flattened(decode()), side)
        data = encode(made)
        return 1, "", data, P.media_type_of(data), made.shape[1], made.shape[0], None
    except Exception as e:  # noqa: BLE001  the row carries it
        return 1, "", None, None, None, None, f"{type(e).__name__}: {e}"


def prepare_images(files: DataFrame, codec: Callable[[], ImageCodec] = PngCodec, *, side: int = PAGE_SIDE) -> DataFrame:
    """path and file_hash of each image file with PREPARED's columns; a file that cannot be decoded has an error and no image.

    Transparency is laid on white and the longer side is ``side`` at most.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = codec()
        for part in parts:
            rows = [(p, h, *_prepared(lambda c=c: made.decode(bytes(c)), made.encode, side)) for p, h, c in zip(part["path"], part["file_hash"], part["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "file_hash", *_NAMES]).astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "file_hash", "content").mapInPandas(run, "path string, file_hash string, " + PREPARED)


def scan_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Image files of a folder decoded by Spark itself: path, width, height, channels and data (rows of BGR, BGRA or grey); width -1 where it cannot."""
    found = spark.read.format("image").option("dropInvalid", "false").load(path)
    return found.select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def prepare_pixels(scanned: DataFrame, encode: Callable[[], ImageCodec] = PngCodec, *, side: int = PAGE_SIDE) -> DataFrame:
    """The result of scan_pixels as prepare_images gives it, without a file hash."""

    def pixels(width: int, height: int, channels: int, data: bytes) -> np.ndarray:
        if width < 0:
            raise ValueError("not an image that Spark decodes")
        p = np.frombuffer(bytes(data), np.uint8).reshape(height, width, channels)
        return p if channels == 1 else p[:, :, [2, 1, 0, 3][:channels]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = encode()
        for part in parts:
            rows = [(p, *_prepared(lambda x=x: pixels(*x), made.encode, side)) for p, *x in part.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["path", *_NAMES]).astype({"width": "Int32", "height": "Int32"})

    return scanned.select("path", "width", "height", "channels", "data").mapInPandas(run, "path string, " + PREPARED)


def page_images(spark: SparkSession, pages: DataFrame, base: str, raster: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``pages`` (file_hash, page_hash, ...) with their ``image``, read through the store at ``base`` (see PageStore.with_paths, which gives paths only)."""
    read = with_content(PageStore(spark, base).with_paths(pages, raster), path="image_path")
    return read.select(*pages.columns, F.col("content").alias("image"))
