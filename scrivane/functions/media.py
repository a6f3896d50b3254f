"""Image and video arithmetic: sizes, limits, token estimates, codec names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File formats, without the dot.
IMAGE_FORMATS = ("jpg", "jpeg", "png", "tiff", "tif", "webp", "bmp")
VIDEO_FORMATS = ("mp4", "avi", "mov", "mkv")
AUDIO_SOURCE_FORMATS = ("mp4", "avi", "mov", "mkv", "webm")

#: The longest side of pages, of frames, and of images for a provider.
PAGE_SIDE, FRAME_SIDE, PROVIDER_SIDE = 2000, 768, 1568
#: Images in a request, longest side alone and among others, length of the base64 text.
MOST_IMAGES, SIDE_ALONE, SIDE_IN_BATCH, MOST_BASE64 = 100, 8000, 2000, 5 * 1024 * 1024


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def media_type(path: Column) -> Column:
    """``pdf``, ``image``, ``video``, or null; any case."""
    e = extension(path)
    return F.when(e == "pdf", "pdf").when(e.isin(*IMAGE_FORMATS), "image").when(e.isin(*VIDEO_FORMATS), "video")


def fitted(width: Column, height: Column, side: int) -> Column:
    """Size (struct of width, height) with the longer side at most ``side``, in proportion, fractions dropped."""
    ratio = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(width, height))
    return F.struct((width * ratio).cast("int").alias("width"), (height * ratio).cast("int").alias("height"))


def image_tokens(width: Column, height: Column) -> Column:
    return F.floor(width * height / 750)


def image_error(width: Column, height: Column, images: Column, base64_length: Column) -> Column:
    """Why a request's image is refused, or null."""
    side = F.when(images > 1, F.lit(SIDE_IN_BATCH)).otherwise(F.lit(SIDE_ALONE))
    return F.when(images < 1, "no images").when(images > MOST_IMAGES, "too many images").when((width > side) | (height > side), "dimensions").when(base64_length > MOST_BASE64, "file size")


def base64_length(n_bytes: Column) -> Column:
    return F.ceil(n_bytes / 3) * 4


def codec_name(number: Column) -> Column:
    """Four characters of a codec number, lowest byte first."""
    return F.concat(*(F.char(F.shiftright(number, 8 * i).bitwiseAND(255)) for i in range(4)))


def duration(frames: Column, fps: Column) -> Column:
    """Seconds; 0 where the rate is not positive."""
    return F.when(fps > 0, frames / fps).otherwise(F.lit(0.0))


def video_error(path: Column, opens: Column, frames: Column, fps: Column, most_seconds: float) -> Column:
    """Why a video is refused, or null."""
    return F.when(~extension(path).isin(*VIDEO_FORMATS), "format").when(~F.coalesce(opens, F.lit(False)), "cannot open").when(duration(frames, fps) > most_seconds, "too long")
