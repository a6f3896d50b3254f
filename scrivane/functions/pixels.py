"""Pixel work on numpy arrays: PNG in and out, flattening, resampling. Arrays are rows, columns, channels of unsigned bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Channels by a PNG's colour type.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PNG_START = b"\x89PNG\r\n\x1a\n"


def media_type_of(data: bytes) -> str:
    """The media type that the first bytes of an encoded image tell; JPEG where they tell none."""
    if data[:8] == PNG_START:
        return "image/png"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    return "image/gif" if data[:4] == b"GIF8" else "image/jpeg"


def encode_png(pixels: np.ndarray, level: int = 6) -> bytes:
    """PNG of one to four channels, rows unfiltered."""
    high, wide, channels = pixels.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    rows = np.zeros((high, 1 + wide * channels), np.uint8)
    rows[:, 1:] = pixels.reshape(high, -1)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return PNG_START + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Undo a PNG's row filters; ``step``: bytes of a pixel."""
    out = np.zeros((len(rows), rows.shape[1] - 1), np.uint8)
    above = np.zeros(rows.shape[1] - 1, np.uint8)
    for y, row in enumerate(rows):
        how, line = row[0], row[1:]
        if how in (0, 2):
            out[y] = line + above if how else line
        elif how == 1:
            out[y] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
        elif how in (3, 4):
            made, raw, up = bytearray(len(line)), line.tolist(), above.tolist()
            for x, v in enumerate(raw):
                a, b, c = (made[x - step], up[x], up[x - step]) if x >= step else (0, up[x], 0)
                if how == 3:
                    near = (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    near = a if pa <= pb and pa <= pc else b if pb <= pc else c
                made[x] = (v + near) & 255
            out[y] = np.frombuffer(bytes(made), np.uint8)
        else:
            raise ValueError(f"PNG row filter {how}")
        above = out[y]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of a PNG of eight bits a channel without interlacing; a palette is resolved, with its transparency."""
    if data[:8] != PNG_START:
        raise ValueError("no PNG")
    at, body, palette, clear, head = 8, [], None, b"", None
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = part
        elif name == b"IDAT":
            body.append(part)
        at += 12 + size
    if head is None or not body:
        raise ValueError("truncated PNG")
    wide, high, depth, kind, _, _, interlaced = head
    if depth != 8 or interlaced:
        raise ValueError("PNG of another depth than 8 bits, or interlaced")
    step = _CHANNELS[kind]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(high, 1 + wide * step)
    pixels = _unfiltered(rows, step).reshape(high, wide, step)
    if kind != 3:
        return pixels
    if palette is None:
        raise ValueError("PNG without its palette")
    colours = palette[pixels[:, :, 0]]
    if not clear:
        return colours
    alpha = np.full(256, 255, np.uint8)
    alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
    return np.concatenate([colours, alpha[pixels]], 2)


def flattened(pixels: np.ndarray) -> np.ndarray:
    """Grey or RGB pixels; transparency is laid on white, which turns grey with transparency into RGB."""
    channels = pixels.shape[2]
    if channels in (1, 3):
        return pixels
    colour, alpha = pixels[:, :, :-1].astype(np.uint32), pixels[:, :, -1:].astype(np.uint32)
    mixed = ((colour * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)
    return mixed if mixed.shape[2] == 3 else np.repeat(mixed, 3, 2)


def fitted_size(wide: int, high: int, side: int) -> tuple[int, int]:
    """Width and height with the longer side at most ``side``, in proportion, fractions dropped, one pixel at least."""
    ratio = min(1.0, side / max(wide, high))
    return max(1, int(wide * ratio)), max(1, int(high * ratio))


def _resampled(pixels: np.ndarray, size: int) -> np.ndarray:
    """The first axis brought to ``size`` by a Lanczos window of three lobes, wider where it shrinks."""
    n = len(pixels)
    scale = max(1.0, n / size)
    centre = (np.arange(size) + 0.5) * n / size
    first = np.floor(centre - 3 * scale).astype(np.int64)
    at = first[:, None] + np.arange(int(np.ceil(6 * scale)) + 1)
    x = (at + 0.5 - centre[:, None]) / scale
    weight = np.where((np.abs(x) < 3) & (at >= 0) & (at < n), np.sinc(x) * np.sinc(x / 3), 0.0)
    weight = (weight / weight.sum(1, keepdims=True)).astype(np.float32)
    out = np.zeros((size, *pixels.shape[1:]), np.float32)
    for k in range(at.shape[1]):
        out += pixels[np.clip(at[:, k], 0, n - 1)] * weight[:, k][:, None, None]
    return out


def resized(pixels: np.ndarray, side: int) -> np.ndarray:
    """Pixels with the longer side at most ``side``; smaller ones as they are."""
    high, wide, _ = pixels.shape
    w, h = fitted_size(wide, high, side)
    if (w, h) == (wide, high):
        return pixels
    across = _resampled(pixels.transpose(1, 0, 2), w).transpose(1, 0, 2)
    return np.clip(np.rint(_resampled(across, h)), 0, 255).astype(np.uint8)
