"""Sizes of images from their headers; nothing is decoded."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from rangeview.model import PreviewError

MAX_PIXELS = 100_000_000
# Media types that are not image/ and the format's name, and the JPEG markers that carry a size.
MEDIA = {"svg": "image/svg+xml"}
SIZE_MARKERS = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
#: What an SVG may not hold.
_UNSAFE = re.compile(r"""<script\b|\bon\w+\s*=|\b(?:href|src)\s*=\s*["']\s*(?:https?:|//|data:text/html)|<!DOCTYPE|<!ENTITY""", re.I)


@dataclass(frozen=True)
class ImageInfo:
    media_type: str
    width: float | None = None
    height: float | None = None
    frames: int | None = None


def _jpeg(data: bytes):
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        if data[at + 1] in SIZE_MARKERS:
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        size = struct.unpack_from(">H", data, at + 2)[0]
        if size < 2:
            break
        at += 2 + size
    return None, None


def _webp(data: bytes):
    if data[12:16] == b"VP8X" and len(data) >= 30:
        return tuple(1 + int.from_bytes(data[k : k + 3], "little") for k in (24, 27))
    if data[12:16] == b"VP8L" and len(data) >= 25:
        bits = int.from_bytes(data[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    return None, None


def _svg(data: bytes):
    text = data.decode("utf-8", "replace")
    if _UNSAFE.search(text):
        raise PreviewError("PARSE_FAILED", "an SVG with scripts, handlers, outside resources or entities is not shown")
    root = re.search(r"<svg\b([^>]*)>", text, re.I)
    if not root:
        raise PreviewError("PARSE_FAILED", "the SVG has no root element")

    def size(name):
        m = re.search(rf"""\b{name}\s*=\s*["']([0-9]+(?:\.[0-9]+)?)(?:px)?["']""", root[1], re.I)
        return float(m[1]) if m and float(m[1]) > 0 else None

    return size("width"), size("height")


def inspect(format: str, data: bytes, max_pixels: int = MAX_PIXELS) -> ImageInfo:
    """Width, height, frames and media type as far as the header tells them; too many pixels are RESOURCE_LIMIT."""
    width = height = frames = None
    if format == "png" and len(data) >= 24:
        width, height = struct.unpack_from(">II", data, 16)
    elif format == "gif" and len(data) >= 10:
        width, height = struct.unpack_from("<HH", data, 6)
        frames = data.count(0x2C)
    elif format == "bmp" and len(data) >= 26:
        width, height = (abs(v) for v in struct.unpack_from("<ii", data, 18))
    elif format in ("jpeg", "webp", "svg"):
        width, height = {"jpeg": _jpeg, "webp": _webp, "svg": _svg}[format](data)
    if width is not None and height is not None and width * height > max_pixels:
        raise PreviewError("RESOURCE_LIMIT", f"an image has at most {max_pixels} pixels")
    return ImageInfo(MEDIA.get(format, f"image/{format}"), width, height, frames)


def inspect_all(files: DataFrame) -> DataFrame:
    """(path, media_type, width, height, frames, error) of files read as ``binaryFile``; a fault is a row with its code."""
    from rangeview.sources.sniff import sniff_preview

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for path, data in zip(p["path"], p["content"]):
                try:
                    i = inspect(sniff_preview(bytes(data[:4096]), path) or "unknown", bytes(data))
                    rows.append((path, i.media_type, i.width, i.height, i.frames, None))
                except PreviewError as e:
                    rows.append((path, None, None, None, None, e.code))
            yield pd.DataFrame(rows, columns=["path", "media_type", "width", "height", "frames", "error"]).astype({"width": "float64", "height": "float64", "frames": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, media_type string, width double, height double, frames long, error string")
