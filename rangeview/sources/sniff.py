"""Formats by content and name."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes of formats, as hexadecimal text.
TABLE_SIGNATURES = {"pdf": "255044462D", "parquet": "50415231", "arrow": "4152524F5731", "xls": "D0CF11E0A1B11AE1", "zip": "504B"}
IMAGE_SIGNATURES = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "bmp": "424D"}
# The format that a name's extension tells.
TABLE_EXTENSIONS = {"csv": "csv", "tsv": "tsv", "arrow": "arrow", "arrows": "arrow", "ipc": "arrow", "feather": "arrow", "parquet": "parquet", "xls": "xls", "xlsx": "xlsx"}
EXTENSIONS = {
    "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "yaml": "yaml", "yml": "yaml", "xml": "xml", "toml": "toml",
    "txt": "text", "md": "markdown", "markdown": "markdown", "log": "log", "ini": "ini", "env": "env", "conf": "text", "cfg": "text", "properties": "properties",
    **dict.fromkeys("js mjs cjs jsx ts tsx css html htm py rb rs go java c h cpp hpp cs sh ps1 sql".split(), "code"),
    "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "webp": "webp", "svg": "svg", "bmp": "bmp", "tif": "tiff", "tiff": "tiff", "heic": "heic", "heif": "heic", "pdf": "pdf",
}
STRUCTURED = ("json", "jsonl", "yaml", "xml", "toml")
TEXTUAL = (*STRUCTURED, "text", "markdown", "log", "ini", "env", "properties", "code")
IMAGES = ("png", "jpeg", "gif", "webp", "svg", "bmp", "tiff", "heic")
#: Patterns that tell SVG and XML, for Python and for Java alike.
_SVG = r"^(?:<svg|(?i:<\?xml[^>]*>\s*<svg\b))"
_XML = r"^(?:<\?xml|<[A-Za-z_][A-Za-z0-9_:.\-]*[\s>/])"


def _extension(name: str | None) -> str:
    clean = re.split(r"[?#]", name or "", maxsplit=1)[0]
    return clean.rsplit(".", 1)[1].lower() if "." in clean else ""


def binary_like(head: bytes) -> bool:
    """Whether 2 % of the bytes or more are control bytes other than tab to carriage return; never with a Unicode mark."""
    if not head or head.startswith((b"\xff\xfe", b"\xfe\xff", b"\xef\xbb\xbf")):
        return False
    return sum(b < 9 or 13 < b < 32 for b in head) >= 0.02 * len(head)


def sniff_table(head: bytes, tail: bytes = b"", name: str | None = None) -> str:
    """The table format of a source by its first 512 and last 6 bytes and its name; csv if nothing tells another."""
    for kind, sign in TABLE_SIGNATURES.items():
        if head.startswith(bytes.fromhex(sign)):
            # the containers of spreadsheets hold other documents too; their reader tells
            return {"zip": "xlsx"}.get(kind, kind)
    if tail.endswith(b"ARROW1"):
        return "arrow"
    if binary_like(head[:512]):
        return "unknown-binary"
    return TABLE_EXTENSIONS.get(_extension(name), "csv")


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def sniff_preview(head: bytes, name: str | None = None) -> str | None:
    """The preview format of leading bytes and a name: signatures, markup, the name's structured format, JSON, the name's
    text format, then text if few bytes are control bytes; None if nothing fits."""
    if head.startswith(b"%PDF-"):
        return "pdf"
    for kind, sign in IMAGE_SIGNATURES.items():
        if head.startswith(bytes.fromhex(sign)):
            return kind
    if head[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "webp"
    if head[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    if head[4:8] == b"ftyp" and re.fullmatch(rb"hei[cf]|mif1|msf1", head[8:12]):
        return "heic"
    hint = EXTENSIONS.get(_extension(name))
    text = head.decode("utf-8", "replace").lstrip("﻿ \t\r\n\v\f")
    if re.match(_SVG, text):
        return "svg"
    if re.match(_XML, text):
        return "svg" if hint == "svg" else "xml"
    if hint in STRUCTURED:
        return hint
    if text.startswith(("{", "[")) or text == "null":
        lines = [x for x in re.split(r"\r?\n", text) if x][:4]
        return "jsonl" if len(lines) > 1 and all(map(_is_json, lines)) else "json"
    if hint in TEXTUAL:
        return hint
    if not binary_like(head):
        return "text"
    return hint if hint in IMAGES else None


def sniff_text(text: Column) -> Column:
    """svg, xml, jsonl, json or text: the rules of sniff_preview for a text without a name, in built-in functions."""
    t = F.regexp_replace(text, r"^[\x{FEFF}\s]+", "")
    lines = F.slice(F.filter(F.split(t, "\r?\n"), lambda x: x != ""), 1, 4)
    each = F.forall(lines, lambda x: F.try_parse_json(x).isNotNull())
    is_json = t.startswith("{") | t.startswith("[") | (t == "null")
    return F.when(t.rlike(_SVG), "svg").when(t.rlike(_XML), "xml").when(is_json & (F.size(lines) > 1) & each, "jsonl").when(is_json, "json").otherwise("text")
