"""Structured text as plain values: decoding, JSON, JSON lines, and bounded subsets of YAML, TOML and XML."""

from __future__ import annotations

import json
import math
import re

from rangeview.model import PreviewError

# Keys that no document may use, and the entities that XML text may name.
UNSAFE_KEYS = ("__proto__", "prototype", "constructor")
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}

_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_NAME = re.compile(r"[A-Za-z_][\w:.-]*", re.ASCII)
_ATTRIBUTE = re.compile(r"""\s+([A-Za-z_][\w:.-]*)\s*=\s*("[^"]*"|'[^']*')""", re.ASCII)


def _bad(message: str, line: int | None = None) -> PreviewError:
    return PreviewError("PARSE_FAILED", message if line is None else f"{message} on line {line}", line=line)


def decode_text(data: bytes) -> tuple[str, str]:
    """(text, encoding): UTF-16 by its mark, else strict UTF-8 with or without one."""
    for mark, name in ((b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if data.startswith(mark):
            return data[2:].decode(name, "replace"), name
    try:
        return data.removeprefix(b"\xef\xbb\xbf").decode("utf-8"), "utf-8"
    except UnicodeDecodeError as e:
        raise _bad("the text is neither UTF-8 nor marked UTF-16") from e


def _outside_quotes(text: str):
    """(place, character) of what no pair of quotes encloses; the quotes themselves are not given."""
    open_ = ""
    for i, c in enumerate(text):
        if c in "\"'" and text[i - 1 : i] != "\\":
            open_ = "" if open_ == c else open_ or c
        elif not open_:
            yield i, c


def _without_comment(text: str) -> str:
    at = next((i for i, c in _outside_quotes(text) if c == "#" and (i == 0 or text[i - 1].isspace())), len(text))
    return text[:at]


def _key(text: str) -> str:
    key = text.strip()
    if len(key) >= 2 and key[0] == key[-1] and key[0] in "\"'" and key[0] not in key[1:-1]:
        key = key[1:-1]
    if not key or key in UNSAFE_KEYS:
        raise _bad("a key is empty or not allowed")
    return key


def _pair(text: str, sign: str) -> tuple[str, str] | None:
    at = next((i for i, c in _outside_quotes(text) if c == sign), 0)
    return (_key(text[:at]), text[at + 1 :].strip()) if at > 0 else None


def scalar(text: str):
    """The value of a plain scalar: null, boolean, number, quoted text, inline list, else the text itself."""
    text = text.strip()
    if text in ("null", "~"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if _NUMBER.fullmatch(text) and math.isfinite(value := float(text)):
        return int(value) if value.is_integer() and abs(value) < 2**53 else value
    if text and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        inner = text[1:-1]
        cuts = [-1, *(i for i, c in _outside_quotes(inner) if c == ","), len(inner)]
        return [scalar(inner[a + 1 : b]) for a, b in zip(cuts, cuts[1:]) if inner[a + 1 : b].strip()]
    return text


def parse_yaml(text: str):
    """Block mappings and sequences of scalars; no tags, anchors, aliases, merge keys, tabs or repeated keys."""
    if re.search(r"^(?:---\s*)?\s*[!&*]", text, re.M) or re.search(r"<<\s*:", text):
        raise _bad("YAML tags, anchors, aliases and merge keys are not read")
    rows = []
    for number, raw in enumerate(re.split(r"\r?\n", text), 1):
        body = raw.lstrip()
        if not body or body.startswith("#"):
            continue
        if "\t" in raw[: len(raw) - len(body)]:
            raise _bad("a tab indents YAML", number)
        rows.append((len(raw) - len(body), _without_comment(raw.strip()).rstrip(), number))
    if not rows:
        return None

    def below(k: int, indent: int):
        """The empty container of a key without a value, told by the row after it."""
        return [] if k + 1 < len(rows) and rows[k + 1][0] > indent and rows[k + 1][1].startswith("- ") else {}

    root = [] if rows[0][1].startswith("- ") else {}
    holders = [(-1, root)]
    for k, (indent, body, number) in enumerate(rows):
        while len(holders) > 1 and holders[-1][0] >= indent:
            holders.pop()
        into = holders[-1][1]
        item = body.startswith("- ")
        if item != isinstance(into, list):
            raise _bad("a YAML sequence item is out of place" if item else "a YAML sequence item is missing", number)
        pair = _pair(body[2:].strip() if item else body, ":")
        if pair is None:
            if not item:
                raise _bad("a YAML key is missing", number)
            into.append(scalar(body[2:]))
            continue
        value = below(k, indent) if pair[1] == "" else scalar(pair[1])
        if item:
            into.append({pair[0]: value})
            holders.append((indent, into[-1]))
            continue
        if pair[0] in into:
            raise _bad(f"the YAML key '{pair[0]}' is repeated", number)
        into[pair[0]] = value
        if isinstance(value, (list, dict)):
            holders.append((indent, value))
    return root


def parse_toml(text: str) -> dict:
    """Tables by dotted headings and scalar assignments; no arrays of tables, no repeated keys."""
    root: dict = {}
    table = root
    for number, raw in enumerate(re.split(r"\r?\n", text), 1):
        line = _without_comment(raw).strip()
        if not line:
            continue
        heading = re.fullmatch(r"\[([^\[\]]+)\]", line)
        if heading:
            table = root
            for part in heading[1].split("."):
                table = table.setdefault(_key(part), {})
                if not isinstance(table, dict):
                    raise _bad("a TOML table has the name of a value", number)
            continue
        if line.startswith("[["):
            raise _bad("TOML arrays of tables are not read", number)
        pair = _pair(line, "=")
        if pair is None:
            raise _bad("a TOML line is no assignment", number)
        if pair[0] in table:
            raise _bad(f"the TOML key '{pair[0]}' is repeated", number)
        table[pair[0]] = scalar(pair[1])
    return root


def decode_entities(text: str) -> str:
    """The five named entities and character numbers; any other name is an error. What decoding gives is not decoded again."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name in ENTITIES:
            return ENTITIES[name]
        if re.fullmatch(r"#[0-9]+|#[xX][0-9a-fA-F]+", name):
            return chr(int(name[2:], 16) if name[1] in "xX" else int(name[1:]))
        raise _bad(f"the XML entity {name} is not known")

    try:
        return re.sub(r"&([^;\s]+);", one, text)
    except (ValueError, OverflowError) as e:
        raise _bad("an XML character number is out of range") from e


def parse_xml(text: str) -> dict:
    """{name, attributes, children} of the one root; children are elements, texts as they stand, and CDATA."""
    if re.search(r"<!DOCTYPE|<!ENTITY", text, re.I):
        raise _bad("XML document types and entities are not read")
    text = text.removeprefix("﻿")
    root, open_, at = None, [], 0
    while at < len(text):
        if text.startswith("<!--", at) or text.startswith("<?", at):
            close = "-->" if text[at + 1] == "!" else "?>"
            end = text.find(close, at)
            if end < 0:
                raise _bad("XML ends inside a comment or instruction")
            at = end + len(close)
        elif text.startswith("<![CDATA[", at):
            end = text.find("]]>", at)
            if end < 0 or not open_:
                raise _bad("XML character data is open or outside the root")
            open_[-1]["children"].append(text[at + 9 : end])
            at = end + 3
        elif text[at] == "<":
            end = text.find(">", at)
            if end < 0:
                raise _bad("XML ends inside a tag")
            tag, at = text[at + 1 : end], end + 1
            if tag.startswith("/"):
                if not open_ or open_.pop()["name"] != tag[1:].strip():
                    raise _bad(f"the XML end tag {tag[1:].strip()} does not match")
                continue
            alone = tag.rstrip().endswith("/")
            body = (tag.rstrip()[:-1] if alone else tag).strip()
            name = _NAME.match(body)
            if not name:
                raise _bad("an XML element has no valid name")
            rest = body[name.end() :]
            if _ATTRIBUTE.sub("", rest).strip():
                raise _bad("an XML attribute is malformed")
            element = {"name": name[0], "attributes": {k: decode_entities(v[1:-1]) for k, v in _ATTRIBUTE.findall(rest)}, "children": []}
            if open_:
                open_[-1]["children"].append(element)
            elif root is not None:
                raise _bad("XML has several roots")
            else:
                root = element
            if not alone:
                open_.append(element)
        else:
            end = text.find("<", at)
            end = len(text) if end < 0 else end
            if text[at:end].strip():
                if not open_:
                    raise _bad("XML text is outside the root")
                open_[-1]["children"].append(text[at:end])
            at = end
    if root is None or open_:
        raise _bad("XML has no root or ends too early")
    return root


def _json(text: str, line: int | None = None):
    def no_constant(name):
        raise ValueError(name)

    try:
        return json.loads(text, parse_constant=no_constant)
    except (ValueError, RecursionError) as e:
        raise _bad("the JSON is malformed or nested too deeply", line) from e


def parse_structured(format: str, text: str):
    """The value of a json, jsonl, yaml, toml or xml text; faults are PARSE_FAILED, other formats UNSUPPORTED_FEATURE."""
    if format == "json":
        return _json(text)
    if format == "jsonl":
        return [_json(line, k) for k, line in enumerate((x for x in re.split(r"\r?\n", text) if x.strip()), 1)]
    parser = {"yaml": parse_yaml, "toml": parse_toml, "xml": parse_xml}.get(format)
    if parser is None:
        raise PreviewError("UNSUPPORTED_FEATURE", f"{format} is no structured format")
    return parser(text)
