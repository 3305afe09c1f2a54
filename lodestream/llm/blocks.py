"""Strings of a content with their places, and replacement inside the raw JSON text."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark import SparkFiles
from pyspark.sql import SparkSession

#: Default place of the public vocabulary; a parameter of every operator that uses it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a file of the driver's machine to all executors, once; tasks open it by ``local_file`` of the same path."""
    sent = spark.sparkContext.__dict__.setdefault("_lodestream_files", set())
    if path not in sent:
        spark.sparkContext.addFile(path)
        sent.add(path)
    return path


def local_file(path: str) -> str:
    """Where a shipped file lies on this machine; the path itself outside of Spark."""
    try:
        there = SparkFiles.get(os.path.basename(path))
    except Exception:  # no Spark in this process
        return path
    return there if os.path.exists(there) else path


def texts(raw: str | None, inputs: bool = False) -> Iterator[tuple[str, str, bool]]:
    """(place, text, is_tool_result) of a content: the ``text`` and ``content`` strings at any depth.

    A JSON string has the place ``content``; NULL and unreadable JSON give nothing. Tool inputs are skipped unless asked for.
    """
    try:
        doc = json.loads(raw)
    except (ValueError, TypeError, RecursionError):
        return
    if isinstance(doc, str):
        yield "content", doc, False
        return
    stack = [("", doc, False)]
    while stack:
        path, value, tool = stack.pop()
        if isinstance(value, dict):
            tool = tool or value.get("type") == "tool_result"
            for k in ("text", "content"):
                if isinstance(value.get(k), str):
                    yield path, value[k], tool
            children = [(f"{path}.{k}" if path else k, v, tool) for k, v in value.items() if isinstance(v, (dict, list)) and (inputs or not (k == "input" and value.get("type") == "tool_use"))]
        else:
            children = [(f"{path}.{i}" if path else str(i), v, tool) for i, v in enumerate(value) if isinstance(v, (dict, list))] if isinstance(value, list) else []
        stack.extend(reversed(children))


_LITERAL = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_UNIT = re.compile(r"\\u[0-9a-fA-F]{4}|\\.|.", re.DOTALL)


def replace_spans(raw: str, found: dict[str, list[tuple[int, int, str]]]) -> str:
    """Replace spans (start, end, placeholder) of whole texts at their places in the raw JSON.

    A string literal counts if it decodes to one of the texts; positions are carried over its escapes, so that every character
    outside the spans, in any spelling, stays. The same words elsewhere in the JSON are not touched.
    """
    out, at = [], 0
    for m in _LITERAL.finditer(raw):
        try:
            text = json.loads(m[0], strict=False)
        except ValueError:
            continue
        if not (spans := found.get(text)):
            continue
        places, place, inner = [], m.start() + 1, m[0][1:-1]
        if "\\" in inner:
            half = False  # the second unit of a surrogate pair belongs to the character before
            for u in _UNIT.finditer(inner):
                low = len(u[0]) == 6 and u[0][2:4].lower() in ("dc", "dd", "de", "df")
                if not (half and low):
                    places.append(place + u.start())
                half = len(u[0]) == 6 and u[0][2:4].lower() in ("d8", "d9", "da", "db")
            places.append(m.end() - 1)
        for s, e, label in sorted(spans):
            a, b = (places[s], places[e]) if places else (place + s, place + e)
            out += [raw[at:a], label]
            at = b
    return "".join(out) + raw[at:]


_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def unescaped(raw: str) -> tuple[str, list[int]]:
    """A content that is no readable JSON as one text with its escapes resolved, and the place of each character in it, with the end's."""
    out, places = [], []
    for m in re.finditer(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|.", raw, re.DOTALL):
        u = m[0]
        if len(u) == 12:
            out.append(chr(0x10000 + (int(u[2:6], 16) - 0xD800) * 0x400 + int(u[8:], 16) - 0xDC00))
        elif len(u) == 6:
            out.append(chr(int(u[2:], 16)))
        else:
            out.append(_ESCAPED.get(u[1], u[1]) if len(u) == 2 else u)
        places.append(m.start())
    return "".join(out), [*places, len(raw)]


def readable(raw: str) -> bool:
    try:
        json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return True
