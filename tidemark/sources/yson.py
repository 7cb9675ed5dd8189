"""Text YSON, the format of dumps that are list fragments with one record a line, as JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The lexical forms of the format.
_TOKEN = re.compile(
    r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*")|(?P<flag>%true|%false)|(?P<special>%nan|%-?inf)|(?P<float>[-+]?(?:\d+\.\d*|\.?\d+[eE][-+]?\d+|\d+\.\d*[eE][-+]?\d+))
    |(?P<int>[-+]?\d+)(?P<unsigned>u?)|(?P<null>\#)|(?P<word>[A-Za-z_][\w.\-]*)|(?P<mark>[{}\[\]<>;=]))""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(rb"\\(?:x([0-9a-fA-F]{1,2})|([0-7]{1,3})|(.))", re.DOTALL)
_LETTERS = {b"n": b"\n", b"t": b"\t", b"r": b"\r", b"a": b"\a", b"b": b"\b", b"f": b"\f", b"v": b"\v"}


class YsonError(ValueError):
    """Not text YSON."""


def _unescaped(literal: str) -> str:
    """The text of a quoted literal, whose escapes stand for bytes of UTF-8."""

    def byte(found: re.Match[bytes]) -> bytes:
        hexa, octal, letter = found.groups()
        if letter is not None:
            return _LETTERS.get(letter, letter)
        return bytes([int(hexa, 16) if hexa else int(octal, 8) & 255])

    return _ESCAPE.sub(byte, literal[1:-1].encode()).decode("utf-8", "replace")


class _Reader:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise YsonError(f"cannot read {text[at : at + 20]!r}")
            kind = next(k for k, v in found.groupdict().items() if v is not None)
            self.tokens.append((kind, found[kind]))
            at = found.end()
        self.tokens.reverse()

    def next(self) -> tuple[str, str]:
        if not self.tokens:
            raise YsonError("the record is cut off")
        return self.tokens.pop()

    def sees(self, mark: str) -> bool:
        return bool(self.tokens) and self.tokens[-1] == ("mark", mark)

    def value(self) -> Any:
        kind, text = self.next()
        match kind, text:
            case "mark", "<":  # attributes say nothing about the value itself
                self.pairs(">")
                return self.value()
            case "mark", "{":
                return self.pairs("}")
            case "mark", "[":
                return self.items("]")
            case "text", _:
                return _unescaped(text)
            case "word", _:
                return text
            case "int", _:
                return int(text)
            case "float", _:
                return float(text)
            case "flag", _:
                return text == "%true"
            case ("null" | "special"), _:
                return None
        raise YsonError(f"unexpected {text!r}")

    def items(self, end: str) -> list[Any]:
        found = []
        while not self.sees(end):
            found.append(self.value())
            if not self.sees(end) and self.next() != ("mark", ";"):
                raise YsonError("expected ;")
        self.next()
        return found

    def pairs(self, end: str) -> dict[str, Any]:
        found = {}
        while not self.sees(end):
            kind, name = self.next()
            if kind not in ("text", "word") or self.next() != ("mark", "="):
                raise YsonError("expected a name and =")
            found[_unescaped(name) if kind == "text" else name] = self.value()
            if not self.sees(end) and self.next() != ("mark", ";"):
                raise YsonError("expected ;")
        self.next()
        return found


def parse_record(line: str) -> Any:
    """The value of one record of a list fragment, whose closing ``;`` may be missing; None for a blank line."""
    if not line.strip():
        return None
    reader = _Reader(line)
    found = reader.value()
    if reader.sees(";"):
        reader.next()
    if reader.tokens:
        raise YsonError(f"unexpected {reader.tokens[-1][1]!r} after the record")
    return found


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """``value``, each record as JSON. A line that is no whole record fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = [parse_record(line or "") for line in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(r) for r in records if r is not None], pa.string())], names=["value"])

    return spark.read.text(path).mapInArrow(run, "value string")
