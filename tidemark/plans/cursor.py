"""Page tokens: the first key of the next page, as base64 of a small protobuf message.

Fields: 1 resource {1 type code, 2 external id}, 2 start {1 seconds, 2 nanos},
3 id, and 15 the snapshot that the listing reads, so that later pages see the
same one. Tokens without field 15 are accepted.
"""

from __future__ import annotations

import base64
import binascii
from dataclasses import dataclass

RESOURCE, START, ID, AS_OF = 1, 2, 3, 15
VARINT, BYTES = 0, 2
MICRO = 1_000_000


class TokenError(ValueError):
    """Not a page token."""


@dataclass(frozen=True)
class PageToken:
    type_code: str
    external_id: str
    start_us: int
    id: str
    as_of: int | None = None


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | str) -> bytes:
    """One field; zero and empty values are left out, as the wire format's defaults."""
    if isinstance(value, int):
        return _varint(number << 3 | VARINT) + _varint(value) if value else b""
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | BYTES) + _varint(len(raw)) + raw if raw else b""


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = raw[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return n, at


def _fields(raw: bytes) -> dict[int, int | bytes]:
    found: dict[int, int | bytes] = {}
    at = 0
    while at < len(raw):
        head, at = _read_varint(raw, at)
        value, at = _read_varint(raw, at)
        if head & 7 == BYTES:
            if at + value > len(raw):
                raise IndexError
            value, at = raw[at : at + value], at + value
        elif head & 7 != VARINT:
            raise TokenError("unexpected wire type")
        found[head >> 3] = value
    return found


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def encode(token: PageToken) -> str:
    resource = _field(1, token.type_code) + _field(2, token.external_id)
    start = _field(1, token.start_us // MICRO) + _field(2, token.start_us % MICRO * 1000)
    as_of = _field(AS_OF, token.as_of + 1) if token.as_of is not None else b""  # 0 is a snapshot, absence is none
    # a message that is set but empty is written, unlike an empty string
    parts = [_varint(n << 3 | BYTES) + _varint(len(m)) + m for n, m in ((RESOURCE, resource), (START, start))]
    return base64.b64encode(b"".join(parts) + _field(ID, token.id) + as_of).decode()


def decode(text: str) -> PageToken:
    try:
        top = _fields(base64.b64decode(text, validate=True))
        resource, start = _fields(top.get(RESOURCE, b"")), _fields(top.get(START, b""))
        micros = _signed(start.get(1, 0)) * MICRO + start.get(2, 0) // 1000
        as_of = top[AS_OF] - 1 if AS_OF in top else None
        return PageToken(resource.get(1, b"").decode(), resource.get(2, b"").decode(), micros, top.get(ID, b"").decode(), as_of)
    except (binascii.Error, IndexError, UnicodeDecodeError, TypeError, AttributeError) as broken:
        raise TokenError(f"not a page token: {text!r}") from broken
