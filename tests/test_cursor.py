import base64

import pytest

from tidemark.plans.cursor import PageToken, TokenError, decode, encode

#: A token written out by its wire format: fields 1 {1, 2}, 2 {1, 2} and 3, each with its length before it.
WRITTEN = b"\x0a\x0b\x0a\x04shop\x12\x03b-7" + b"\x12\x08\x08\x80\x8a\xbb\xa5\x07\x10\x64" + b"\x1a\x02zz"


def test_a_token_written_by_hand():
    token = PageToken("shop", "b-7", (0x80 & 127 | (0x8A & 127) << 7 | (0xBB & 127) << 14 | (0xA5 & 127) << 21 | 7 << 28) * 1_000_000, "zz")
    assert decode(base64.b64encode(WRITTEN).decode()) == token  # 100 nanoseconds are less than a microsecond
    assert base64.b64decode(encode(token)) == WRITTEN.replace(b"\x12\x08\x08", b"\x12\x06\x08").replace(b"\x10\x64", b"")


@pytest.mark.parametrize("token", [PageToken("t", "e", 1, "i", 7), PageToken("", "", 0, "", 0), PageToken("Ж", "x" * 300, -1, "i", 2**62), PageToken("a", "b", -62_135_596_800_000_000, "c")])
def test_round_trip(token):
    assert decode(encode(token)) == token


@pytest.mark.parametrize("text", ["?", "CgsKBHNo", "/////w==", "DQAAAAA="])
def test_not_a_token(text):
    with pytest.raises(TokenError):
        decode(text)
