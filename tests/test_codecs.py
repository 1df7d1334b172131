import random
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.functions import codecs
from quern.functions.codecs import Malformed


@given(st.binary(max_size=80))
def test_base58_round_trip(data):
    assert codecs.base58_decode(codecs.base58_encode(data)) == data


def test_base58_known_and_invalid():
    assert codecs.base58_encode(b"\0\0hello world") == "11StV1DL6CwTryKyV"
    assert codecs.base58_decode("0OIl") is None


@given(st.integers(0, 2**64 - 1), st.binary(max_size=3))
def test_varint_round_trip(value, tail):
    data = codecs.varint_encode(value)
    assert codecs.varint_decode(data + tail) == (value, len(data))


@pytest.mark.parametrize("data", [b"", b"\x80", b"\xff" * 10, b"\x80" * 9 + b"\x02"])
def test_varint_damaged(data):
    with pytest.raises(Malformed):
        codecs.varint_decode(data)


def test_checksums():
    assert codecs.crc64(b"hello world") == 13388989860809387070
    assert codecs.fnv1a64(b"") == 0xCBF29CE484222325
    assert codecs.checksum_ok(b"x", None)
    assert codecs.checksum_ok(b"x", codecs.fnv1a64(b"x")) and codecs.checksum_ok(b"x", codecs.crc64(b"x"))
    assert not codecs.checksum_ok(b"x", 1)


@pytest.mark.parametrize("text, good", [("YQ==", b"a"), ("YQ", None), ("YQ= =", None), ("YR==", None), ("!!!!", None), ("", b"")])
def test_base64_strict(text, good):
    assert codecs.base64_strict(text) == good


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.binary(max_size=9) | st.text(max_size=5), lambda x: st.lists(x, max_size=4)))
def test_cbor_round_trip(value):
    assert codecs.cbor_decode(codecs.cbor_encode(value))[0] == value


def test_cbor_link_and_damage():
    assert codecs.cbor_decode(codecs.cbor_encode(codecs.Link(b"abc")))[0] == b"abc"
    for bad in (b"", b"\x5f", b"\x44ab", b"\x9a\xff\xff\xff\xff", b"\xd8\x2a\x40"):
        with pytest.raises(Malformed):
            codecs.cbor_decode(bad)


def test_columns(spark):
    df = spark.createDataFrame([(b"abc", "YWJj"), (None, "YQ"), (b"", None)], "b binary, t string")
    rows = df.select(codecs.from_base58(codecs.to_base58("b")).alias("b"), codecs.from_base64(df.t).alias("t"), codecs.crc64_of("b").alias("c")).collect()
    assert [r.b for r in rows] == [b"abc", None, b""]
    assert [r.t for r in rows] == [b"abc", None, None]
    assert rows[1].c is None


def test_side_by_side_base58_equals_one_by_one():
    rng = random.Random(3)
    raw = [None] + [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 2, 7, 31, 32, 33, 64) for _ in range(50)] + [bytes(k) + b"\1" * (32 - k) for k in range(33)] + [b"\xff" * 32] * 3 + [bytes(700)]
    texts = codecs.base58_encode_all(raw)
    assert texts == [None if x is None else codecs.base58_encode(x) for x in raw]
    odd = texts + ["0" + "1" * 43] * 40 + ["é" * 44] * 40 + ["1" * 44] * 40 + ["z" * 44] * 40 + [""]
    assert codecs.base58_decode_all(odd) == [None if x is None else codecs.base58_decode(x) for x in odd]
    assert codecs.base58_decode_all(texts) == raw


def test_checksum_by_distance_equals_byte_by_byte():
    rng = random.Random(4)
    for n in (0, 1, 7, 8, 63, 64, 65, 500, 4095, 4096, 4097, 4159, 4160, 9000):
        data = bytes(rng.randrange(256) for _ in range(n))
        crc = 0xFFFFFFFFFFFFFFFF
        for byte in data:
            crc = codecs._CRC[(crc ^ byte) & 0xFF] ^ crc >> 8
        assert codecs.crc64(data) == crc ^ 0xFFFFFFFFFFFFFFFF
