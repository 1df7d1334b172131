"""Binary codecs that Spark has no function for, and Arrow functions on columns of them."""

from __future__ import annotations

import base64
import binascii
import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the alphabet of base58 without look-alikes
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_FIVE = np.uint64(58**5)
_VALUE = {c: i for i, c in enumerate(BASE58)}


def base58_encode(data: bytes) -> str:
    number = int.from_bytes(data, "big")
    out = []
    while number:
        # ten digits at a time keep the big-number divisions few
        number, low = divmod(number, 58**10)
        for _ in range(10):
            low, digit = divmod(low, 58)
            out.append(BASE58[digit])
    text = "".join(reversed(out)).lstrip("1")
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + text


def base58_decode(text: str) -> bytes | None:
    """None for a sign outside the alphabet."""
    number = 0
    for c in text:
        if (digit := _VALUE.get(c)) is None:
            return None
        number = number * 58 + digit
    zeros = len(text) - len(text.lstrip("1"))
    return b"\0" * zeros + number.to_bytes((number.bit_length() + 7) // 8, "big")


def base64_strict(text: str) -> bytes | None:
    """Canonical padded base64 only; None for anything else."""
    try:
        data = base64.b64decode(text, validate=True)
    except (binascii.Error, ValueError):
        return None
    return data if base64.b64encode(data).decode() == text else None


def _by_length(values: list, least: int = 32) -> Iterator[tuple[list[int], bool]]:
    """Places of values of one length each; whether there are enough to be worked on side by side."""
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(values):
        if x is not None:
            groups.setdefault(len(x), []).append(i)
    for size, own in groups.items():
        yield own, len(own) >= least and 0 < size <= 512


def base58_encode_all(values: list[bytes | None]) -> list[str | None]:
    """base58 of many: those of one length are divided side by side, five digits at a time."""
    out: list[str | None] = [None] * len(values)
    for own, many in _by_length(values):
        if not many:
            for i in own:
                out[i] = base58_encode(values[i])
            continue
        size = len(values[own[0]])
        raw = np.frombuffer(b"".join(values[i] for i in own), np.uint8).reshape(len(own), size)
        zeros = np.where(raw.any(1), (raw != 0).argmax(1), size).tolist()
        padded = np.zeros((len(own), -(-size // 4) * 4), np.uint8)
        padded[:, padded.shape[1] - size :] = raw
        limbs = [x.astype(np.uint64) for x in padded.view(">u4").T]
        rounds = int(size * 8 / (5 * math.log2(58))) + 1
        digits = np.zeros((len(own), rounds * 5), np.uint8)
        for k in range(rounds - 1, -1, -1):
            rest = np.zeros(len(own), np.uint64)
            for j, limb in enumerate(limbs):
                whole = rest << np.uint64(32) | limb
                limbs[j] = whole // _FIVE
                rest = whole - limbs[j] * _FIVE
            for j in range(4, -1, -1):
                rest, digits[:, 5 * k + j] = rest // np.uint64(58), rest % np.uint64(58)
        text = np.frombuffer(BASE58.encode(), np.uint8)[digits].tobytes().decode()
        width = rounds * 5
        for r, i in enumerate(own):
            out[i] = "1" * zeros[r] + text[r * width : (r + 1) * width].lstrip("1")
    return out


def base58_decode_all(values: list[str | None]) -> list[bytes | None]:
    """The inverse, side by side too; None for text that isn't base58."""
    out: list[bytes | None] = [None] * len(values)
    table = np.full(256, 255, np.uint8)
    table[np.frombuffer(BASE58.encode(), np.uint8)] = np.arange(58)
    for own, many in _by_length(values):
        joined = "".join(values[i] for i in own)
        if not many or not joined.isascii():
            for i in own:
                out[i] = base58_decode(values[i])
            continue
        width = len(values[own[0]])
        digits = table[np.frombuffer(joined.encode(), np.uint8)].reshape(len(own), width)
        good = (digits < 58).all(1)
        digits = np.where(digits < 58, digits, 0).astype(np.uint64)
        size = -(-int(width * math.log2(58) / 8 + 1) // 4) * 4
        limbs = np.zeros((size // 4, len(own)), np.uint64)
        for a in range(0, width, 5):
            part = digits[:, a : a + 5]
            carry = np.zeros(len(own), np.uint64)
            for c in part.T:
                carry = carry * np.uint64(58) + c
            factor = np.uint64(58 ** part.shape[1])
            for j in range(len(limbs) - 1, -1, -1):
                carry += limbs[j] * factor
                limbs[j] = carry & np.uint64(0xFFFFFFFF)
                carry >>= np.uint64(32)
        raw = np.ascontiguousarray(limbs.T.astype(">u4")).tobytes()
        for r, i in enumerate(own):
            if good[r]:
                text = values[i]
                out[i] = bytes(width - len(text.lstrip("1"))) + raw[r * size : (r + 1) * size].lstrip(b"\0")
    return out


class Malformed(ValueError):
    """Bytes that don't follow their format."""


_ONE_BYTE = [bytes([i]) for i in range(256)]


def varint_encode(value: int) -> bytes:
    if 0 <= value < 0x80:
        return _ONE_BYTE[value]
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def varint_decode(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, place after it) of an unsigned LEB128 number of at most 64 bits."""
    if at < len(data) and (value := data[at]) < 0x80:
        return value, at + 1
    value = 0
    for i in range(10):
        if at + i >= len(data):
            raise Malformed("varint ends early")
        byte = data[at + i]
        if i == 9 and byte > 1:
            raise Malformed("varint over 64 bits")
        value |= (byte & 0x7F) << 7 * i
        if byte < 0x80:
            return value, at + i + 1
    raise Malformed("varint over 10 bytes")


def short_encode(value: int) -> bytes:
    """The 1 to 3 byte length prefix of transactions."""
    return varint_encode(value)


def short_decode(data: bytes, at: int) -> tuple[int, int]:
    value, end = varint_decode(data[: at + 3], at)
    if value > 0xFFFF:
        raise Malformed("length over 16 bits")
    return value, end


def _crc_table() -> list[int]:
    # the reflected polynomial of ISO 3309
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xD800000000000000 if i & 1 else 0)
        table.append(i)
    return table


_CRC = _crc_table()


_SPAN = 4096
#: Where the rows of _crc_by_distance() begin, the farthest first.
_ROWS = np.arange((_SPAN - 1) << 8, -1, -256, dtype=np.intp)


@lru_cache(1)
def _crc_by_distance() -> np.ndarray:
    """What a byte adds to the checksum when k bytes follow it: row k, column byte."""
    one = np.array(_CRC, np.uint64)
    rows = [one]
    for _ in range(_SPAN - 1):
        rows.append(rows[-1] >> np.uint64(8) ^ one[(rows[-1] & np.uint64(0xFF)).astype(np.intp)])
    return np.ascontiguousarray(np.stack(rows)).ravel()


def crc64(data: bytes) -> int:
    """CRC-64/GO-ISO. The checksum is linear: a span's bytes, the first eight mixed with what came before, each add a term that depends on their distance to its end."""
    crc, at, n = 0xFFFFFFFFFFFFFFFF, 0, len(data)
    while n - at >= 64:
        size = min(_SPAN, n - at)
        span = np.frombuffer(data, np.uint8, size, at).astype(np.intp)
        span[:8] ^= np.frombuffer(crc.to_bytes(8, "little"), np.uint8)
        span += _ROWS[_SPAN - size :]
        crc = int(np.bitwise_xor.reduce(_crc_by_distance().take(span)))
        at += size
    for byte in data[at:]:
        crc = _CRC[(crc ^ byte) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFFFFFFFFFF


def fnv1a64(data: bytes) -> int:
    value = 0xCBF29CE484222325
    for byte in data:
        value = (value ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return value


def checksum_ok(data: bytes, expected: int | None) -> bool:
    """No checksum passes; otherwise the current or the older kind has to agree."""
    return expected is None or crc64(data) == expected or fnv1a64(data) == expected


def cbor_decode(data: bytes, at: int = 0) -> tuple[object, int]:
    """(value, place after it): integers, byte and text strings, arrays, maps, tags, null and booleans. A tagged link is its bytes without the leading zero."""
    if at >= len(data):
        raise Malformed("CBOR ends early")
    major, low = data[at] >> 5, data[at] & 31
    at += 1
    if low < 24:
        value = low
    elif low < 28:
        size = 1 << (low - 24)
        if at + size > len(data):
            raise Malformed("CBOR ends early")
        value, at = int.from_bytes(data[at : at + size], "big"), at + size
    else:
        raise Malformed("CBOR of indefinite length")
    if major == 0:
        return value, at
    if major == 1:
        return -1 - value, at
    if major in (2, 3):
        if at + value > len(data):
            raise Malformed("CBOR string ends early")
        raw = data[at : at + value]
        try:
            return (raw if major == 2 else raw.decode()), at + value
        except UnicodeDecodeError as e:
            raise Malformed("CBOR text") from e
    if major == 4:
        if value > len(data) - at:
            raise Malformed("CBOR array ends early")
        items, end = [], len(data)
        for _ in range(value):
            # small numbers and nulls, which most items are, without a call
            if at < end and ((item := data[at]) < 24 or item == 0xF6):
                items.append(None if item == 0xF6 else item)
                at += 1
                continue
            item, at = cbor_decode(data, at)
            items.append(item)
        return items, at
    if major == 5:
        if value > len(data) - at:
            raise Malformed("CBOR map ends early")
        pairs = {}
        for _ in range(value):
            key, at = cbor_decode(data, at)
            if isinstance(key, (list, dict)):
                raise Malformed("CBOR map key")
            pairs[key], at = cbor_decode(data, at)
        return pairs, at
    if major == 6:
        inner, at = cbor_decode(data, at)
        if value == 42 and isinstance(inner, bytes):
            if not inner:
                raise Malformed("empty link")
            inner = inner[1:]
        return inner, at
    if value in (20, 21):
        return value == 21, at
    if value in (22, 23):
        return None, at
    raise Malformed("CBOR simple value")


class Link(bytes):
    """Bytes that are written as a tagged link."""


def _cbor_head(major: int, n: int) -> bytes:
    if n < 24:
        return _ONE_BYTE[major << 5 | n]
    for low, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << 8 * size:
            return _ONE_BYTE[major << 5 | low] + n.to_bytes(size, "big")
    raise Malformed("integer over 64 bits")


def cbor_encode(value: object) -> bytes:
    if value is None:
        return b"\xf6"
    if isinstance(value, bool):
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        return _cbor_head(0, value) if value >= 0 else _cbor_head(1, -1 - value)
    if isinstance(value, Link):
        return _cbor_head(6, 42) + cbor_encode(b"\0" + bytes(value))
    if isinstance(value, bytes):
        return _cbor_head(2, len(value)) + value
    if isinstance(value, str):
        return _cbor_head(3, len(value.encode())) + value.encode()
    if isinstance(value, (list, tuple)):
        return _cbor_head(4, len(value)) + b"".join(map(cbor_encode, value))
    if isinstance(value, dict):
        return _cbor_head(5, len(value)) + b"".join(cbor_encode(k) + cbor_encode(v) for k, v in value.items())
    raise TypeError(type(value))


def _each(f, kind: pa.DataType):
    return lambda column: pa.array([None if x is None else f(x) for x in column.to_pylist()], kind)


def to_base58(data: Column | str) -> Column:
    return F.arrow_udf(lambda c: pa.array(base58_encode_all(c.to_pylist()), pa.string()), "string")(data)


def from_base58(text: Column | str) -> Column:
    """Null for text that isn't base58."""
    return F.arrow_udf(lambda c: pa.array(base58_decode_all(c.to_pylist()), pa.binary()), "binary")(text)


def to_base64(data: Column | str) -> Column:
    """Without the line breaks that Spark's function puts after every 76 characters."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def from_base64(text: Column) -> Column:
    """Strict base64 without a UDF: unpadded or non-canonical text is null."""
    data = F.try_to_binary(text, F.lit("base64"))
    return F.when((F.length(text) % 4 == 0) & (to_base64(data) == text), data)


def to_varint(value: Column | str) -> Column:
    return F.arrow_udf(_each(varint_encode, pa.binary()), "binary")(value)


def from_varint(data: Column | str) -> Column:
    return F.arrow_udf(_each(lambda x: varint_decode(x)[0], pa.int64()), "long")(data)


def crc64_of(data: Column | str) -> Column:
    """As a signed 64-bit number."""
    return F.arrow_udf(_each(lambda x: struct.unpack("<q", struct.pack("<Q", crc64(x)))[0], pa.int64()), "long")(data)


def text_if_valid(data: Column) -> Column:
    """Bytes as text where they are UTF-8; null for others."""
    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def little_endian(data: Column, start: int, size: int) -> Column:
    """Unsigned integer of up to 7 bytes at a fixed place, without a UDF."""
    digits = F.hex(F.substring(data, start + 1, size))
    turned = F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), 1)), "")
    return F.conv(turned, 16, 10).cast("long")
