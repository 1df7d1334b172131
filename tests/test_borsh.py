import json
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quern.functions import borsh
from quern.functions.idl import Idl, IdlError, Type, discriminator, parse_type

DESCRIPTION = {
    "instructions": [{"name": "sell", "args": [{"name": "amount", "type": "u64"}, {"name": "least", "type": "u64"}], "accounts": [{"name": "payer"}]}, {"name": "create", "args": [{"name": "name", "type": "string"}, {"name": "token_name", "type": "string"}]}, {"name": "odd", "args": [{"name": "x", "type": "u256"}]}],
    "events": [{"name": "TradeEvent"}, {"name": "Pair"}, {"name": "Inline", "fields": [{"name": "a", "type": "u8"}]}],
    "types": [
        {"name": "TradeEvent", "type": {"kind": "struct", "fields": [{"name": "mint", "type": "pubkey"}, {"name": "amount", "type": "u64"}, {"name": "buy", "type": "bool"}, {"name": "ix_name", "type": "string"}]}},
        {"name": "Pair", "type": {"kind": "struct", "fields": ["u8", "u8"]}},
        {"name": "One", "type": {"kind": "struct", "fields": ["bool"]}},
        {"name": "Kind", "type": {"kind": "enum", "variants": [{"name": "a"}, {"name": "b", "fields": [{"name": "x", "type": "u8"}]}, {"name": "c", "fields": ["u8"]}, {"name": "d", "fields": ["u8", "string"]}]}},
    ],
}
IDL = Idl.load(DESCRIPTION)
CODEC = borsh.Codec(IDL)


def test_known_discriminators():
    assert list(discriminator("global", "sell")) == [51, 230, 133, 164, 1, 127, 131, 173]
    assert list(discriminator("event", "TradeEvent")) == [189, 219, 127, 211, 78, 230, 97, 238]
    assert discriminator("global", "x", list(range(10))) == bytes(range(8))


def test_instruction_and_unknown_short_trailing():
    data = bytes([51, 230, 133, 164, 1, 127, 131, 173]) + struct.pack("<QQ", 1_000_000_000, 500_000)
    decode = borsh.Decoder(IDL, "instructions")
    assert decode(data)[:2] == ("sell", {"amount": 1_000_000_000, "least": 500_000})
    assert decode(data + b"more")[1]["least"] == 500_000
    assert decode(b"\xff" * 16) is None and decode(b"\0" * 4) is None and decode(None) is None
    assert decode(data[:-1]) is None


def test_missing_tail():
    data = bytes([51, 230, 133, 164, 1, 127, 131, 173]) + struct.pack("<Q", 7)
    assert borsh.Decoder(IDL, "instructions", 5)(data)[1:3] == ({"amount": 7, "least": None}, True)
    assert borsh.Decoder(IDL, "instructions", 5)(data[:8]) is None


def test_cpi_and_fallback():
    event = CODEC.write_item(next(i for i in IDL.events.values() if i.name == "Inline"), {"a": 3})
    one = borsh.Decoder(IDL, "one")
    assert one(event)[3] == "event" and one(borsh.CPI_MARK + event)[3] == "event_cpi"


@pytest.mark.parametrize("t, raw, value", [
    ("u64", struct.pack("<Q", 2**53), 2**53), ("u64", struct.pack("<Q", 2**53 + 1), str(2**53 + 1)), ("u128", (2**100).to_bytes(16, "little"), str(2**100)), ("i128", (-5).to_bytes(16, "little", signed=True), "-5"),
    ("f64", struct.pack("<d", float("nan")), None), ("bool", b"\2", True), ("bytes", b"\1\0\0\0a", "2g"), ({"option": "u8"}, b"\0", None), ({"option": "u8"}, b"\7\5", 5), ({"array": ["u8", 2]}, b"\1\2", [1, 2]),
    ({"defined": "One"}, b"\1", True), ({"defined": {"name": "Pair"}}, b"\1\2", [1, 2]), ({"defined": "Kind"}, b"\0", "a"), ({"defined": "Kind"}, b"\1\5", {"variant": "b", "x": 5}), ({"defined": "Kind"}, b"\2\5", {"variant": "c", "value": 5}), ({"defined": "Kind"}, b"\3\5\1\0\0\0z", {"variant": "d", "values": [5, "z"]}),
])
def test_shapes(t, raw, value):
    assert CODEC.reader(parse_type(t))(raw, 0) == (value, len(raw))


@pytest.mark.parametrize("t, raw", [("u8", b""), ("string", b"\5\0\0\0ab"), ("string", b"\1\0\0\0\xff"), ({"vec": "u64"}, b"\xff\xff\xff\xff"), ({"defined": "Kind"}, b"\x09"), ("u256", b"\0" * 32), ({"defined": "Nowhere"}, b"")])
def test_damaged(t, raw):
    with pytest.raises(borsh.DecodeError):
        CODEC.reader(parse_type(t))(raw, 0)


def test_unknown_description_types():
    with pytest.raises(IdlError):
        parse_type({"hashMap": ["u8", "u8"]})
    assert IDL.warnings == ["unknown type u256"]


def test_schemas_rename_and_collision():
    assert [f.name for f in IDL.schemas("instructions")["create"].fields][5:] == ["token_name_2", "token_name"]
    assert set(IDL.schemas("events")) == {"TradeEvent", "Inline"}  # a tuple has no columns


_values = {"u8": st.integers(0, 255), "u64": st.integers(0, 2**53), "i64": st.integers(-(2**63), 2**63 - 1), "string": st.text("aZ0 é日\0😀", max_size=5), "bool": st.booleans()}


@settings(deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.data())
def test_round_trip(data):
    name = data.draw(st.sampled_from(sorted(_values)))
    t, value = Type(name), data.draw(_values[name])
    for wrapped, v in ((t, value), (Type("option", t), None), (Type("vec", t), [value, value]), (Type("array", t, 1), [value])):
        raw = CODEC.write(wrapped, v)
        assert CODEC.reader(wrapped)(raw, 0) == (v, len(raw))


def test_columns(spark):
    event = next(i for i in IDL.events.values() if i.name == "TradeEvent")
    j = json.dumps({"mint": "1" * 32, "amount": 2**60, "buy": True, "ix_name": "é"})
    df = spark.createDataFrame([(j,), (None,)], "j string").withColumn("d", borsh.decode(borsh.encode("j", IDL, "TradeEvent"), IDL, "events"))
    rows = df.select("d.name", borsh.typed(df.d["data"], IDL.payload(event)).alias("p")).collect()
    assert rows[0].name == "TradeEvent" and int(rows[0].p.amount) == 2**60 and rows[0].p.ix_name == "é"
    assert rows[1].name is None
