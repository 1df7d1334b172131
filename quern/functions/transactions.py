"""Ledger transactions and their execution metadata: binary layouts, key resolution and extraction."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codecs import Malformed, base58_encode_all, short_decode, short_encode, varint_decode, varint_encode

# ---------------------------------------------------------------- transactions


def _bytes(data: bytes, at: int, n: int) -> tuple[bytes, int]:
    if at + n > len(data):
        raise Malformed("transaction ends early")
    return data[at : at + n], at + n


def parse_transaction(data: bytes) -> dict:
    """signatures, keys, instructions (program, accounts, data by index), lookups; version None for the old layout."""
    n, at = short_decode(data, 0)
    signatures = []
    for _ in range(n):
        s, at = _bytes(data, at, 64)
        signatures.append(s)
    first, _ = _bytes(data, at, 1)
    version = None
    if first[0] & 0x80:
        version, at = first[0] & 0x7F, at + 1
        if version:
            raise Malformed("unknown version")
    header, at = _bytes(data, at, 3)
    n, at = short_decode(data, at)
    keys = []
    for _ in range(n):
        k, at = _bytes(data, at, 32)
        keys.append(k)
    _, at = _bytes(data, at, 32)
    n, at = short_decode(data, at)
    instructions = []
    for _ in range(n):
        program, at = _bytes(data, at, 1)
        m, at = short_decode(data, at)
        accounts, at = _bytes(data, at, m)
        m, at = short_decode(data, at)
        body, at = _bytes(data, at, m)
        instructions.append({"program": program[0], "accounts": list(accounts), "data": body})
    lookups = 0
    if version is not None:
        lookups, at = short_decode(data, at)
        for _ in range(lookups):
            _, at = _bytes(data, at, 32)
            for _ in range(2):
                m, at = short_decode(data, at)
                _, at = _bytes(data, at, m)
    return {"signatures": signatures, "version": version, "required": header[0], "keys": keys, "instructions": instructions, "lookups": lookups, "end": at}


def build_transaction(signatures: list[bytes], keys: list[bytes], instructions: list[tuple[int, list[int], bytes]], version: int | None = None, lookups: list[tuple[bytes, list[int], list[int]]] = ()) -> bytes:
    """The inverse, for tests and for round trips."""
    out = short_encode(len(signatures)) + b"".join(signatures)
    if version is not None:
        out += bytes([0x80 | version])
    out += bytes([len(signatures), 0, 0]) + short_encode(len(keys)) + b"".join(keys) + bytes(32) + short_encode(len(instructions))
    for program, accounts, data in instructions:
        out += bytes([program]) + short_encode(len(accounts)) + bytes(accounts) + short_encode(len(data)) + data
    if version is not None:
        out += short_encode(len(lookups)) + b"".join(k + short_encode(len(w)) + bytes(w) + short_encode(len(r)) + bytes(r) for k, w, r in lookups)
    return out


# ---------------------------------------------------------------- metadata


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a protobuf message."""
    at, end = 0, len(data)
    while at < end:
        tag, at = (data[at], at + 1) if data[at] < 0x80 else varint_decode(data, at)
        number, wire = tag >> 3, tag & 7
        if not number:
            raise Malformed("field 0")
        if wire == 2:
            n, at = (data[at], at + 1) if at < end and data[at] < 0x80 else varint_decode(data, at)
            if at + n > end:
                raise Malformed("transaction ends early")
            value, at = data[at : at + n], at + n
        elif wire == 0:
            value, at = varint_decode(data, at)
        elif wire in (1, 5):
            value, at = _bytes(data, at, 8 if wire == 1 else 4)
        else:
            raise Malformed("wire type")
        yield number, wire, value


def _packed(wire: int, value: object) -> list[int]:
    if wire == 0:
        return [value]
    out, at = [], 0
    while at < len(value):
        v, at = varint_decode(value, at)
        out.append(v)
    return out


def _empty() -> dict:
    return {"err": None, "fee": 0, "pre": [], "post": [], "inner": [], "logs": None, "pre_tokens": [], "post_tokens": [], "writable": [], "readonly": []}


def _inner_message(data: bytes) -> dict:
    out = {"index": 0, "instructions": []}
    for n, _, v in _fields(data):
        if n == 1:
            out["index"] = v
        elif n == 2:
            one = {"program": 0, "accounts": [], "data": b""}
            for m, _, w in _fields(v):
                if m == 1:
                    one["program"] = w
                elif m == 2:
                    one["accounts"] = list(w)
                elif m == 3:
                    one["data"] = w
            out["instructions"].append(one)
    return out


def _token_message(data: bytes) -> dict:
    out = {"account_index": 0, "mint": "", "owner": "", "ui_amount": None}
    for n, _, v in _fields(data):
        if n == 1:
            out["account_index"] = v
        elif n == 2:
            out["mint"] = v.decode()
        elif n == 4:
            out["owner"] = v.decode()
        elif n == 3:
            for m, _, w in _fields(v):
                if m == 4:
                    out["ui_amount"] = w.decode()
    return out


def _protobuf(data: bytes) -> dict:
    out, logs, no_logs = _empty(), [], False
    for n, wire, v in _fields(data):
        if n == 1:
            out["err"] = "".join(f"{x:02x}" for x in next((w for m, _, w in _fields(v) if m == 1), b""))
        elif n == 2:
            out["fee"] = v
        elif n == 3:
            out["pre"] += _packed(wire, v)
        elif n == 4:
            out["post"] += _packed(wire, v)
        elif n == 5:
            out["inner"].append(_inner_message(v))
        elif n == 6:
            logs.append(v.decode())
        elif n == 7:
            out["pre_tokens"].append(_token_message(v))
        elif n == 8:
            out["post_tokens"].append(_token_message(v))
        elif n == 11:
            no_logs = bool(v)
        elif n == 12:
            out["writable"].append(v)
        elif n == 13:
            out["readonly"].append(v)
    out["logs"] = None if no_logs else logs
    return out


def _old_layout(data: bytes) -> dict:
    """The older fixed layout: status, fee, balances; what follows may be missing."""
    out = _empty()
    tag = struct.unpack_from("<I", data)[0] if len(data) >= 4 else None
    if tag is None or tag > 1:
        raise Malformed("status")
    at = 4
    if tag == 1:
        code, at = _bytes(data, at, 4)
        out["err"] = f"error {int.from_bytes(code, 'little')}"
        if code == b"\x08\0\0\0":  # an instruction's error: its index and code follow
            _, at = _bytes(data, at, 5)
    fee, at = _bytes(data, at, 8)
    out["fee"] = int.from_bytes(fee, "little")
    for name in ("pre", "post"):
        n, at = _bytes(data, at, 8)
        n = int.from_bytes(n, "little")
        body, at = _bytes(data, at, 8 * n)
        out[name] = list(struct.unpack(f"<{n}Q", body))
    return out


def parse_metadata(data: bytes | None) -> dict | None:
    """Of zstd-compressed or plain bytes; None for none. Protobuf first, then the older layout."""
    if not data:
        return None
    data = _plain(data)
    try:
        return _protobuf(data)
    except (Malformed, UnicodeDecodeError, AttributeError, TypeError):
        return _old_layout(data)


def _plain(data: bytes) -> bytes:
    """Without zstd compression, if there is any."""
    if data[:4] != b"\x28\xb5\x2f\xfd":
        return data
    import zstandard

    try:
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    except zstandard.ZstdError as e:
        raise Malformed("compressed data") from e


def parse_rewards(data: bytes) -> list[dict]:
    """Rewards of a block: account, amount, balance after it, kind by number, commission; protobuf, compressed or plain."""
    out = []
    for n, wire, v in _fields(_plain(data)):
        if n != 1:
            continue
        if wire != 2:
            raise Malformed("rewards")
        one = {"account": "", "lamports": 0, "post_balance": 0, "kind": 0, "commission": None}
        for m, w, x in _fields(v):
            if m in (2, 3, 4) and w == 0:
                one[("lamports", "post_balance", "kind")[m - 2]] = x - (1 << 64) if m == 2 and x >> 63 else x
            elif m in (1, 5) and w == 2:
                one["account" if m == 1 else "commission"] = x.decode("utf-8", "replace")
        out.append(one)
    return out


def build_rewards(rewards: list[tuple[str, int, int, int, str | None]]) -> bytes:
    """The inverse, for tests and for round trips."""
    out = b""
    for account, lamports, after, kind, commission in rewards:
        body = varint_encode(10) + varint_encode(len(account)) + account.encode() + varint_encode(16) + varint_encode(lamports % (1 << 64)) + varint_encode(24) + varint_encode(after) + varint_encode(32) + varint_encode(kind)
        body += b"" if commission is None else varint_encode(42) + varint_encode(len(commission)) + commission.encode()
        out += varint_encode(10) + varint_encode(len(body)) + body
    return out


def build_metadata(fee: int, pre: list[int], post: list[int], logs: list[str] | None = (), inner: list[tuple[int, list[tuple[int, list[int], bytes]]]] = (), err: bytes | None = None, pre_tokens: list[tuple[int, str, str, str]] = (), post_tokens: list[tuple[int, str, str, str]] = (), writable: list[bytes] = (), readonly: list[bytes] = ()) -> bytes:
    """Protobuf metadata, for tests and for round trips."""

    def part(n: int, body: bytes) -> bytes:
        return varint_encode(n << 3 | 2) + varint_encode(len(body)) + body

    def number(n: int, value: int) -> bytes:
        return varint_encode(n << 3) + varint_encode(value)

    def token(t: tuple[int, str, str, str]) -> bytes:
        return number(1, t[0]) + part(2, t[1].encode()) + part(3, part(4, t[3].encode())) + part(4, t[2].encode())

    out = part(1, part(1, err)) if err is not None else b""
    out += number(2, fee) + part(3, b"".join(map(varint_encode, pre))) + part(4, b"".join(map(varint_encode, post)))
    for index, items in inner:
        out += part(5, number(1, index) + b"".join(part(2, number(1, p) + part(2, bytes(a)) + part(3, d)) for p, a, d in items))
    out += b"".join(part(6, x.encode()) for x in logs or ())
    out += b"".join(part(7, token(t)) for t in pre_tokens) + b"".join(part(8, token(t)) for t in post_tokens)
    out += number(11, 1) if logs is None else b""
    return out + b"".join(part(12, k) for k in writable) + b"".join(part(13, k) for k in readonly)


# ---------------------------------------------------------------- columns


_IX = "array<struct<program:int,accounts:array<int>,data:binary>>"
OUTER = f"struct<signatures:array<binary>,version:int,keys:array<binary>,instructions:{_IX},lookups:int>"
_TOKEN = "array<struct<account_index:long,mint:string,owner:string,ui_amount:string>>"
_META = {"err": "string", "fee": "decimal(20,0)", "pre": "array<decimal(20,0)>", "post": "array<decimal(20,0)>", "inner": f"array<struct<index:int,instructions:{_IX}>>", "logs": "array<string>", "pre_tokens": _TOKEN, "post_tokens": _TOKEN, "writable": "array<binary>", "readonly": "array<binary>"}
META = f"struct<{','.join(f'{k}:{t}' for k, t in _META.items())}>"
_PA_IX = pa.list_(pa.struct([("program", pa.int32()), ("accounts", pa.list_(pa.int32())), ("data", pa.binary())]))
_PA_TOKEN = pa.list_(pa.struct([("account_index", pa.int64()), ("mint", pa.string()), ("owner", pa.string()), ("ui_amount", pa.string())]))
_BIG = pa.decimal128(20, 0)


def _soft(f):
    def run(x: bytes | None) -> dict | None:
        try:
            return None if x is None else f(x)
        except Malformed:
            return None

    return run


def decode_transaction(data: Column | str) -> Column:
    """struct of the transaction; null for bytes that aren't one."""
    kind = pa.struct([("signatures", pa.list_(pa.binary())), ("version", pa.int32()), ("keys", pa.list_(pa.binary())), ("instructions", _PA_IX), ("lookups", pa.int32())])
    one = _soft(parse_transaction)
    return F.arrow_udf(lambda c: pa.array(list(map(one, c.to_pylist())), kind), OUTER)(data)


def decode_metadata(data: Column | str, fields: tuple[str, ...] = tuple(_META)) -> Column:
    """struct of the metadata, or of some of its fields; null for none and for bytes that can't be read. All bytes are read whatever the fields, of which each costs its way through Arrow."""
    kind = pa.struct([("err", pa.string()), ("fee", _BIG), ("pre", pa.list_(_BIG)), ("post", pa.list_(_BIG)), ("inner", pa.list_(pa.struct([("index", pa.int32()), ("instructions", _PA_IX)]))), ("logs", pa.list_(pa.string())), ("pre_tokens", _PA_TOKEN), ("post_tokens", _PA_TOKEN), ("writable", pa.list_(pa.binary())), ("readonly", pa.list_(pa.binary()))])
    kind = pa.struct([kind.field(f) for f in fields])
    one = _soft(parse_metadata)
    return F.arrow_udf(lambda c: pa.array(list(map(one, c.to_pylist())), kind), f"struct<{','.join(f'{k}:{_META[k]}' for k in fields)}>")(data)


_REWARDS = "array<struct<account:string,lamports:long,post_balance:decimal(20,0),kind:int,commission:string>>"


def decode_rewards(data: Column | str) -> Column:
    """Rewards of a block node's payload; null for none and for bytes that can't be read."""
    kind = pa.list_(pa.struct([("account", pa.string()), ("lamports", pa.int64()), ("post_balance", _BIG), ("kind", pa.int32()), ("commission", pa.string())]))
    one = _soft(parse_rewards)
    return F.arrow_udf(lambda c: pa.array(list(map(one, c.to_pylist())), kind), _REWARDS)(data)


def run_counters(raw: DataFrame, targets: list[bytes] | None = None) -> DataFrame:
    """One row of what a run over (tx_data, meta_data) with targets sees: transactions, decode_errors (bytes that are no transaction), metadata_skipped (no own key is a target, so it isn't read),
    metadata_errors (it can't be read), metadata_missing, and matching transactions. An empty table has all 0."""
    rows = raw.select(decode_transaction("tx_data").alias("tx"), "meta_data")
    wanted = F.arrays_overlap("tx.keys", F.array(*[F.lit(t) for t in targets])) if targets else F.lit(True)
    rows = rows.withColumn("wanted", F.coalesce(wanted, F.lit(False)) & F.col("tx").isNotNull())
    rows = rows.withColumn("meta", decode_metadata(F.when(F.col("wanted"), F.col("meta_data"))))
    programs = program_keys(all_instructions(F.col("tx"), F.col("meta")), all_keys(F.col("tx"), F.col("meta")))
    matched = F.col("wanted") & (F.arrays_overlap(programs, F.array(*[F.lit(t) for t in targets])) if targets else F.lit(True))
    there = F.coalesce(F.length("meta_data"), F.lit(0)) > 0
    return rows.agg(
        F.count("*").alias("transactions"), F.count_if(F.col("tx").isNull()).alias("decode_errors"), F.count_if(F.col("tx").isNotNull() & ~F.col("wanted")).alias("metadata_skipped"),
        F.count_if(F.col("wanted") & there & F.col("meta").isNull()).alias("metadata_errors"), F.count_if(F.col("wanted") & ~there).alias("metadata_missing"), F.count_if(matched).alias("matching"),
    )


def text_keys(keys: Column) -> Column:
    """base58 of an array of binary. Each different key of a batch is divided once."""

    def run(column: pa.Array) -> pa.Array:
        flat = pc.dictionary_encode(column.flatten())
        names = pa.array(base58_encode_all(flat.dictionary.to_pylist()), pa.string())
        offsets = np.concatenate(([0], np.cumsum(np.array(pc.fill_null(pc.list_value_length(column), 0), np.int64)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), names.take(flat.indices), mask=column.is_null())

    return F.arrow_udf(run, "array<string>")(keys)


def all_keys(tx: Column, meta: Column) -> Column:
    """Static keys, then, for the versioned layout with metadata, the writable and read-only ones from lookup tables."""
    none = F.array().cast("array<binary>")
    loaded = F.when(tx["version"].isNotNull(), F.concat(F.coalesce(meta["writable"], none), F.coalesce(meta["readonly"], none))).otherwise(none)
    return F.concat(tx["keys"], loaded)


def all_instructions(tx: Column, meta: Column) -> Column:
    """Outer instructions, then all inner ones in the order of their sets."""
    inner = F.flatten(F.transform(F.coalesce(meta["inner"], F.array().cast(f"array<struct<index:int,instructions:{_IX}>>")), lambda s: s["instructions"]))
    return F.concat(tx["instructions"], inner)


def name_instructions(instructions: Column, names: Column) -> Column:
    """Indexes replaced by key names; one out of range is UNKNOWN_PROGRAM_INDEX_i. data stays binary."""

    def key(i: Column) -> Column:
        return F.coalesce(F.get(names, i), F.concat(F.lit("UNKNOWN_PROGRAM_INDEX_"), i.cast("string")))

    return F.transform(instructions, lambda x: F.struct(key(x["program"]).alias("program_id"), x["data"].alias("data"), F.transform(x["accounts"], key).alias("accounts")))


def program_keys(instructions: Column, keys: Column) -> Column:
    """Distinct program keys in the order of their bytes; indexes out of range are left out."""
    found = F.transform(instructions, lambda x: F.get(keys, x["program"]))
    return F.array_sort(F.array_distinct(F.filter(found, lambda k: k.isNotNull())))


def balance_deltas(names: Column, pre: Column, post: Column) -> Column:
    """Positions of both lists side by side, the shorter one's length; accounts without a key get UNKNOWN_ACCOUNT_INDEX_i."""
    n = F.least(F.size(pre), F.size(post))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        a, b = F.get(pre, i).cast("decimal(20,0)"), F.get(post, i).cast("decimal(20,0)")
        return F.struct(F.coalesce(F.get(names, i), F.concat(F.lit("UNKNOWN_ACCOUNT_INDEX_"), i.cast("string"))).alias("account"), a.alias("pre_amount"), b.alias("post_amount"), (b - a).cast("long").alias("delta"))

    return F.transform(at, one)


def token_deltas(pre: Column, post: Column) -> Column:
    """Full outer match of token balances on mint, owner and account index: of equal keys the last one counts; ordered by key; the absent side is null."""

    def keyed(xs: Column) -> Column:
        return F.transform(xs, lambda x: F.struct(F.struct(x["mint"].alias("mint"), F.coalesce(x["owner"], F.lit("")).alias("owner"), x["account_index"].alias("account_index")).alias("k"), x["ui_amount"].alias("v")))

    def last(xs: Column, k: Column) -> Column:
        return F.try_element_at(F.filter(keyed(xs), lambda x: x["k"] == k), F.lit(-1))["v"]

    keys = F.array_sort(F.array_distinct(F.transform(F.concat(keyed(pre), keyed(post)), lambda x: x["k"])))
    return F.transform(keys, lambda k: F.struct(k["mint"].alias("mint"), k["owner"].alias("owner"), k["account_index"].alias("account_index"), last(pre, k).alias("pre_ui_amount"), last(post, k).alias("post_ui_amount")))


def records(raw: DataFrame, targets: list[bytes] | None = None, strict_lookup: bool = False) -> DataFrame:
    """Transactions as flat records, from (slot, block_time, tx_data, meta_data). Of file, group_id, pos and tx_index those that are there go along: they give the ledger's order.

    Two passes over the bytes: the small transaction part is read first, and rows that can't match a target program are dropped before the metadata,
    which is far larger, is decompressed. With `strict_lookup` programs that only a lookup table names are found too, at the price of reading all metadata."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = set(targets or ())
        for batch in batches:
            parsed = list(map(_soft(parse_transaction), batch.column("tx_data").to_pylist()))
            keep = [p is not None and (not wanted or strict_lookup or any(k in wanted for k in p["keys"])) for p in parsed]
            kind = pa.struct([("signatures", pa.list_(pa.binary())), ("version", pa.int32()), ("keys", pa.list_(pa.binary())), ("instructions", _PA_IX), ("lookups", pa.int32())])
            rows = pa.array([p for p, y in zip(parsed, keep, strict=True) if y], kind)
            some = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*[some.column(c) for c in (*order, "slot", "block_time", "meta_data")], rows], [*order, "slot", "block_time", "meta_data", "tx"])

    order = [c for c in ("file", "group_id", "pos", "tx_index") if c in raw.columns]
    kinds = "".join(f"{c} {t}, " for c, t in raw.select(*order).dtypes) if order else ""
    rows = raw.select(*order, "slot", "block_time", "tx_data", "meta_data").mapInArrow(first, f"{kinds}slot long, block_time long, meta_data binary, tx {OUTER}")
    rows = rows.withColumn("meta", decode_metadata("meta_data")).drop("meta_data")
    tx, meta = F.col("tx"), F.col("meta")
    rows = rows.withColumn("keys", all_keys(tx, meta)).withColumn("ix", all_instructions(tx, meta))
    rows = rows.withColumn("programs", program_keys(F.col("ix"), F.col("keys")))
    if targets:
        rows = rows.where(F.arrays_overlap("programs", F.array(*[F.lit(t) for t in targets])))
    rows = rows.withColumn("names", text_keys(F.col("keys")))
    none = F.array().cast("array<decimal(20,0)>")
    tokens = F.array().cast(_TOKEN)
    return rows.select(
        *order, "slot", "block_time", text_keys(tx["signatures"]).alias("signatures"), F.col("names").alias("accounts"), text_keys(F.col("programs")).alias("program_ids"), F.coalesce(meta["fee"], F.lit(0).cast("decimal(20,0)")).alias("fee"),
        balance_deltas(F.col("names"), F.coalesce(meta["pre"], none), F.coalesce(meta["post"], none)).alias("account_balance_deltas"),
        token_deltas(F.coalesce(meta["pre_tokens"], tokens), F.coalesce(meta["post_tokens"], tokens)).alias("token_balance_deltas"),
        meta["logs"].alias("log_messages"), meta["err"].alias("err"), name_instructions(F.col("ix"), F.col("names")).alias("instructions"),
    )
