"""Queries that encode rows into a binary format, decode them with this package, and must give the rows back."""

from __future__ import annotations

import hashlib
import itertools
import os
import shutil
import struct
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import borsh, codecs, logs, transactions
from ..functions.idl import Idl
from ..sources import archive
from . import relational, sinks
from .relational import ix_rows, table
from .scratch import scratch

QUERIES: dict[str, relational.Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f: relational.Query) -> relational.Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _field(name: str, t: object) -> dict:
    return {"name": name, "type": t}


_ID, _U32 = _field("event_id", "u64"), "u32"
#: The description of the records the queries write: one event of each shape, and instructions.
DESCRIPTION = {
    "instructions": [
        {"name": "line", "accounts": [{"name": "payer"}, {"name": "part"}], "args": [_field("orderkey", "u64"), _field("linenumber", _U32), _field("suppkey", "i64"), _field("quantity", "f64")]},
        {"name": "create", "accounts": [], "args": [_field("name", "string"), _field("slot", "u64"), _field("other", "string")]},
    ],
    "events": [{"name": n} for n in ("Trade", "Optional", "Listed", "Chosen", "Nested", "Tail", "Wide")],
    "types": [
        {"name": "Trade", "type": {"kind": "struct", "fields": [_ID, _field("user_id", "i64"), _field("event_type", "string"), _field("value", "f64"), _field("ts", "i64")]}},
        {"name": "Optional", "type": {"kind": "struct", "fields": [_ID, _field("note", {"option": "string"}), _field("amount", {"option": "f64"})]}},
        {"name": "Listed", "type": {"kind": "struct", "fields": [_ID, _field("items", {"vec": "u8"}), _field("pair", {"array": ["u32", 2]})]}},
        {"name": "Chosen", "type": {"kind": "struct", "fields": [_ID, _field("choice", {"defined": {"name": "Choice"}})]}},
        {"name": "Choice", "type": {"kind": "enum", "variants": [{"name": "click"}, {"name": "view"}, {"name": "purchase", "fields": [_field("amount", _U32)]}, {"name": "error", "fields": [_U32]}, {"name": "signup", "fields": [_U32, _U32]}]}},
        {"name": "Nested", "type": {"kind": "struct", "fields": [_ID, _field("inner", {"defined": "Inner"}), _field("flag", {"defined": {"name": "Flag"}})]}},
        {"name": "Inner", "type": {"kind": "struct", "fields": [_field("user", "i64"), _field("kind", "string")]}},
        {"name": "Flag", "type": {"kind": "struct", "fields": ["bool"]}},
        {"name": "Tail", "type": {"kind": "struct", "fields": [_ID, _field("user_id", "i64"), _field("value", "f64")]}},
        {"name": "Wide", "type": {"kind": "struct", "fields": [_ID, _field("big", "u128"), _field("neg", "i128")]}},
    ],
}
IDL = Idl.load(DESCRIPTION)


def _json(*columns: F.Column) -> F.Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _event(name: str):
    return next(i for i in IDL.events.values() if i.name == name)


def _decoded(df: DataFrame, name: str, json: F.Column, cut: F.Column | None = None, **options) -> DataFrame:
    """df with d, the decoded record, and p, its typed columns."""
    data = borsh.encode(json, IDL, name)
    df = df.withColumn("_data", data)
    if cut is not None:
        df = df.withColumn("_data", F.when(cut, F.expr("substring(_data, 1, length(_data) - 8)")).otherwise(F.col("_data")))
    df = df.withColumn("d", borsh.decode("_data", IDL, "events", **options))
    return df.withColumn("p", borsh.typed(F.col("d.data"), IDL.payload(_event(name))))


def _spread(df: DataFrame) -> DataFrame:
    """Rows in as many partitions as there are cores: the work on a row is far dearer than its bytes, by which files are split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _micros() -> F.Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def _events(spark, d) -> DataFrame:
    return _spread(table(spark, d, "events").select("event_id", "user_id", "event_type", "value", _micros().alias("ts")))


@register("SELECT event_id, user_id, event_type, value, epoch_us(ts) AS ts FROM events")
def borsh_event_roundtrip(spark, d):
    rows = _decoded(_events(spark, d), "Trade", _json(*map(F.col, ("event_id", "user_id", "event_type", "value", "ts"))))
    return rows.select(F.col("p.event_id").cast("long").alias("event_id"), "p.user_id", "p.event_type", "p.value", "p.ts")


@register("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS note, CASE WHEN event_id % 3 <> 0 THEN value END AS amount FROM events")
def borsh_option(spark, d):
    e = _events(spark, d)
    rows = _decoded(e, "Optional", _json(F.col("event_id"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("note"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("amount")))
    return rows.select(F.col("p.event_id").cast("long").alias("event_id"), "p.note", "p.amount")


@register("SELECT event_id, '[' || array_to_string(range(user_id % 4), ',') || ']' AS items, '[' || (event_id % 1000) || ',7]' AS pair FROM events")
def borsh_vec(spark, d):
    n = (F.col("user_id") % 4).cast("int")
    items = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = _decoded(_events(spark, d), "Listed", _json(F.col("event_id"), items.alias("items"), F.array((F.col("event_id") % 1000).cast("int"), F.lit(7)).alias("pair")))
    return rows.select(F.col("p.event_id").cast("long").alias("event_id"), "p.items", "p.pair")


@register("""SELECT event_id, CASE event_type WHEN 'purchase' THEN '{"variant":"purchase","amount":' || user_id || '}' WHEN 'error' THEN '{"variant":"error","value":' || user_id || '}' WHEN 'signup' THEN '{"variant":"signup","values":[' || user_id || ',' || event_id || ']}' ELSE event_type END AS choice FROM events""")
def borsh_enum(spark, d):
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    u, k = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    choice = F.when(F.col("event_type") == "purchase", F.concat(F.lit('{"variant":"purchase","amount":'), u, F.lit("}"))).when(F.col("event_type") == "error", F.concat(F.lit('{"variant":"error","value":'), u, F.lit("}"))).when(F.col("event_type") == "signup", F.concat(F.lit('{"variant":"signup","values":['), u, F.lit(","), k, F.lit("]}"))).otherwise(quoted(F.col("event_type")))
    rows = _decoded(_events(spark, d), "Chosen", F.concat(F.lit('{"event_id":'), k, F.lit(',"choice":'), choice, F.lit("}")))
    return rows.select(F.col("p.event_id").cast("long").alias("event_id"), "p.choice")


@register("""SELECT event_id, '{"user":' || user_id || ',"kind":"' || event_type || '"}' AS inner_json, value > 50 AS flag FROM events""")
def borsh_struct(spark, d):
    rows = _decoded(_events(spark, d), "Nested", _json(F.col("event_id"), F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("inner"), (F.col("value") > 50).alias("flag")))
    return rows.select(F.col("p.event_id").cast("long").alias("event_id"), F.col("p.inner").alias("inner_json"), "p.flag")


@register("SELECT event_id, user_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value, event_id % 3 = 0 AS is_legacy_fix FROM events")
def borsh_legacy_tail(spark, d):
    rows = _decoded(_events(spark, d), "Tail", _json(F.col("event_id"), F.col("user_id"), F.col("value")), cut=F.col("event_id") % 3 == 0, missing_tail=5)
    return rows.select(F.col("p.event_id").cast("long").alias("event_id"), "p.user_id", "p.value", F.col("d.short").alias("is_legacy_fix"))


@register("SELECT event_id, event_id + 9007199254740992 AS wide, event_id * 1000000007 || '' AS big, '-' || event_id AS neg FROM events WHERE event_id > 0")
def u64_wide(spark, d):
    e = _events(spark, d).where("event_id > 0")
    k = F.col("event_id")
    rows = _decoded(e, "Wide", _json((k + 9007199254740992).alias("event_id"), (k * 1000000007).cast("string").alias("big"), (-k).cast("string").alias("neg")))
    return rows.select("event_id", F.col("p.event_id").cast("long").alias("wide"), "p.big", "p.neg")


@register("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'event_cpi' ELSE 'event' END AS kind, user_id FROM events")
def cpi_event(spark, d):
    e = _events(spark, d)
    data = borsh.encode(_json(F.col("event_id"), F.col("user_id"), F.col("value")), IDL, "Tail")
    rows = e.select("event_id", data.alias("x")).withColumn("x", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(borsh.CPI_MARK), "x")).otherwise(F.col("x"))).withColumn("d", borsh.decode("x", IDL, "one"))
    return rows.select("event_id", "d.kind", borsh.typed(F.col("d.data"), IDL.payload(_event("Tail")))["user_id"].alias("user_id"))


def _lines(spark, d) -> DataFrame:
    return _spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"))


@register("SELECT l_orderkey AS orderkey, l_linenumber::BIGINT AS linenumber, l_suppkey AS suppkey, l_quantity AS quantity FROM lineitem")
def ix_decode(spark, d):
    li = _lines(spark, d).select(_json(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), F.col("l_suppkey").alias("suppkey"), F.col("l_quantity").alias("quantity")).alias("j"))
    text = li.select(codecs.to_base58(borsh.encode("j", IDL, "line", "instructions")).alias("b58"))
    rows = text.select(borsh.decode(codecs.from_base58("b58"), IDL, "instructions").alias("d"))
    p = rows.select(borsh.typed(F.col("d.data"), IDL.payload(next(i for i in IDL.instructions.values() if i.name == "line"))).alias("p"))
    return p.select(F.col("p.orderkey").cast("long").alias("orderkey"), "p.linenumber", "p.suppkey", "p.quantity")


@register("SELECT l_orderkey AS orderkey, 'line' AS name, l_suppkey AS suppkey FROM lineitem")
def ix_inline_json(spark, d):
    li = _lines(spark, d).select(_json(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), F.col("l_suppkey").alias("suppkey"), F.col("l_quantity").alias("quantity")).alias("j"))
    rows = li.select(borsh.decode(borsh.encode("j", IDL, "line", "instructions"), IDL, "instructions").alias("d"))
    inline = rows.select(F.concat(F.lit('{"name":"'), "d.name", F.lit('","args":'), "d.data", F.lit("}")).alias("data"))
    return inline.select(F.get_json_object("data", "$.args.orderkey").cast("long").alias("orderkey"), F.get_json_object("data", "$.name").alias("name"), F.get_json_object("data", "$.args.suppkey").cast("long").alias("suppkey"))


@register("SELECT n_name AS token_name, n_nationkey::BIGINT AS token_slot, 'r' || n_regionkey AS other FROM nation")
def reserved_rename(spark, d):
    n = table(spark, d, "nation").select(_json(F.col("n_name").alias("name"), F.col("n_nationkey").alias("slot"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("other")).alias("j"))
    item = next(i for i in IDL.instructions.values() if i.name == "create")
    p = n.select(borsh.typed(borsh.decode(borsh.encode("j", IDL, "create", "instructions"), IDL, "instructions")["data"], IDL.payload(item)).alias("p"))
    return p.select("p.token_name", F.col("p.token_slot").cast("long").alias("token_slot"), "p.other")


@register("SELECT * FROM (VALUES ('Trade', 5, 'event_id', 'decimal(20,0)'), ('Trade', 8, 'value', 'double'), ('Optional', 6, 'note', 'string'), ('Nested', 7, 'flag', 'boolean'), ('line', 6, 'linenumber', 'bigint'), ('create', 5, 'token_name', 'string'), ('create', 6, 'token_slot', 'decimal(20,0)')) t(item, place, name, type)")
def idl_schema(spark, d):
    rows = [(item, i, f.name, f.dataType.simpleString()) for item, s in IDL.schemas().items() for i, f in enumerate(s.fields)]
    picked = {("Trade", 5), ("Trade", 8), ("Optional", 6), ("Nested", 7), ("line", 6), ("create", 5), ("create", 6)}
    return spark.createDataFrame([r for r in rows if r[:2] in picked], "item string, place int, name string, type string")


# ---------------------------------------------------------------- codecs


@register("SELECT doc_id, true AS same FROM documents")
def base58_roundtrip(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    return t.select("doc_id", (codecs.from_base58(codecs.to_base58("b")) == F.col("b")).alias("same"))


@register("SELECT doc_id, true AS same, true AS rejects FROM documents")
def base64_strict(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    t = t.withColumn("c", codecs.to_base64("b"))
    rejects = codecs.from_base64(F.concat("c", F.lit("A"))).isNull() & codecs.from_base64(F.concat("c", F.lit(" ====")) ).isNull()
    return t.select("doc_id", (codecs.from_base64(F.col("c")) == F.col("b")).alias("same"), rejects.alias("rejects"))


@register("SELECT event_id, event_id * 1000003 AS value FROM events")
def varint_roundtrip(spark, d):
    return table(spark, d, "events").select("event_id", codecs.from_varint(codecs.to_varint(F.col("event_id") * 1000003)).alias("value"))


@register("SELECT doc_id, true AS agrees, false AS damaged_agrees FROM documents")
def crc64_check(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    check = F.arrow_udf(lambda b, c: pa.array([codecs.checksum_ok(x, y & 0xFFFFFFFFFFFFFFFF) for x, y in zip(b.to_pylist(), c.to_pylist(), strict=True)], pa.bool_()), "boolean")
    t = t.withColumn("crc", codecs.crc64_of("b"))
    return t.select("doc_id", check("b", "crc").alias("agrees"), check(F.concat("b", F.lit(b"\1")), F.col("crc")).alias("damaged_agrees"))


@register("SELECT l_orderkey, l_linenumber::BIGINT AS linenumber FROM lineitem")
def little_endian_native(spark, d):
    data = F.arrow_udf(lambda a, b: pa.array([struct.pack("<IH", x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.binary()), "binary")
    t = table(spark, d, "lineitem").select(data("l_orderkey", "l_linenumber").alias("x"))
    return t.select(codecs.little_endian(F.col("x"), 0, 4).alias("l_orderkey"), codecs.little_endian(F.col("x"), 4, 2).alias("linenumber"))


# ---------------------------------------------------------------- logs


def _user_logs(spark, d) -> DataFrame:
    """A log per user: each event's data inside program A, and inside B, which A calls, where its number is even; every seventh call of B fails."""
    e = _events(spark, d)
    data = borsh.encode(_json(F.col("event_id"), F.col("user_id"), F.col("value")), IDL, "Tail")
    e = e.withColumn("x", F.concat(F.lit("Program data: "), codecs.to_base64(data)))
    end = F.when(F.col("event_id") % 7 == 0, "Program B failed: custom error").otherwise("Program B success")
    lines = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("Program A invoke [1]"), F.lit("Program log: hello"), F.lit("Program B invoke [2]"), F.col("x"), F.lit("Program B consumed 100 of 200 compute units"), end, F.lit("Program A success"))).otherwise(F.array(F.lit("Program A invoke [1]"), F.col("x"), F.lit("Program A success")))
    return e.groupBy("user_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("event_id", lines.alias("l")))), lambda s: s["l"])).alias("logs"))


_LOG_SQL = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'A' END AS program_id, user_id FROM events"


def _from_logs(found: F.Column, logs_of: DataFrame) -> DataFrame:
    rows = logs_of.select(F.explode(found).alias("f")).select("f.program_id", borsh.decode("f.data", IDL, "events").alias("d"))
    rows = rows.select("program_id", borsh.typed(F.col("d.data"), IDL.payload(_event("Tail"))).alias("p"))
    return rows.select(F.col("p.event_id").cast("long").alias("event_id"), "program_id", "p.user_id")


@register(_LOG_SQL)
def log_events(spark, d):
    return _from_logs(logs.log_events("logs"), _user_logs(spark, d))


@register(_LOG_SQL)
def log_events_fast(spark, d):
    return _from_logs(logs.log_events_fast("logs"), _user_logs(spark, d))


@register("SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'log:' WHEN 2 THEN 'A' WHEN 3 THEN '' ELSE 'A' END AS program_id FROM events")
def log_stack_quirks(spark, d):
    e = _events(spark, d)
    data = borsh.encode(_json(F.col("event_id"), F.col("user_id"), F.col("value")), IDL, "Tail")
    line = F.concat(F.lit("Program data: "), codecs.to_base64(data))
    a = F.lit("Program A invoke [1]")
    case = F.col("event_id") % 5
    text = F.when(case == 0, F.array(a, F.lit("Program log: success at last"), F.col("x"))).when(case == 1, F.array(a, F.lit("Program log: invoke it"), F.col("x"))).when(case == 2, F.array(a, F.lit("Program B invoke [2]"), F.lit("Program B failed: no"), F.col("x"))).when(case == 3, F.array(F.lit("Program A success"), F.col("x"))).otherwise(F.array(a, F.lit("Program data: YQ YQ=="), F.lit("Program return: A AAAA"), F.col("x")))
    rows = e.withColumn("x", line).select(text.alias("logs"))
    return _from_logs(logs.log_events("logs"), rows).select("event_id", "program_id")


# ---------------------------------------------------------------- transactions


@lru_cache(1 << 16)
def _key(tag: str, n: int) -> bytes:
    return hashlib.sha256(f"{tag}{n}".encode()).digest()


def _bytes_of(k: int, c: int, p: float) -> tuple[bytes, bytes | None]:
    """Transaction and metadata of an order."""
    static = [_key("C", c), _key("P", k % 7), _key("X", k % 3)]
    body = struct.pack("<Q", k)
    odd = k % 2 == 1
    tx = transactions.build_transaction([body * 8], static, [(1, [0, 2], body), (2, [0], b"")], 0 if odd else None, [(_key("T", 0), [1], [])] if odd else [])
    if k % 11 == 0:
        return tx, None
    return tx, transactions.build_metadata(round(p), [p_ := round(p) * 10, 5, 7], [p_ - round(p), 5], [f"Program P{k % 7} invoke [1]"], [(0, [(3 if odd else 9, [0], body)])], None if k % 5 else b"\1\0\0\0", [(1, "M", "O", "1.5")], [(1, "M", "O", "2.5"), (2, "M", "", "3")], [_key("L", k % 4)] if odd else [])


def _transaction_bytes(orders: DataFrame) -> DataFrame:
    """slot, block_time, tx_data, meta_data of orders: odd ones are of the versioned layout with one loaded key, even ones of the old one; each has two outer and one inner instruction."""

    def build(keys: pa.Array, customers: pa.Array, prices: pa.Array) -> pa.Array:
        tx, meta = zip(*map(_bytes_of, keys.to_pylist(), customers.to_pylist(), prices.to_pylist()), strict=True) if len(keys) else ((), ())
        return pa.StructArray.from_arrays([pa.array(tx, pa.binary()), pa.array(meta, pa.binary())], ["tx_data", "meta_data"])

    made = F.arrow_udf(build, "tx_data binary, meta_data binary")
    return orders.select(F.col("o_orderkey").alias("slot"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("block_time"), made("o_orderkey", "o_custkey", "o_totalprice").alias("b")).select("slot", "block_time", "b.*")


def _tx(spark, d) -> DataFrame:
    return _transaction_bytes(_spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")))


@register("SELECT o_orderkey AS slot, 1 AS n_signatures, 3 AS n_keys, 2 AS n_instructions, o_orderkey % 2 = 1 AS versioned FROM orders")
def tx_decode(spark, d):
    rows = _tx(spark, d).select("slot", transactions.decode_transaction("tx_data").alias("t"))
    return rows.select("slot", F.size("t.signatures").alias("n_signatures"), F.size("t.keys").alias("n_keys"), F.size("t.instructions").alias("n_instructions"), F.col("t.version").isNotNull().alias("versioned"))


@register("SELECT o_orderkey AS slot, CASE WHEN o_orderkey % 11 <> 0 THEN round_even(o_totalprice, 0)::BIGINT END AS fee, CASE WHEN o_orderkey % 11 <> 0 THEN 3 END AS n_pre, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 5 = 0 THEN '01000000' END AS err, CASE WHEN o_orderkey % 11 <> 0 THEN 'Program P' || (o_orderkey % 7) || ' invoke [1]' END AS log FROM orders")
def meta_decode(spark, d):
    rows = _tx(spark, d).select("slot", transactions.decode_metadata("meta_data").alias("m"))
    return rows.select("slot", F.col("m.fee").cast("long").alias("fee"), F.when(F.col("m").isNotNull(), F.size("m.pre")).alias("n_pre"), "m.err", F.get("m.logs", F.lit(0)).alias("log"))


@register("SELECT o_orderkey AS slot, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 11 <> 0 THEN 4 ELSE 3 END AS n_accounts, CASE WHEN o_orderkey % 11 <> 0 THEN 2 ELSE 0 END AS n_balances, CASE WHEN o_orderkey % 11 <> 0 THEN -round_even(o_totalprice, 0)::BIGINT END AS delta, CASE WHEN o_orderkey % 11 <> 0 THEN round_even(o_totalprice, 0)::BIGINT ELSE 0 END AS fee FROM orders")
def keys_resolve(spark, d):
    r = transactions.records(_tx(spark, d))
    return r.select("slot", F.size("accounts").alias("n_accounts"), F.size("account_balance_deltas").alias("n_balances"), F.get("account_balance_deltas", F.lit(0))["delta"].alias("delta"), F.col("fee").cast("long").alias("fee"))


@register("SELECT o_orderkey AS slot, CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 3 END AS n, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 2 = 0 THEN 'UNKNOWN_PROGRAM_INDEX_9' END AS unknown, CASE WHEN o_orderkey % 11 = 0 THEN 2 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END AS n_programs, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'M::2:null:3|M:O:1:1.5:2.5' END AS tokens, o_orderkey AS first_data FROM orders")
def instr_extract(spark, d):
    r = transactions.records(_tx(spark, d))
    names = F.filter("instructions", lambda i: i["program_id"].startswith("UNKNOWN"))
    tokens = F.array_join(F.transform("token_balance_deltas", lambda t: F.concat_ws(":", t["mint"], t["owner"], t["account_index"].cast("string"), F.coalesce(t["pre_ui_amount"], F.lit("null")), t["post_ui_amount"])), "|")
    return r.select("slot", F.size("instructions").alias("n"), F.get(names, F.lit(0))["program_id"].alias("unknown"), F.size("program_ids").alias("n_programs"), tokens.alias("tokens"), codecs.little_endian(F.get("instructions", F.lit(0))["data"], 0, 7).alias("first_data"))


@register("SELECT o_orderkey AS slot FROM orders WHERE o_orderkey % 7 = 3")
def tx_program_filter(spark, d):
    return transactions.records(_tx(spark, d), [_key("P", 3)]).select("slot")


# ---------------------------------------------------------------- archives


#: Rows a part of an archive is written of, and the most parts.
PART_ROWS, PARTS = 25_000, 2_000


def _write_archive(spark, d, folder: str, damage: bool = False) -> str:
    """Transactions of the orders in blocks of a hundred keys, one entry a block, metadata of every thirteenth in frames; epoch and subset at the end. With damage twelve wrong bytes follow every fifth block.
    One file: ranges of blocks are written side by side, each by a task of its own, and then put into their places, side by side too. The driver sees a row a range."""
    os.makedirs(folder, exist_ok=True)
    block = F.expr("(o_orderkey - pmod(o_orderkey, 100)) div 100")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", block.alias("block"))
    n = max(1, min(PARTS, rows.count() // PART_ROWS))
    bounds = rows.select(F.percentile_approx("block", [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    n = len(bounds := sorted({*bounds})) + 1
    part = F.arrow_udf(lambda c: pa.array(np.searchsorted(bounds, c.to_numpy(zero_copy_only=False)), pa.int32()), "int")
    rows = rows.withColumn("part", part("block"))
    before = dict.fromkeys(range(n), 0)
    if damage:
        counts = dict(rows.select("part", "block").distinct().groupBy("part").count().collect())
        before = dict(enumerate(itertools.accumulate([counts.get(k, 0) for k in range(n)], initial=0)))
    rows = rows.repartitionById(n, "part").sortWithinPartitions("part", "o_orderkey")

    def write(batches):
        names = ("part", "block", "o_orderkey", "o_custkey", "o_totalprice")
        rows = itertools.chain.from_iterable(zip(*(b.column(c).to_pylist() for c in names), strict=True) for b in batches)
        for part, own in itertools.groupby(rows, lambda r: r[0]):
            path, first = f"{folder}/{part}-{uuid.uuid4().hex}.part", []
            with open(path, "wb", 1 << 20) as f:
                for k, (number, orders) in enumerate(itertools.groupby(own, lambda r: r[1]), before[part] + 1):
                    sections, cid = _block_sections(number, [r[2:] for r in orders])
                    f.write(sections + (b"\xff" * 12 if damage and k % 5 == 0 else b""))
                    if len(first) < 3:
                        first.append(cid)
                size = f.tell()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "size": size, "first": first, "last": number}], schema)

    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("size", pa.int64()), ("first", pa.list_(pa.binary())), ("last", pa.int64())])
    parts = sorted(rows.mapInArrow(write, "part int, path string, size long, first array<binary>, last long").collect())
    head = archive.archive([])
    ends = list(itertools.accumulate([r["size"] for r in parts], initial=len(head)))
    path = f"{folder}/epoch-7.car"
    subset = codecs.cbor_encode([archive.SUBSET, 0, parts[-1]["last"] if parts else 0, [codecs.Link(bytes(b)) for r in parts[:3] for b in r["first"]][:3]])
    with open(path, "wb") as f:
        f.write(head)
        f.seek(ends[-1])
        f.write(archive.section(subset) + archive.section(codecs.cbor_encode([archive.EPOCH, 7, [codecs.Link(archive.node_id(subset))]])))
    if parts:
        spark.sparkContext.parallelize([(r["path"], at) for r, at in zip(parts, ends, strict=False)], len(parts)).foreach(lambda x: _place(path, *x))
    return folder


def _place(path: str, part: str, at: int) -> None:
    """Puts a part of a file into its place, and takes it away; one that isn't there any more has been put there by an earlier attempt."""
    try:
        source = open(part, "rb")
    except FileNotFoundError:
        return
    with source, open(path, "r+b") as f:
        f.seek(at)
        shutil.copyfileobj(source, f, 4 << 20)
    os.remove(part)


def _block_sections(number: int, orders: list[tuple[int, int, float]]) -> tuple[bytes, bytes]:
    """Sections of the transactions of a block, its entry and itself; the block's content id."""
    out = []

    def put(node: list) -> bytes:
        payload = codecs.cbor_encode(node)
        out.append(archive.section(payload, cid := archive.node_id(payload)))
        return cid

    for n, (slot, customer, price) in enumerate(orders):
        tx, meta = _bytes_of(slot, customer, price)
        first, rest = archive.split_frames(meta or b"", 64 if slot % 13 == 0 else 1 << 20)
        for x in rest:
            put(x)
        put([archive.TRANSACTION, archive.frame(tx, checksum=codecs.crc64(tx)), first, slot, n])
    entry = put([archive.ENTRY, 1, b"\0" * 32, []])
    cid = put([archive.BLOCK, number, [[0, 0]], [codecs.Link(entry)], [max(number - 1, 0), 1_000_000 + number, None], codecs.Link(entry)])
    return b"".join(out), cid


_TX_ROWS = "SELECT o_orderkey AS slot, o_orderkey // 100 AS group_slot, 1000000 + o_orderkey // 100 AS block_time, CASE WHEN o_orderkey % 11 <> 0 THEN round_even(o_totalprice, 0)::BIGINT END AS fee FROM orders"


_TX_COLUMNS = ["kind", "slot", "block_time", "meta_data"]


def _tx_rows(nodes: DataFrame) -> DataFrame:
    tx = nodes.where("kind = 0").select("slot", F.col("block_time"), transactions.decode_metadata("meta_data", ("fee",)).alias("m"))
    return tx.select("slot", (F.col("block_time") - 1_000_000).alias("group_slot"), "block_time", F.col("m.fee").cast("long").alias("fee"))


def _local(spark, name: str) -> str:
    """A fresh folder that plain open() reaches: in the shared folder where that is one, as archives are read by offset."""
    path = scratch(spark, name)
    return path.removeprefix("file://") if path.startswith(("file:///", "/")) else tempfile.mkdtemp(prefix=name)


@register(_TX_ROWS)
def car_scan(spark, d):
    return _tx_rows(archive.read_archives(spark, _write_archive(spark, d, _local(spark, "car-")), columns=_TX_COLUMNS, splitBytes="262144"))


@register("SELECT kind, n FROM (VALUES (0::BIGINT, (SELECT count(*) FROM orders)), (1::BIGINT, (SELECT count(DISTINCT o_orderkey // 100) FROM orders)), (2::BIGINT, (SELECT count(DISTINCT o_orderkey // 100) FROM orders)), (3::BIGINT, 1::BIGINT), (4::BIGINT, 1::BIGINT)) t(kind, n)")
def car_nodes(spark, d):
    nodes = archive.read_archives(spark, _write_archive(spark, d, _local(spark, "car-")), columns=["file", "kind", "slot", "pos"], numbered=False, splitBytes="262144")
    return archive.inspect(nodes.where("kind <> 6")).groupBy(F.col("kind").cast("long").alias("kind")).agg(F.sum("nodes").alias("n"))


@register("SELECT DISTINCT o_orderkey // 100 AS slot, greatest(o_orderkey // 100 - 1, 0) AS parent_slot FROM orders")
def car_kind_pushdown(spark, d):
    return archive.read_archives(spark, _write_archive(spark, d, _local(spark, "car-")), columns=["kind", "slot", "parent_slot"]).where("kind = 2").select("slot", "parent_slot")


@register(_TX_ROWS)
def car_recover(spark, d):
    return _tx_rows(archive.read_archives(spark, _write_archive(spark, d, _local(spark, "car-"), damage=True), kinds=[0, 2, 6], columns=_TX_COLUMNS))


@register("SELECT doc_id, greatest((strlen(text) + 499) // 500, 1) AS n, md5(text) AS text_md5 FROM documents")
def frame_reassemble(spark, d):
    """Texts cut into linked frames, dealt out, and put together again by their links and checksums."""

    def cut(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first, rest = archive.split_frames((text or "").encode(), 500)
                out += [(doc, payload := codecs.cbor_encode(x), archive.node_id(payload), k) for k, x in enumerate([first, *rest])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.int32()), strict=True)], ["doc_id", "payload", "cid", "k"])

    def whole(table: pa.Table) -> pa.Table:
        nodes = {c: archive.parse_node(p) for c, p in zip(table.column("cid").to_pylist(), table.column("payload").to_pylist(), strict=True)}
        first = archive.parse_node(table.column("payload")[table.column("k").to_pylist().index(0)].as_py())
        return pa.table({"doc_id": table.column("doc_id")[:1], "n": pa.array([len(nodes)], pa.int64()), "data": pa.array([archive.reassemble(first, nodes)], pa.binary())})

    t = _spread(table(spark, d, "documents").select("doc_id", "text"))
    frames = t.mapInArrow(cut, "doc_id long, payload binary, cid binary, k int").repartition("k")
    rows = frames.groupBy("doc_id").applyInArrow(whole, "doc_id long, n long, data binary")
    return rows.select("doc_id", "n", F.md5("data").alias("text_md5"))


# ---------------------------------------------------------------- what older tools did


@register("SELECT o_orderkey AS slot, 'K' || o_custkey AS account, -(o_custkey % 5) AS lamports, o_orderkey AS after, o_orderkey % 4 AS kind, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey || '' END AS commission FROM orders WHERE o_orderkey % 13 <> 0")
def rewards_decode(spark, d):
    def build(keys: pa.Array, customers: pa.Array) -> pa.Array:
        import zstandard

        pack = zstandard.ZstdCompressor().compress
        return pa.array([b"\x0a\xff" if k % 13 == 0 else pack(transactions.build_rewards([(f"K{c}", -(c % 5), k, k % 4, str(c) if k % 3 == 0 else None)])) for k, c in zip(keys.to_pylist(), customers.to_pylist(), strict=True)], pa.binary())

    o = _spread(table(spark, d, "orders").select("o_orderkey", "o_custkey"))
    rows = o.select(F.col("o_orderkey").alias("slot"), transactions.decode_rewards(F.arrow_udf(build, "binary")("o_orderkey", "o_custkey")).alias("r")).where("r is not null")
    return rows.select("slot", F.inline("r")).select("slot", "account", "lamports", F.col("post_balance").cast("long").alias("after"), F.col("kind").cast("long").alias("kind"), "commission")


@register("SELECT count(*) AS transactions, count(*) FILTER (o_orderkey % 17 = 0) AS decode_errors, count(*) FILTER (o_orderkey % 17 <> 0 AND o_orderkey % 7 <> 3) AS metadata_skipped, count(*) FILTER (o_orderkey % 17 <> 0 AND o_orderkey % 7 = 3 AND o_orderkey % 19 = 0) AS metadata_errors, count(*) FILTER (o_orderkey % 17 <> 0 AND o_orderkey % 7 = 3 AND o_orderkey % 11 = 0 AND o_orderkey % 19 <> 0) AS metadata_missing, count(*) FILTER (o_orderkey % 17 <> 0 AND o_orderkey % 7 = 3) AS matching FROM orders")
def run_counters(spark, d):
    raw = _tx(spark, d).withColumn("tx_data", F.when(F.col("slot") % 17 == 0, F.lit(b"\xde\xad")).otherwise(F.col("tx_data"))).withColumn("meta_data", F.when(F.col("slot") % 19 == 0, F.lit(b"\xff\xff")).otherwise(F.col("meta_data")))
    return transactions.run_counters(raw, [_key("P", 3)])


@register("SELECT kind, n AS nodes, CASE WHEN kind = 0 THEN n END AS decode_ok FROM (VALUES (0::BIGINT, (SELECT count(*) FROM orders)), (2::BIGINT, (SELECT count(DISTINCT o_orderkey // 100) FROM orders))) t(kind, n)")
def node_counters(spark, d):
    nodes = archive.read_archives(spark, _write_archive(spark, d, _local(spark, "car-")), [0, 2], ["kind", "tx_data", "meta_data", "meta_error"], splitBytes="1048576")
    rows = archive.counters(nodes)
    return rows.select(F.col("kind").cast("long").alias("kind"), "nodes", F.when(F.col("kind") == 0, F.col("decode_ok")).alias("decode_ok"))


@register("SELECT group_id * 100 + row_number() OVER (PARTITION BY group_id ORDER BY slot) AS place, slot FROM (SELECT o_orderkey AS slot, dense_rank() OVER (ORDER BY o_orderkey // 100) - 1 AS group_id FROM orders)")
def ledger_order(spark, d):
    """Flat records with the columns that put them into the ledger's order."""
    nodes = archive.read_archives(spark, _write_archive(spark, d, _local(spark, "car-")), [0], ["kind", "file", "group_id", "pos", "tx_index", "slot", "block_time", "tx_data", "meta_data"], splitBytes="1048576").where("kind = 0")
    r = transactions.records(nodes)
    return r.select((F.col("group_id") * 100 + F.col("tx_index") + 1).alias("place"), "slot")


@register("SELECT event_id, '{\"event_id\":\"' || event_id || '\",\"user_id\":\"' || user_id || '\"}' AS data FROM events")
def older_values(spark, d):
    """64-bit numbers as text, as the first tools wrote them."""
    e = _events(spark, d)
    rows = e.select("event_id", borsh.decode(borsh.encode(_json(F.col("event_id"), F.col("user_id"), F.col("value")), IDL, "Tail"), IDL, "events", older=True).alias("d"))
    j = F.from_json(F.col("d.data"), "event_id string, user_id string")
    return rows.select("event_id", F.to_json(j).alias("data"))


@register("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS text FROM events")
def bytes_as_text(spark, d):
    e = _events(spark, d)
    data = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(b"\xff\xc0"), F.col("event_type").cast("binary"))).otherwise(F.col("event_type").cast("binary"))
    return e.select("event_id", codecs.text_if_valid(data).alias("text"))


@register("SELECT DISTINCT sha256('C' || c_custkey) AS key FROM customer WHERE c_custkey % 3 <> 0")
def wallet_targets(spark, d):
    from ..operators import instructions

    def names(keys: pa.Array) -> pa.Array:
        return pa.array([f"0{k}" if k % 3 == 0 else codecs.base58_encode(_key("C", k)) for k in keys.to_pylist()], pa.string())

    c = table(spark, d, "customer").select("c_custkey")
    twice = c.unionAll(c).select(F.arrow_udf(names, "string")("c_custkey").alias("wallet"))
    return instructions.wallet_targets(twice).select(F.lower(F.hex("key")).alias("key"))


@register("SELECT event_type AS name, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
def registered_description(spark, d):
    """A description's decoder as a function of SQL."""
    _, event = borsh.register_idl(spark, IDL, "trade")
    _events(spark, d).select(borsh.encode(_json(*map(F.col, ("event_id", "user_id", "event_type", "value", "ts"))), IDL, "Trade").alias("data")).createOrReplaceTempView("trade_payloads")
    rows = spark.sql(f"SELECT from_json({event}(data).data, 'event_type string, user_id long') AS p FROM trade_payloads")
    return rows.groupBy(F.col("p.event_type").alias("name")).agg(F.sum("p.user_id").alias("users"))


# ---------------------------------------------------------------- sinks, sources, streams

_RECORD_SQL = "SELECT o_orderkey AS slot, epoch(o_orderdate)::BIGINT AS block_time, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_ix, CASE WHEN o_orderstatus = 'F' THEN 'InstructionError' END AS err FROM orders"


def _round_trip(form: str):
    def query(spark, d):
        tx = relational.transactions(spark, d).select("slot", "block_time", "signatures", "fee", "err", "instructions")
        sinks.write(tx, path := scratch(spark, f"sink-{form}"), form)
        if form == "csv":
            schema = "slot long, block_time long, signatures string, fee long, err string, instructions string"
            back = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
            back = back.withColumn("instructions", F.from_json("instructions", tx.schema["instructions"].dataType))
        else:
            back = sinks.read(spark, path, tx.schema, form)
        return back.select("slot", "block_time", F.size("instructions").cast("long").alias("n_ix"), "err")

    return query


for _form, _name in (("parquet", "sink_parquet"), ("csv", "sink_csv"), ("jsonl", "sink_jsonl")):
    QUERIES[_name], ORACLES[_name] = _round_trip(_form), _RECORD_SQL


@register("SELECT event_type AS name, event_type AS folder, count(*) AS n FROM events GROUP BY ALL")
def sink_flat(spark, d):
    flat = table(spark, d, "events").select(F.col("event_id").alias("slot"), "user_id", F.col("event_type").alias("name"), "value")
    sinks.write_flat(flat, path := scratch(spark, "flat"))
    return spark.read.parquet(path).groupBy("name", F.col("name_part").cast("string").alias("folder")).agg(F.count("*").alias("n"))


@register("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def sink_partitioned(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    sinks.write(orders, path := scratch(spark, "parts"), "jsonl", partition_by=["o_orderstatus"])
    back = spark.read.schema("o_orderkey long, o_orderstatus string").json(path)
    return back.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@register("SELECT event_id, event_type AS name, user_id FROM events WHERE event_id % 10 <> 0")
def jsonl_malformed(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("name"))
    lines = e.select(F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(_json(F.col("event_id"), F.col("user_id"), F.col("name"))).alias("value"))
    lines.write.text(path := scratch(spark, "lines"))
    from pyspark.sql import types as T

    return sinks.read(spark, path, T.StructType().add("event_id", "long").add("user_id", "long").add("name", "string"), "jsonl").select("event_id", "name", "user_id")


@register("SELECT event_type AS name, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
def stream_available_now(spark, d):
    from ..streaming.incremental import run_available

    e = _events(spark, d)
    data = borsh.encode(_json(*map(F.col, ("event_id", "user_id", "event_type", "value", "ts"))), IDL, "Trade")
    e.select(data.alias("data")).write.parquet(source := scratch(spark, "stream-in"))
    out = run_available(spark, source, "data binary", lambda df: df.select(borsh.typed(borsh.decode("data", IDL, "events")["data"], IDL.payload(_event("Trade"))).alias("p")).select("p.*"), scratch(spark, "stream-out"), scratch(spark, "stream-state"))
    return out.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@register("SELECT l_orderkey AS slot, count(*) AS n, sum(l_suppkey)::BIGINT AS total FROM lineitem GROUP BY 1")
def decode_verb(spark, d):
    """The decode command on stored records: instructions from base58 to flat rows."""
    rows = ix_rows(spark, d, "l_linenumber", "l_suppkey", "l_quantity")
    j = _json(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), F.col("l_suppkey").alias("suppkey"), F.col("l_quantity").alias("quantity"))
    one = F.struct("ix", F.struct("program", codecs.to_base58(borsh.encode(j, IDL, "line", "instructions")).alias("data")).alias("i"))
    from .commands import decode_records

    rows = rows.withColumn("one", one)
    stored = rows.groupBy(F.col("l_orderkey").alias("slot")).agg(F.transform(F.array_sort(F.collect_list("one")), lambda x: F.struct(x["i"]["program"].alias("program_id"), x["i"]["data"].alias("data"))).alias("instructions"))
    stored = stored.select("slot", F.lit(None).cast("long").alias("block_time"), F.array(F.concat(F.lit("sig"), F.col("slot").cast("string"))).alias("signatures"), F.lit(None).cast("array<string>").alias("log_messages"), "instructions")
    flat = decode_records(stored, IDL, "instructions")["line"]
    return flat.groupBy("slot").agg(F.count("*").alias("n"), F.sum("suppkey").alias("total"))
