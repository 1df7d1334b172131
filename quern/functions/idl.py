"""Interface descriptions in JSON: both dialects, discriminators, and the Spark schemas they imply."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import types as T

RESERVED = ("slot", "block_time", "signature", "name", "program_id")
# fixed values: what a scalar type becomes
SCALARS: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0), "u128": T.StringType(),
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "i128": T.StringType(), "f32": T.FloatType(), "f64": T.DoubleType(),
    "pubkey": T.StringType(), "publicKey": T.StringType(), "string": T.StringType(), "bytes": T.StringType(),
}


class IdlError(ValueError):
    """A description that can't be read."""


@dataclass(frozen=True)
class Type:
    """kind: a scalar's name, or vec, option, array, defined; unknown names are kept and fail when a value is read."""

    kind: str
    inner: Type | None = None
    size: int = 0
    name: str = ""


@dataclass(frozen=True)
class Field:
    name: str
    type: Type


@dataclass(frozen=True)
class TypeDef:
    """fields: named, or `tuple_fields` types; variants: of an enum, each with one of these."""

    name: str
    kind: str
    fields: tuple[Field, ...] = ()
    tuple_fields: tuple[Type, ...] = ()
    variants: tuple[TypeDef, ...] = ()


@dataclass(frozen=True)
class Item:
    """An instruction or event: discriminator, named fields, and account names of an instruction."""

    name: str
    discriminator: bytes
    fields: tuple[Field, ...]
    accounts: tuple[str, ...] = ()
    #: An event's layout is the type of its name, unless it lists fields itself.
    defined: bool = False


def parse_type(raw: object) -> Type:
    if isinstance(raw, str):
        return Type(raw)
    if isinstance(raw, dict) and len(raw) == 1:
        (tag, body), = raw.items()
        if tag in ("vec", "option"):
            return Type(tag, parse_type(body))
        if tag == "array" and isinstance(body, list) and len(body) == 2 and isinstance(body[1], int):
            return Type(tag, parse_type(body[0]), size=body[1])
        if tag == "defined":
            return Type(tag, name=body if isinstance(body, str) else body["name"])
    raise IdlError(f"type {raw!r}")


def _layout(name: str, kind: str, fields: list | None) -> TypeDef:
    fields = fields or []
    if any(isinstance(f, dict) and "name" in f and "type" in f for f in fields):
        return TypeDef(name, kind, fields=tuple(Field(f["name"], parse_type(f["type"])) for f in fields))
    return TypeDef(name, kind, tuple_fields=tuple(parse_type(f) for f in fields))


def discriminator(namespace: str, name: str, explicit: list[int] | None = None) -> bytes:
    """Eight bytes: the explicit ones, or the start of a SHA-256."""
    if explicit is not None and len(explicit) >= 8:
        return bytes(explicit[:8])
    return hashlib.sha256(f"{namespace}:{name}".encode()).digest()[:8]


@dataclass
class Idl:
    types: dict[str, TypeDef] = field(default_factory=dict)
    instructions: dict[bytes, Item] = field(default_factory=dict)
    events: dict[bytes, Item] = field(default_factory=dict)
    address: str | None = None
    warnings: list[str] = field(default_factory=list)

    @staticmethod
    def load(source: str | dict | Path) -> Idl:
        """From a path, JSON text or a parsed object. Unknown scalar names are noted in `warnings`."""
        if isinstance(source, Path) or isinstance(source, str) and not source.lstrip().startswith("{"):
            source = Path(source).read_text()
        raw = json.loads(source) if isinstance(source, str) else source
        out = Idl(address=raw.get("address"))
        for t in raw.get("types") or []:
            body = t["type"]
            if body["kind"] == "enum":
                out.types[t["name"]] = TypeDef(t["name"], "enum", variants=tuple(_layout(v["name"], "variant", v.get("fields")) for v in body["variants"]))
            else:
                out.types[t["name"]] = _layout(t["name"], "struct", body.get("fields"))
        for i in raw.get("instructions") or []:
            d = discriminator("global", i["name"], i.get("discriminator"))
            out.instructions[d] = Item(i["name"], d, tuple(Field(a["name"], parse_type(a["type"])) for a in i.get("args") or []), tuple(a["name"] for a in i.get("accounts") or []))
        for e in raw.get("events") or []:
            d = discriminator("event", e["name"], e.get("discriminator"))
            inline = e.get("fields")
            fields = tuple(Field(f["name"], parse_type(f["type"])) for f in inline) if inline else out.types[e["name"]].fields if e["name"] in out.types else ()
            out.events[d] = Item(e["name"], d, fields, defined=not inline)
        for t in [x.type for i in [*out.instructions.values(), *out.events.values()] for x in i.fields]:
            while t.inner:
                t = t.inner
            if t.kind not in SCALARS and t.kind != "defined" or t.kind == "defined" and t.name not in out.types:
                out.warnings.append(f"unknown type {t.name or t.kind}")
        return out

    def column(self, t: Type) -> T.DataType:
        """Spark type of a top-level field: scalars as they are, one-field tuples as their field, everything else as JSON text."""
        if t.kind == "option":
            return self.column(t.inner)
        if t.kind == "defined" and (d := self.types.get(t.name)) and d.kind == "struct" and len(d.tuple_fields) == 1:
            return self.column(d.tuple_fields[0])
        return SCALARS.get(t.kind, T.StringType())

    def payload(self, item: Item) -> T.StructType:
        """Columns of an item's fields. Reserved names get `token_` before them; a name that is then taken gets a number behind it."""
        out, taken = T.StructType(), {f.name for f in item.fields if f.name not in RESERVED}
        for f in item.fields:
            name = column_name(f.name, taken)
            out.add(name, self.column(f.type), True)
        return out

    def schemas(self, mode: str = "both") -> dict[str, T.StructType]:
        """Flat table schemas by name: of events, of instructions, or of both, where an instruction's wins."""
        out = {}
        if mode in ("events", "both"):
            out |= {i.name: self.flat(i) for i in self.events.values() if not i.defined or i.name in self.types and self.types[i.name].fields}
        if mode in ("instructions", "both"):
            out |= {i.name: self.flat(i) for i in self.instructions.values()}
        return out

    def flat(self, item: Item) -> T.StructType:
        common = [T.StructField("slot", T.LongType(), False), T.StructField("block_time", T.LongType()), T.StructField("signature", T.StringType(), False), T.StructField("name", T.StringType(), False), T.StructField("program_id", T.StringType(), False)]
        return T.StructType([*common, *self.payload(item).fields])


def column_name(name: str, taken: set[str]) -> str:
    if name not in RESERVED:
        return name
    new, k = f"token_{name}", 2
    while new in taken:
        new, k = f"token_{name}_{k}", k + 1
    taken.add(new)
    return new
