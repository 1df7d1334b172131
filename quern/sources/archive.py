"""Content-addressed ledger archives as a Spark data source.

An archive is a header and a sequence of length-prefixed sections: a content id and a CBOR node. Nodes up to and including a block node are one group;
links point into the group only. Planning looks at the sizes of files alone: a file is cut by bytes, and each task finds the first sound section of its range by itself.
A group belongs to the range in which the block before it begins, so ranges fit together without an index; a task holds one group at a time.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("car").option("mode", "PERMISSIVE").load("/archives/*.car").where("kind in (0, 2)")
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from . import files
from ..functions.codecs import Link, Malformed, cbor_decode, cbor_encode, checksum_ok, crc64, varint_decode, varint_encode

# fixed values: node kinds by their number
KINDS = ("transaction", "entry", "block", "subset", "epoch", "rewards", "frame")
TRANSACTION, ENTRY, BLOCK, SUBSET, EPOCH, REWARDS, FRAME = range(7)
# fixed values: largest header and section, and how far a reader looks for the next section after a damaged one
HEADER_MOST, SECTION_MOST, SEARCH = 1024, 32 << 20, 1 << 20
#: Bytes of a range by default, and how many ranges there are before smaller ones grow to that.
SPLIT, RANGES = 128 << 20, 200
SCHEMA = """file string, group_id long, pos long, cid binary, kind int, slot long, payload binary,
tx_index long, tx_data binary, meta_data binary, meta_error string, num_hashes long, hash binary, links array<binary>,
parent_slot long, block_time long, block_height long, first long, last long, epoch long,
frame_hash decimal(20,0), frame_index long, frame_total long, frame_data binary"""

_KINDS_OF = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "decimal(20,0)": pa.decimal128(20, 0)}
_ARROW = pa.schema([(f.split()[0], _KINDS_OF[f.split()[1]]) for f in SCHEMA.replace("\n", " ").split(", ")])


# ---------------------------------------------------------------- bytes


def content_id(data: bytes, at: int) -> int:
    """Place after the content id that starts at `at`."""
    if data[at : at + 2] == b"\x12\x20":
        return at + 34
    for _ in range(3):  # version, codec, hash function
        _, at = varint_decode(data, at)
    size, at = varint_decode(data, at)
    if at + size > len(data):
        raise Malformed("content id ends early")
    return at + size


def peek_kind(payload: bytes) -> int | None:
    """Kind of a node without parsing it: a CBOR array whose first item is a small integer."""
    if len(payload) >= 2 and payload[0] & 0xE0 == 0x80 and payload[1] < 24:
        return payload[1]
    return None


@dataclass
class Section:
    at: int
    end: int
    cid: bytes
    payload: bytes


def sections(data, at: int, end: int, permissive: bool = True) -> Iterator[Section]:
    """Sections in data[at:end]. Permissive: a damaged head is stepped over to the next plausible one nearby, and a cut-off end is the end."""
    while at < end:
        try:
            size, body = varint_decode(data[at : at + 10])
            body += at
            if not 0 < size <= SECTION_MOST:
                raise Malformed("section size")
            if body + size > end:
                if permissive and plausible_end(data, at, end):
                    return
                raise Malformed("section ends early")
            raw = bytes(data[body : body + size])
            cut = content_id(raw, 0)
        except Malformed:
            if not permissive:
                raise
            at = resume(data, at + 1, end)
            if at is None:
                return
            continue
        yield Section(at, body + size, raw[:cut], raw[cut:])
        at = body + size


def plausible_end(data, at: int, end: int) -> bool:
    """Whether what is left looks like the start of a section, so that the file was cut off."""
    try:
        size, body = varint_decode(data[at : at + 10])
    except Malformed:
        return True
    return 0 < size <= SECTION_MOST and at + body < end and data[at + body] <= 1


def _head(data, at: int, end: int) -> int | None:
    """End of the section that starts here by its size, if that fits and a content id's first byte follows."""
    try:
        size, body = varint_decode(data[at : at + 10])
    except Malformed:
        return None
    return at + body + size if 0 < size <= SECTION_MOST and at + body + size <= end and data[at + body] <= 1 else None


def _sound(data, at: int, end: int) -> bool:
    """Whether a section with a SHA-256 content id starts here."""
    if _head(data, at, end) is None:
        return False
    _, body = varint_decode(data[at : at + 10])
    start = bytes(data[at + body : at + body + 4])
    return start[:2] == b"\x12\x20" or start[:1] == b"\x01" and start[2:] == b"\x12\x20"


def _verified(data, at: int, end: int) -> bool:
    """Whether the section that starts here agrees with its SHA-256 content id."""
    if not _sound(data, at, end):
        return False
    _, body = varint_decode(data[at : at + 10])
    after, cid = _head(data, at, end), at + body + (2 if data[at + body] else 0)
    return after >= cid + 34 and hashlib.sha256(data[cid + 34 : after]).digest() == data[cid + 2 : cid + 34]


def _starts(data, at: int, upto: int, end: int) -> Iterator[int]:
    """Places from `at` on of sections with a SHA-256 content id, by the id's fixed bytes before `upto`; of those with the same id the one with the shortest size comes first."""
    mark = at
    while (mark := data.find(b"\x12\x20", mark, upto)) >= 0:
        for body in (mark, mark - 2):
            for width in range(1, 6):
                place = body - width
                if place >= at and _sound(data, place, end) and varint_decode(data[place : place + 10])[1] == width:
                    yield place
        mark += 1


def resume(data, at: int, end: int) -> int | None:
    """The next place within SEARCH bytes where a section could start. The tail of a damaged size and a sound one together can look like a size too, and end at a sound section by chance;
    so the first section that agrees with its content id is certain, and before it only places are believed whose section ends there or at a sound one in between.
    Without a certain one, a place that the end or a sound section follows is believed before others."""
    upto = min(end, at + SEARCH)
    sure = next((p for p in _starts(data, at, min(end, upto + 8), end) if p < upto and _verified(data, p, end)), None)
    weak = None
    for place in range(at, upto if sure is None else sure):
        if (after := _head(data, place, end)) is None or sure is not None and after > sure:
            continue
        if after in (end, sure) or _sound(data, after, end):
            return place
        weak = place if weak is None else weak
    return weak if sure is None else sure


def first_sound(data, at: int, end: int) -> int | None:
    """The first place from `at` on where a section with a SHA-256 content id starts that it agrees with, or that another one or the end follows. Found by the content id's fixed bytes, so a section of any size is skipped fast."""
    for place in _starts(data, at, end, end):
        after = _head(data, place, end)
        if after == end or _sound(data, after, end) or _verified(data, place, end):
            return place
    return None


def header_end(data) -> int:
    size, at = varint_decode(data[:10])
    if not 0 < size <= HEADER_MOST:
        raise Malformed("header size")
    return at + size


# ---------------------------------------------------------------- nodes


def _int(x: object) -> int | None:
    if x is None:
        return None
    if not isinstance(x, int):
        raise Malformed("integer expected")
    return x & 0xFFFFFFFFFFFFFFFF


def _signed(x: int | None) -> int | None:
    """As a Spark long; null beyond it."""
    return x if x is None or x < 1 << 63 else None


def parse_frame(items: list) -> dict:
    if not isinstance(items, list) or not 5 <= len(items) <= 6 or items[0] != FRAME or not isinstance(items[4], bytes):
        raise Malformed("frame")
    links = items[5] if len(items) > 5 and items[5] is not None else []
    return {"hash": _int(items[1]), "index": _int(items[2]), "total": _int(items[3]), "data": items[4], "next": list(links)}


#: Least and most items of each kind's array.
_SIZES = {TRANSACTION: (4, 5), ENTRY: (3, 4), BLOCK: (5, 6), SUBSET: (3, 4), EPOCH: (2, 3), REWARDS: (3, 3), FRAME: (5, 6)}


def parse_node(payload: bytes) -> dict:
    """kind and fields of a node."""
    items, _ = cbor_decode(payload)
    if not isinstance(items, list) or not items or items[0] not in _SIZES:
        raise Malformed("node kind")
    kind = items[0]
    least, most = _SIZES[kind]
    if not least <= len(items) <= most:
        raise Malformed("node size")
    items = items + [None] * (most - len(items))
    if kind == TRANSACTION:
        return {"kind": kind, "data": parse_frame(items[1]), "metadata": parse_frame(items[2]), "slot": _int(items[3]), "index": _int(items[4])}
    if kind == ENTRY:
        return {"kind": kind, "num_hashes": _int(items[1]), "hash": items[2], "links": items[3] or []}
    if kind == BLOCK:
        meta = (items[4] or []) + [None] * 3
        return {"kind": kind, "slot": _int(items[1]), "shredding": items[2] or [], "links": items[3] or [], "parent_slot": _int(meta[0]), "block_time": _int(meta[1]), "block_height": _int(meta[2]), "rewards": items[5]}
    if kind == SUBSET:
        return {"kind": kind, "first": _int(items[1]), "last": _int(items[2]), "links": items[3] or []}
    if kind == EPOCH:
        return {"kind": kind, "epoch": _int(items[1]), "links": items[2] or []}
    if kind == REWARDS:
        return {"kind": kind, "slot": _int(items[1]), "data": parse_frame(items[2])}
    return {"kind": kind, **parse_frame(items)}


def reassemble(first: dict, nodes: dict[bytes, dict]) -> bytes:
    """Bytes of data cut into `total` frames: those that are linked from the first on, each at the place its index says, checked. With a total of none or 1 the first frame is all, whatever it links to."""
    total = first["total"] or 1
    found = [first]
    for f in found if total > 1 else ():
        linked = [nodes.get(x) for x in f["next"]]
        if None in linked:
            raise Malformed("a frame is missing")
        found += linked
        if len(found) > total:
            break
    if len(found) != total and total > 1:
        raise Malformed("number of frames")
    data = b"".join(f["data"] for f in sorted(found, key=lambda f: f["index"] or 0))
    if not checksum_ok(data, first["hash"]):
        raise Malformed("checksum")
    return data


# ---------------------------------------------------------------- source


class Range(InputPartition):
    """Groups of a file whose preceding block begins in [start, end), and the first group if start is 0; group and pos: how many there are before, or None for places in bytes."""

    def __init__(self, path: str, start: int, end: int, base: tuple[int, int] | None = None) -> None:
        super().__init__(None)
        self.path, self.start, self.end, self.base = path, start, end, base


def ranges(path: str, size: int, target: int, bases: dict | None = None) -> list[Range]:
    """Cuts a file of `size` bytes, of which nothing is read."""
    cuts = [*range(0, max(size - target // 2, 1), target), size] if size else []
    return [Range(path, a, b, None if bases is None else tuple(bases[f"{path}:{a}"])) for a, b in itertools.pairwise(cuts)]


def _parses(payload: bytes) -> bool:
    try:
        parse_node(payload)
    except Malformed:
        return False
    return True


@dataclass
class Wanted:
    """What a reader gives: kinds (None: all), columns, and whether transactions that hold none of `keys` are left out before their frames are put together."""

    kinds: set[int] | None = None
    columns: tuple[str, ...] = tuple(_ARROW.names)
    keys: tuple[bytes, ...] = ()
    permissive: bool = True
    whole_data: bool = False

    @property
    def frames(self) -> bool:
        return (self.kinds is None or bool(self.kinds & {TRANSACTION, REWARDS})) and bool({"meta_data", "meta_error", *(["tx_data"] if self.whole_data else [])} & {*self.columns})


def _row(place: tuple, s: Section, kind: int | None, n: dict, resolve: dict, block_time: int | None, want: Wanted) -> dict:
    path, group, pos = place
    row = {"file": path, "group_id": group, "pos": pos, "cid": s.cid, "kind": kind, "slot": _signed(n.get("slot")), "payload": s.payload, "num_hashes": _signed(n.get("num_hashes")), "links": [bytes(x) for x in n.get("links", n.get("next", []))], "block_time": block_time}
    if kind != TRANSACTION:
        row |= {k: _signed(n.get(k)) for k in ("parent_slot", "block_height", "first", "last", "epoch")}
    if kind == TRANSACTION:
        row |= {"tx_index": _signed(n["index"]), "tx_data": n["data"]["data"]}
        if want.frames:
            try:
                if want.whole_data:
                    row["tx_data"] = reassemble(n["data"], resolve)
                row["meta_data"] = reassemble(n["metadata"], resolve) or None
            except Malformed as e:
                row["meta_error"] = str(e)
    elif kind == REWARDS and want.frames:
        try:
            row["meta_data"] = reassemble(n["data"], resolve) or None
        except Malformed as e:
            row["meta_error"] = str(e)
    elif kind == ENTRY:
        row["hash"] = n["hash"]
    elif kind == BLOCK:
        row["block_time"] = _signed(n["block_time"])
    elif kind == FRAME:
        row |= {"frame_hash": n["hash"], "frame_index": _signed(n["index"]), "frame_total": _signed(n["total"]), "frame_data": n["data"]}
    return row


def _groups(data, r: Range, permissive: bool) -> Iterator[tuple[int, Iterator[tuple[Section, int | None, dict | None]]]]:
    """Sections of the range's own groups with their kind and, for blocks, the node; the second item is whether the group ends with it."""
    size = len(data)
    if r.start:
        at, own = first_sound(data, r.start, size), False
    else:
        at, own = header_end(data), True
    if at is None:
        return
    for s in sections(data, at, size, permissive):
        kind = peek_kind(s.payload)
        block = None
        if kind == BLOCK:
            try:
                block = parse_node(s.payload)
            except Malformed:
                if not permissive:
                    raise
        if not own and s.at >= r.end:
            return
        if own:
            yield s, kind, block
        if block is not None:
            own = r.start <= s.at < r.end
            if not own and s.at >= r.end:
                return


def read_range(r: Range, want: Wanted) -> Iterator[dict]:
    """Rows of a range. block_time of a transaction is that of its group's block; metadata frames are put together within the group, after the look for keys."""
    with files.opened(r.path) as data:
        held: dict[bytes, tuple] = {}
        group, pos = r.base or (None, 0)
        name = r.path.rsplit("/", 1)[-1]

        def flush() -> Iterator[dict]:
            nodes = {cid: n for cid, (_, _, k, n) in held.items() if k == FRAME}
            time = next((_signed(n["block_time"]) for _, _, k, n in held.values() if k == BLOCK), None)
            for p, s, k, n in held.values():
                if want.kinds is not None and k not in want.kinds:
                    continue
                # a key that a transaction names itself stands in its bytes; what only looks like one is sorted out later
                if k == TRANSACTION and want.keys and not any(x in n["data"]["data"] for x in want.keys):
                    continue
                yield _row((name, group, p), s, k, n, nodes, time, want)
            held.clear()

        for s, kind, node in _groups(data, r, want.permissive):
            pos += 1
            if group is None:
                group = s.at
            # blocks end groups; frames are looked up; other kinds that nobody asks for aren't parsed
            if node is not None or want.kinds is None or kind in want.kinds or kind == FRAME and want.frames:
                try:
                    node = node or parse_node(s.payload)
                except Malformed:
                    if not want.permissive:
                        raise
                    continue
                held[s.cid] = (held[s.cid][0] if s.cid in held else s.at if r.base is None else pos, s, node["kind"], node)
                if node["kind"] == BLOCK:
                    yield from flush()
                    group = None if r.base is None else group + 1
        yield from flush()


def _count(r: Range, permissive: bool) -> tuple[int, int]:
    """Blocks that end groups of the range, and its sections."""
    blocks = nodes = 0
    with files.opened(r.path) as data:
        for _, _, block in _groups(data, r, permissive):
            nodes += 1
            blocks += block is not None
    return blocks, nodes


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = files.listed(options.get("path", ""), ".car")
        # small ranges grow where there would be very many: each is a task, and a row of the job that counts
        self.target = max(256, int(options.get("splitbytes", SPLIT)), min(SPLIT, sum(n for _, n in self.paths) // RANGES))
        self.counts = options.get("counts", "false").lower() == "true"
        self.bases = json.loads(options["bases"]) if options.get("bases") else None
        self.want = Wanted(
            {int(k) for k in options["kinds"].split(",")} if options.get("kinds") else None, tuple(options["columns"].split(",")) if options.get("columns") else tuple(_ARROW.names),
            tuple(bytes.fromhex(k) for k in options["keys"].split(",")) if options.get("keys") else (), options.get("mode", "PERMISSIVE").upper() != "FAILFAST", options.get("reassembletxdata", "false").lower() == "true",
        )

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("kind",) and not self.counts:
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.want.kinds = found if self.want.kinds is None else self.want.kinds & found
            yield f  # Spark checks again: a pushed filter only spares parsing

    def partitions(self):
        return [r for p, n in self.paths for r in ranges(p, n, self.target, self.bases)] or [Range("", 0, 0)]

    def __getstate__(self):
        # what only planning needs isn't sent to each task
        return self.__dict__ | {"paths": None, "bases": None}

    def read(self, partition):
        if not partition.path:
            return
        if self.counts:
            yield pa.RecordBatch.from_pylist([dict(zip(_COUNTS.names, (f"{partition.path}:{partition.start}", *_count(partition, self.want.permissive)), strict=True))], _COUNTS)
            return
        rows, schema = read_range(partition, self.want), pa.schema([_ARROW.field(c) for c in self.want.columns])
        while some := list(itertools.islice(rows, 2048)):
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in some], f.type) for f in schema], schema=schema)


_COUNTS = pa.schema([("range", pa.string()), ("blocks", pa.int64()), ("nodes", pa.int64())])


class ArchiveSource(DataSource):
    """Options: mode PERMISSIVE (default: damaged nodes are left out) or FAILFAST; kinds, numbers to read; columns to give; keys, in hex, of which a transaction must hold one; splitBytes;
    reassembleTxData; bases and counts, as read_archives() uses them. Without bases group_id and pos are places in bytes, which ascend as counts do."""

    @classmethod
    def name(cls) -> str:
        return "car"

    def schema(self) -> str:
        options = {k.lower(): v for k, v in self.options.items()}
        if options.get("counts", "false").lower() == "true":
            return "range string, blocks long, nodes long"
        fields = {f.split()[0]: f for f in SCHEMA.replace("\n", " ").split(", ")}
        return ", ".join(fields[c] for c in options["columns"].split(",")) if options.get("columns") else SCHEMA

    def reader(self, schema) -> ArchiveReader:
        options = {k.lower(): v for k, v in self.options.items()}
        # Spark sends this object to each task, too
        self.options = {k: v for k, v in options.items() if k != "bases"}
        return ArchiveReader(options)


def read_archives(spark: SparkSession, path: str, kinds: list[int] | None = None, columns: list[str] | None = None, keys: list[bytes] | None = None, numbered: bool = True, **options: str) -> DataFrame:
    """Nodes of archives. Where group_id or pos is asked for, and `numbered`, a first job counts the blocks and sections of each range, and both are numbers within the file."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("car").options(**options)
    if numbered and (columns is None or {"group_id", "pos"} & {*columns}):
        own = [(*r["range"].rsplit(":", 1), r.blocks, r.nodes) for r in spark.read.format("car").options(**options, counts="true").load(path).collect()]
        bases: dict[str, tuple[int, int]] = {}
        for _, file in itertools.groupby(sorted((p, int(at), b, n) for p, at, b, n in own), key=lambda x: x[0]):
            group = pos = 0
            for p, at, b, n in file:
                bases[f"{p}:{at}"] = (group, pos)
                group, pos = group + b, pos + n
        reader = reader.option("bases", json.dumps(bases))
    for name, value in (("kinds", ",".join(map(str, kinds or ()))), ("columns", ",".join(columns or ())), ("keys", ",".join(k.hex() for k in keys or ()))):
        reader = reader.option(name, value) if value else reader
    return reader.load(path)


# ---------------------------------------------------------------- writer


def node_id(payload: bytes) -> bytes:
    return b"\x01\x71\x12\x20" + hashlib.sha256(payload).digest()


def frame(data: bytes, index: int | None = None, total: int | None = None, checksum: int | None = None, links: list[bytes] = ()) -> list:
    return [FRAME, checksum, index, total, data, [Link(x) for x in links]]


def section(payload: bytes, cid: bytes | None = None) -> bytes:
    body = (cid or node_id(payload)) + payload
    return varint_encode(len(body)) + body


def archive(nodes: list[list]) -> bytes:
    """An archive of nodes given as CBOR arrays."""
    head = cbor_encode({"version": 1, "roots": []})
    return varint_encode(len(head)) + head + b"".join(section(cbor_encode(n)) for n in nodes)


def split_frames(data: bytes, size: int) -> tuple[list, list[list]]:
    """The first frame of data cut into pieces of `size` bytes, and the frames it links to, which belong before it in the archive."""
    pieces = [data[i : i + size] for i in range(0, len(data), size)] or [b""]
    if len(pieces) == 1:
        return frame(data, checksum=crc64(data)), []
    rest = [frame(p, i, len(pieces)) for i, p in enumerate(pieces)][1:]
    return frame(pieces[0], 0, len(pieces), crc64(data), [node_id(cbor_encode(f)) for f in rest]), rest


# ---------------------------------------------------------------- relational forms


def block_groups(nodes: DataFrame) -> DataFrame:
    """group_id and block time of nodes (file, pos, kind, block_time) that have lost them: blocks before a node in its file, and the first block of its group."""
    from pyspark.sql import Window

    before = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    grouped = nodes.withColumn("group_id", F.coalesce(F.sum(F.when(F.col("kind") == BLOCK, 1).otherwise(0)).over(before), F.lit(0)))
    own = Window.partitionBy("file", "group_id")
    return grouped.withColumn("group_time", F.first(F.when(F.col("kind") == BLOCK, F.col("block_time")), ignorenulls=True).over(own))


def counters(nodes: DataFrame) -> DataFrame:
    """(kind, nodes, decode_ok, decode_errors): of transactions (their metadata, if there is any) and rewards, how many can be read. Needs kind, tx_data, meta_data, meta_error."""
    from ..functions import transactions

    tx, reward = F.col("kind") == TRANSACTION, F.col("kind") == REWARDS
    some = F.col("meta_data").isNotNull()
    meta = transactions.decode_metadata(F.when(tx, F.col("meta_data")), ("fee",))
    ok = F.when(tx, transactions.decode_transaction(F.when(tx, F.col("tx_data"))).isNotNull() & F.col("meta_error").isNull() & (~some | meta.isNotNull())).when(reward, F.col("meta_error").isNull() & (~some | transactions.decode_rewards(F.when(reward, F.col("meta_data"))).isNotNull()))
    return nodes.withColumn("_ok", ok).groupBy("kind").agg(F.count("*").alias("nodes"), F.count_if(F.col("_ok")).alias("decode_ok"), F.count_if(~F.col("_ok")).alias("decode_errors"))


def inspect(nodes: DataFrame) -> DataFrame:
    """Nodes by kind, and the first and last slot in file order of the blocks."""
    return nodes.groupBy("file", "kind").agg(F.count("*").alias("nodes"), F.min_by("slot", "pos").alias("first_slot"), F.max_by("slot", "pos").alias("last_slot"))
