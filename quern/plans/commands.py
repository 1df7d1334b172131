"""The commands: ingest archives, decode stored records, inspect an archive, count its nodes, and search the payers of wallets.

    python -m quern.plans.commands ingest --input '/archives/epoch-*.car' --program KEY --extract raw --output out
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import borsh, codecs, logs, transactions
from ..functions.idl import Idl
from ..operators import balances
from ..sources import archive, files
from . import sinks
from .scratch import scratch

#: Columns of stored records that decoding and searching read.
RECORDS = "slot long, block_time long, signatures array<string>, accounts array<string>, log_messages array<string>, err string, account_balance_deltas array<struct<account:string,pre_amount:decimal(20,0),post_amount:decimal(20,0),delta:long>>, instructions array<struct<program_id:string,data:string,accounts:array<string>>>"
MODES = ("raw", "events", "instructions", "both")


def targets(text: str) -> list[bytes]:
    """Program keys from a comma-separated list; an error if none or one isn't base58 of 32 bytes."""
    keys = [codecs.base58_decode(x.strip()) for x in text.split(",") if x.strip()]
    if not keys or any(k is None or len(k) != 32 for k in keys):
        raise ValueError(f"no program keys in {text!r}")
    return keys


def ingest(spark: SparkSession, path: str, programs: list[bytes] | None = None, strict_lookup: bool = False, **options: str) -> DataFrame:
    """Transaction records of archives. Only transaction, block and frame nodes are parsed; filter, decode and map follow in one stage, nothing is shuffled."""
    keys = programs if programs and not strict_lookup else None
    nodes = archive.read_archives(spark, path, [archive.TRANSACTION], ["kind", "slot", "block_time", "tx_data", "meta_data"], keys, **options).where("kind = 0")
    return transactions.records(nodes.select("slot", "block_time", "tx_data", "meta_data"), programs, strict_lookup)


def with_text_data(records: DataFrame) -> DataFrame:
    """Instruction data as base58, as records are stored."""
    import pyarrow as pa

    kind = records.schema["instructions"].dataType.elementType
    if kind["data"].dataType.simpleString() == "string":
        return records
    text = F.arrow_udf(lambda c: pa.array([None if x is None else codecs.base58_encode_all(x) for x in c.to_pylist()], pa.list_(pa.string())), "array<string>")
    rows = records.withColumn("_d", text(F.transform("instructions", lambda i: i["data"])))
    return rows.withColumn("instructions", F.zip_with("instructions", "_d", lambda i, t: F.struct(i["program_id"].alias("program_id"), t.alias("data"), i["accounts"].alias("accounts")))).drop("_d")


def _items(records: DataFrame, mode: str) -> DataFrame:
    """(slot, block_time, signature, program_id, data) of what can be decoded."""
    common = ["slot", "block_time", F.get("signatures", F.lit(0)).alias("signature")]
    if mode == "events":
        return records.select(*common, F.explode(logs.log_events_fast("log_messages")).alias("e")).select("slot", "block_time", "signature", "e.program_id", "e.data")
    rows = records.select(*common, F.explode("instructions").alias("i")).select("slot", "block_time", "signature", "i.program_id", "i.data")
    return rows if dict(rows.dtypes)["data"] == "binary" else rows.withColumn("data", codecs.from_base58("data"))


def decode_records(records: DataFrame, idl: Idl, mode: str = "both", missing_tail: int = 0, programs: list[str] | None = None) -> dict[str, DataFrame]:
    """Flat tables by name of the events or instructions in records; all columns of a payload are nullable. One decode a row, then a filter by name."""
    out = {}
    for kind in ("events", "instructions") if mode == "both" else (mode,):
        items = _items(records, kind)
        if programs:
            items = items.where(F.col("program_id").isin(programs))
        found = items.withColumn("d", borsh.decode("data", idl, kind, missing_tail)).where("d is not null")
        for item in (idl.events if kind == "events" else idl.instructions).values():
            schema = idl.payload(item)
            own = found.where(F.col("d.name") == item.name).withColumn("p", borsh.typed(F.col("d.data"), schema))
            out[item.name] = own.select("slot", "block_time", "signature", F.col("d.name").alias("name"), "program_id", *[F.col(f"p.`{f.name}`").alias(f.name) for f in schema.fields])
    return out


def decode_lines(records: DataFrame, idl: Idl, mode: str) -> DataFrame:
    """All records of a mode in one table, payload as JSON: one pass whatever the number of names, for a sink that splits by name."""
    parts = [_items(records, kind).withColumn("d", borsh.decode("data", idl, kind)).where("d is not null").select("slot", "block_time", "signature", F.col("d.name").alias("name"), "program_id", F.col("d.data").alias("data")) for kind in (("events", "instructions") if mode == "both" else (mode,))]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def write_decoded(records: DataFrame, idl: Idl, mode: str, output: str, form: str = "parquet") -> list[str]:
    """The flat tables of decode_records() as folders of `output`, one per name that occurs; the names. The records are read and decoded once a kind: the lines go to scratch by name, and each name's are given its columns."""
    spark = records.sparkSession
    sinks.write(decode_lines(records, idl, mode).withColumn("part", F.col("name")), path := scratch(spark, "lines"), partition_by=["part"])
    found = {r.part for r in spark.read.parquet(path).select(F.col("part").cast("string")).distinct().collect()} if files_in(spark, path) else set()
    items = [*(idl.events.values() if mode != "instructions" else ()), *(idl.instructions.values() if mode != "events" else ())]
    schemas = {i.name: idl.payload(i) for i in items}  # of equal names the instruction's counts
    for name in sorted(found):
        own = spark.read.parquet(path).where(F.col("part") == name)
        if name in schemas:
            own = own.withColumn("p", borsh.typed(F.col("data"), schemas[name]))
            own = own.select("slot", "block_time", "signature", "name", "program_id", *[F.col(f"p.`{f.name}`").alias(f.name) for f in schemas[name].fields])
        else:
            own = own.drop("part")
        sinks.write(own, f"{output}/{name}", form)
    return sorted(found)


def files_in(spark: SparkSession, path: str) -> bool:
    """Whether a folder that was written has a folder by name in it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return any(x.isDirectory() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))


def stored(spark: SparkSession, paths: str) -> DataFrame:
    """Records stored by ingest, with their file's epoch: Parquet, and JSON lines, which may lie in one folder; malformed lines are dropped. A comma-separated list of files, folders and patterns."""
    jvm, conf = spark.sparkContext._jvm, spark._jsc.hadoopConfiguration()
    found: dict[str, list[str]] = {"parquet": [], "json": []}

    def add(at, deep: bool = True) -> None:
        system = at.getFileSystem(conf)
        for x in system.globStatus(at) or []:
            name = x.getPath().getName()
            form = sinks.FORMATS.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None
            if form in found:
                found[form].append(x.getPath().toString())
            elif x.isDirectory() and deep:
                for y in system.listStatus(x.getPath()):
                    add(y.getPath(), False)

    for path in filter(None, paths.split(",")):
        add(jvm.org.apache.hadoop.fs.Path(path))
    # a folder's own name or its file's has the epoch
    epoch = sinks.epoch_of(F.regexp_replace(F.regexp_replace(F.input_file_name(), r"/part-[^/]*$", ""), r"\?.*$", "")).alias("epoch")
    parts = [(reader.parquet(*own) if form == "parquet" else reader.schema(RECORDS).option("mode", "DROPMALFORMED").json(own)).withColumn("epoch", epoch) for form, own in found.items() if own for reader in [spark.read]]
    if not parts:
        raise ValueError(f"no records in {paths!r}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def wallet_search(records: DataFrame, wallets: DataFrame, key: str = "signature") -> DataFrame:
    """(signature, role, donor, receiver, amount): who paid the wallets named in the first column of a table, from stored records. The balance change has to be over the threshold."""
    rows = records.select(F.get("signatures", F.lit(0)).alias(key), F.posexplode("account_balance_deltas").alias("idx", "b"))
    dtypes = dict(rows.select("b.*").dtypes)
    delta = F.col("b.delta" if "delta" in dtypes else "b.delta_lamports")
    changes = rows.select(key, (F.col("idx") + 1).alias("idx"), F.col("b.account").alias("account"), delta.alias("delta")).where(balances.over_threshold("delta"))
    return balances.counterparties(changes, tx=key, receivers=wallets)


def count_nodes(spark: SparkSession, path: str, decode: bool = False) -> DataFrame:
    """Nodes by kind; with `decode`, how many of transactions and rewards can be read."""
    columns = ["kind", "tx_data", "meta_data", "meta_error"] if decode else ["kind"]
    nodes = archive.read_archives(spark, path, columns=columns)
    return archive.counters(nodes) if decode else nodes.groupBy("kind").agg(F.count("*").alias("nodes"))


def epoch_paths(epochs: str, source: str, download_to: str | None) -> dict[int, str]:
    """Archive of each epoch: behind `source` (an address or a folder), or fetched into a folder first."""
    out = {}
    for n in sinks.epochs(epochs):
        path = files.epoch_address(source, n) if source.startswith(("http://", "https://")) else f"{source.rstrip('/')}/epoch-{n}.car"
        out[n] = files.download(path, download_to) if download_to else path
    return out


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """Counts of nodes by kind, and first and last slots; only heads and slots are looked at."""
    return archive.inspect(archive.read_archives(spark, path, columns=["file", "kind", "slot", "pos"], numbered=False))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quern")
    verbs = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "decode", "inspect", "count", "wallets"):
        p = verbs.add_parser(name)
        p.add_argument("--input", required=name != "ingest")
        if name in ("ingest", "decode", "wallets"):
            p.add_argument("--output", required=True)
            p.add_argument("--format", default="parquet", choices=sorted(sinks.FORMATS))
        if name in ("ingest", "decode"):
            p.add_argument("--idl")
            p.add_argument("--extract", default="raw" if name == "ingest" else "both", choices=MODES)
        if name == "ingest":
            p.add_argument("--program")
            p.add_argument("--strict-lookup", action="store_true")
            p.add_argument("--epochs", help="N or A..B, from --source; written as epoch-N")
            p.add_argument("--source", default=".", help="folder or address that has the epochs' archives")
            p.add_argument("--download", metavar="FOLDER", help="fetch archives there first; otherwise they are read where they are")
            p.add_argument("--keep-car", action="store_true", help="keep what was fetched")
            p.add_argument("--rows-per-file", type=int, default=sinks.PART_ROWS)
        if name == "count":
            p.add_argument("--decode", action="store_true")
        if name == "wallets":
            p.add_argument("--wallets", required=True, help="Parquet whose first column has the wallets")
    a = parser.parse_args(argv)
    from ..session import session, ship

    spark = session()
    ship(spark)
    if a.command == "inspect":
        inspect(spark, a.input).orderBy("file", "kind").show(100, False)
        return
    if a.command == "count":
        count_nodes(spark, a.input, a.decode).orderBy("kind").show(100, False)
        return
    if a.command == "wallets":
        sinks.write(wallet_search(stored(spark, a.input), spark.read.parquet(a.wallets)), a.output, a.format)
        return
    idl = None
    if a.command == "decode" or a.extract != "raw":
        if not a.idl:
            parser.error("--idl is needed")
        idl = Idl.load(a.idl)
    if a.command == "decode":
        write_decoded(stored(spark, a.input), idl, a.extract, a.output, a.format)
        return
    if not a.input and not a.epochs:
        parser.error("--input or --epochs is needed")
    programs = targets(a.program) if a.program else None
    for n, path in (epoch_paths(a.epochs, a.source, None if a.input else a.download) if a.epochs else {None: a.input}).items():
        records = ingest(spark, path, programs, a.strict_lookup)
        if a.extract == "raw":
            sinks.write(with_text_data(records), a.output if n is None else f"{a.output}/epoch-{n}.{a.format}", a.format, rows=a.rows_per_file)
        else:
            write_decoded(records, idl, a.extract, a.output if n is None else f"{a.output}/epoch-{n}", a.format)
        if a.download and not a.keep_car:
            os.remove(path)


if __name__ == "__main__":
    main()
