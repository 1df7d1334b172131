"""Writers: Parquet, CSV and JSON lines of records, and flat tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_ROWS = 500_000
FORMATS = {"parquet": "parquet", "csv": "csv", "jsonl": "json", "jsonlines": "json", "json": "json"}


def format_of(name: str) -> str:
    if name.lower() not in FORMATS:
        raise ValueError(f"unknown format {name!r}; one of {sorted(FORMATS)}")
    return FORMATS[name.lower()]


def nested_as_json(df: DataFrame) -> DataFrame:
    """Arrays, structs and maps as JSON text with their nulls, for formats that have none."""
    return df.select([F.to_json(c, {"ignoreNullFields": "false"}).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c in df.columns])


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "error", partition_by: list[str] = (), rows: int = PART_ROWS) -> None:
    """Parquet is zstd of level 3; CSV has a header, doubled quotes and nested cells as JSON; JSON lines keep null fields."""
    form = format_of(form)
    writer = (nested_as_json(df) if form == "csv" else df).write.mode(mode).option("maxRecordsPerFile", rows)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if form == "parquet":
        writer.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 3).parquet(path)
    elif form == "csv":
        writer.option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", '""').csv(path)
    else:
        writer.option("ignoreNullFields", "false").json(path)


def write_flat(df: DataFrame, path: str, form: str = "parquet", key: str = "name", mode: str = "error") -> None:
    """A folder per name; the column stays in the files too. Rows of a name are gathered before they are written; a name of any size is split at the advisory size of a partition."""
    spread = df.withColumn("_name", F.col(key)).hint("rebalance", "_name")
    write(spread.withColumnRenamed("_name", f"{key}_part"), path, form, mode, [f"{key}_part"])


def read(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet") -> DataFrame:
    """Lines that aren't JSON are dropped."""
    form = format_of(form)
    if form == "json":
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if form == "csv":
        return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return spark.read.schema(schema).parquet(path)


def epoch_of(name: F.Column) -> F.Column:
    """Epoch from a file name epoch-N or epoch_N; 0 for others."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(name, F.lit(r"(?:^|/)epoch[-_](\d+)\.[A-Za-z0-9]+$"), 1), F.lit(1)).cast("long"), F.lit(0))


def epochs(text: str) -> list[int]:
    """"a..b" with both ends, or one number."""
    low, dots, high = text.partition("..")
    if dots:
        if int(low) > int(high):
            raise ValueError(f"empty range {text!r}")
        return list(range(int(low), int(high) + 1))
    return [int(low)]
