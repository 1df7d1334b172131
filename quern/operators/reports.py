"""Aggregates over decoded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS_PER_EPOCH = 432_000


def top_names(df: DataFrame, name: str, k: int, error: str | None = None) -> DataFrame:
    """The k commonest names with their share in percent; ties by name. With `error`, a boolean column, the share of errors too."""
    counts = df.groupBy(name).agg(F.count("*").alias("n"), *([F.count_if(F.col(error)).alias("n_errors")] if error else []))
    total = counts.agg(F.sum("n").alias("total"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("pct", F.round(100.0 * F.col("n") / F.col("total"), 4)).drop("total")
    if error:
        out = out.withColumn("error_pct", F.round(100.0 * F.col("n_errors") / F.col("n"), 4))
    return out.orderBy(F.desc("n"), name).limit(k)


def last_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, without a sort: the greatest of structs, combined before the shuffle."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("_r")).select(key, "_r.*")


def percentile(df: DataFrame, column: str, q: float, name: str) -> DataFrame:
    """Exact, with linear interpolation between neighbours."""
    return df.agg(F.percentile(F.col(column).cast("double"), q).alias(name))


def skipped_slots(blocks: DataFrame, slot: str = "slot", per_epoch: int = SLOTS_PER_EPOCH) -> DataFrame:
    """(epoch, blocks, skipped): missing slots between the epoch's first possible one and its last block. A window per epoch, so epochs go in parallel."""
    s = blocks.select(F.col(slot).alias("slot")).where("slot is not null").distinct().withColumn("epoch", F.floor(F.col("slot") / per_epoch).cast("long"))
    order = Window.partitionBy("epoch").orderBy("slot")
    expected = F.coalesce(F.lag("slot").over(order) + 1, F.col("slot") - F.col("slot") % per_epoch)
    return s.withColumn("gap", F.col("slot") - expected).groupBy("epoch").agg(F.count("*").alias("blocks"), F.sum("gap").alias("skipped"))


def counters(df: DataFrame) -> DataFrame:
    """One row of run counters from flags per transaction: matched, records, decode_error, metadata_error, metadata_skipped."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("matched")).alias("matched"), F.count_if(F.col("records") > 0).alias("with_records"), F.coalesce(F.sum("records"), F.lit(0)).cast("long").alias("records"), F.count_if(F.col("decode_error")).alias("decode_errors"), F.count_if(F.col("metadata_error")).alias("metadata_errors"), F.count_if(F.col("metadata_skipped")).alias("metadata_skipped"))


def sampled_mean(df: DataFrame, key: str, value: str, every: int = 256) -> DataFrame:
    """Mean over the keys divisible by `every`, as a run's timers are sampled."""
    return df.where(F.col(key) % every == 0).agg(F.count("*").alias("samples"), F.round(F.avg(value), 6).alias("mean"))


def clock(seconds: str) -> F.Column:
    """HH:MM:SS."""
    s = F.col(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def thousands(value: str) -> F.Column:
    return F.format_number(F.col(value), 0)


def to_index(df: DataFrame, key: str) -> DataFrame:
    """One JSON object with an entry per key; for tables small enough to be one document."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(key).cast("string"), F.struct(*[c for c in df.columns if c != key]))))
    return df.agg(F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}).alias("json"))


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Those of the columns that are there, under their new names."""
    return df.select([F.col(c).alias(n) for c, n in names.items() if c in df.columns])
