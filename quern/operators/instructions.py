"""Filters and reshaping of transactions with nested instructions, as array functions: no row is exploded to be filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _list(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def runs_program(instructions: Column | str, targets: list[str]) -> Column:
    """Whether any instruction, outer or inner, runs a target program."""
    return F.exists(instructions, lambda i: i["program_id"].isin(targets))


def may_run_program(static_keys: Column | str, targets: list[str]) -> Column:
    """Cheap necessary test on the transaction's own keys; put before anything that reads metadata."""
    return F.arrays_overlap(static_keys, _list(targets))


def two_phase(df: DataFrame, targets: list[str], static_keys: str = "static_keys", outer: str = "outer", inner: str = "inner", strict_lookup: bool = False) -> DataFrame:
    """Rows with a target in their outer instructions, or, where their own keys name one, in the inner ones."""
    found = runs_program(outer, targets) | runs_program(inner, targets)
    return df.where(found) if strict_lookup else df.where(may_run_program(static_keys, targets)).where(found)


def without_programs(instructions: Column | str, ignored: list[str]) -> Column:
    """Instructions of other programs, program_id renamed to program."""
    kept = F.filter(instructions, lambda i: ~i["program_id"].isin(ignored))
    return F.transform(kept, lambda i: F.struct(i["program_id"].alias("program"), i["data"].alias("data"), i["accounts"].alias("accounts")))


def clean(df: DataFrame, ignored: list[str]) -> DataFrame:
    """slot, block_time, tx_id, is_error, error_msg, clean_instructions."""
    return df.select("slot", "block_time", F.get("signatures", F.lit(0)).alias("tx_id"), F.col("err").isNotNull().alias("is_error"), F.col("err").alias("error_msg"), without_programs("instructions", ignored).alias("clean_instructions"))


def flatten(cleaned: DataFrame, program: str) -> DataFrame:
    """One row per instruction of a program: tx_id, slot, block_time, b58, accounts."""
    own = F.filter("clean_instructions", lambda i: i["program"] == program)
    rows = cleaned.select("tx_id", "slot", "block_time", F.explode(own).alias("i"))
    return rows.select("tx_id", "slot", "block_time", F.col("i.data").alias("b58"), F.col("i.accounts").alias("accounts"))


def accounts_filter(df: DataFrame, include: list[str] = (), exclude: list[str] = (), required: list[str] = (), failed: bool | None = None, vote: bool | None = None) -> DataFrame:
    """Subscription predicates: any of include, none of exclude, all of required; failed and vote as wanted if given."""
    if include:
        df = df.where(F.arrays_overlap("accounts", _list(include)))
    if exclude:
        df = df.where(~F.arrays_overlap("accounts", _list(exclude)))
    if required:
        df = df.where(F.size(F.array_except(_list(required), "accounts")) == 0)
    if failed is not None:
        df = df.where(F.col("is_error") == failed)
    return df if vote is None else df.where(F.col("is_vote") == vote)


def account_names(names: Column, accounts: Column) -> Column:
    """Accounts by the names a description gives them, as far as both go."""
    n = F.least(F.size(names), F.size(accounts))
    return F.map_from_arrays(F.slice(names, F.lit(1), n), F.slice(accounts, F.lit(1), n))


def lookup(keys: Column | str, index: Column, unknown: str = "UNKNOWN_PROGRAM_INDEX_") -> Column:
    return F.coalesce(F.get(keys, index), F.concat(F.lit(unknown), index.cast("string")))


def wallet_targets(df: DataFrame) -> DataFrame:
    """(key): the distinct keys of 32 bytes that the first column names in base58; other values are left out."""
    from ..functions.codecs import from_base58

    keys = df.select(from_base58(F.trim(F.col(f"`{df.columns[0]}`").cast("string"))).alias("key"))
    return keys.where(F.length("key") == 32).distinct()


def in_targets(df: DataFrame, targets: DataFrame, accounts: str = "accounts", key: str = "tx_id") -> DataFrame:
    """Rows that touch a target account. Targets may be millions: a hash semi-join on exploded accounts, not a list in a predicate."""
    names = targets.select(F.col(targets.columns[0]).alias("_t")).where("_t is not null").distinct()
    hits = df.select(key, F.explode(accounts).alias("_t")).join(names, "_t", "left_semi").select(key).distinct()
    return df.join(hits, key, "left_semi")
