"""Balance changes and who paid for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Smallest change that counts, and units of a coin. Fixed values.
THRESHOLD, UNITS = 1_000_000, 1_000_000_000


def token_changes(pre: DataFrame, post: DataFrame, tx: str, keys: list[str], amount: str, order: str) -> DataFrame:
    """Full outer match of balances before and after by transaction and keys; of equal keys the last by `order` counts.

    One union and one grouped pass: both sides share a shuffle, and duplicates are combined before it."""
    a = pre.select(tx, *keys, F.col(amount).alias("pre_amount"), F.col(order).alias("_a"), F.lit(None).cast(pre.schema[amount].dataType).alias("post_amount"), F.lit(None).cast(pre.schema[order].dataType).alias("_b"))
    b = post.select(tx, *keys, F.lit(None).cast(pre.schema[amount].dataType).alias("pre_amount"), F.lit(None).cast(pre.schema[order].dataType).alias("_a"), F.col(amount).alias("post_amount"), F.col(order).alias("_b"))
    return a.unionByName(b).groupBy(tx, *keys).agg(F.max_by("pre_amount", "_a").alias("pre_amount"), F.max_by("post_amount", "_b").alias("post_amount"))


def over_threshold(delta: Column | str, least: int = THRESHOLD) -> Column:
    return F.abs(F.col(delta) if isinstance(delta, str) else delta) > least


def counterparties(changes: DataFrame, tx: str = "tx_id", index: str = "idx", account: str = "account", delta: str = "delta", receivers: DataFrame | None = None) -> DataFrame:
    """(tx, role, donor, receiver, amount): within a transaction, for each account that gained, every other one that lost more than that.

    An equi-join on the transaction with the comparison as its condition; role by whether the donor is the first account. With `receivers`
    (one column) only these accounts' gains count. Rows with a null change give nothing."""
    a = changes.select(F.col(tx), F.col(index).alias("i"), F.col(account).alias("receiver"), F.col(delta).alias("gain")).where("gain > 0")
    if receivers is not None:
        a = a.join(receivers.select(F.col(receivers.columns[0]).alias("receiver")).distinct(), "receiver", "left_semi")
    b = changes.select(F.col(tx), F.col(index).alias("j"), F.col(account).alias("donor"), F.col(delta).alias("loss")).where("loss < 0")
    pairs = a.join(b, tx).where("i <> j and loss < -gain")
    return pairs.select(tx, F.when(F.col("j") == 1, "MASTER_DONOR").otherwise("SIDE_DONOR").alias("role"), "donor", "receiver", F.col("gain").alias("amount"))
