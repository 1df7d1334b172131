"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, cut, pieces_for

SEED = "mix-1"
#: Rates of so many sources at most are broadcast, with 50 steps each on average; more are joined by shuffle.
MOST_SOURCES = 10_000


def _uniform_bits(digits: int, *parts: F.Column | str) -> F.Column:
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, rows: float | None = None) -> DataFrame:
    """(source, rate): the mean number of copies that gives each source its share of `rows` rows (as many as the input unless given).

    weights: target share by source, in any scale; sources not named have 0. None: equal shares. A null source is a source of its own."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is not None:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        counts = counts.join(named, "source", "left").fillna(0.0, ["weight"])
    else:
        counts = counts.withColumn("weight", F.lit(1.0))
    total = counts.agg(F.sum("weight").alias("w"), F.sum("n").alias("all"))
    wanted = F.lit(float(rows)) if rows is not None else F.col("all").cast("double")
    return counts.crossJoin(F.broadcast(total)).select("source", F.when(F.col("w") > 0, F.col("weight") / F.col("w") * wanted / F.col("n")).otherwise(0.0).alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """(_source, _cdf) of rates: P(count <= k) for k from 0 to far in the tail, so the number of entries that are <= u is the count of a uniform u. Running sums, in logarithms, so that a large rate doesn't underflow; empty for a rate of 0."""
    far = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    steps = rates.where("rate > 0").select("source", "rate", F.explode(F.sequence(F.lit(0), far)).alias("k"))
    upto = Window.partitionBy("source").orderBy("k")
    logs = steps.withColumn("log", F.sum(F.when(F.col("k") > 0, F.log(F.col("rate") / F.col("k"))).otherwise(-F.col("rate"))).over(upto))
    sums = logs.withColumn("cdf", F.sum(F.exp("log")).over(upto)).groupBy("source").agg(F.array_sort(F.collect_list("cdf")).alias("_cdf"))
    none = rates.where("not rate > 0").select("source", F.array().cast("array<double>").alias("_cdf"))
    return sums.unionAll(none).withColumnRenamed("source", "_source")


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, rows: float | None = None, seed: str = SEED, part_mb: float = 12) -> DataFrame:
    """docs with copies, copy (0 to copies - 1) and shuffle_key: each row as often as a Poisson variable with its source's rate says, in random order.

    The variable is the inverse of the distribution at a hash of the seed and doc_id, so any task that is run again draws the same. Copies go to
    ranges of a uniform 60-bit key and are sorted by it: one global order without sampling. Rates are joined as a table of sources,
    of any number. Null doc_id hashes as empty text, null source is a source of its own, repeated rows draw alike; empty table: no rows;
    other columns stay, but for any of the three new names."""
    rates = cut(poisson_steps(repetition_rates(docs, weights, rows)))
    # a list of steps grows with its rate, so both are looked at
    size = rates.agg(F.count("*"), F.coalesce(F.sum(F.size("_cdf")), F.lit(0))).first()
    few = size[0] <= MOST_SOURCES and size[1] <= 50 * MOST_SOURCES
    u = _uniform_bits(13, F.lit(seed), F.col("doc_id")) / F.lit(float(1 << 52))
    whole = docs.select(F.struct("*").alias("_row"), "doc_id", "source", u.alias("_u"))
    drawn = beside(whole, rates, F.col("source").eqNullSafe(F.col("_source")), 0 if few else 1 << 60, "inner")
    count = F.when(F.size("_cdf") > 0, F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))).otherwise(0).cast("long")
    drawn = drawn.select("_row", "doc_id", count.alias("copies"))
    spread = drawn.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    spread = spread.withColumn("shuffle_key", _uniform_bits(15, F.lit(seed), F.col("doc_id"), F.col("copy")))
    parts = pieces_for(docs, part_mb)
    dealt = spread.repartitionById(parts, F.least((F.col("shuffle_key") / F.lit(float(1 << 60)) * parts).cast("int"), F.lit(parts - 1))).sortWithinPartitions("shuffle_key", "doc_id", "copy")
    return dealt.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in ("copies", "copy", "shuffle_key")], "copies", "copy", "shuffle_key")


ORACLE = f"""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT count(*) AS s, sum(n) AS a FROM c),
r AS (SELECT source, (1.0::DOUBLE / s) * a::DOUBLE / n AS rate FROM c, t),
k AS (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS k FROM r),
p AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
d AS (SELECT doc_id, source, n_chars, md5(coalesce(text, '')) AS text_md5, ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
q AS (SELECT d.doc_id, d.source, d.n_chars, d.text_md5, (SELECT count(*) FROM p WHERE p.source = d.source AND p.cdf <= d.u) AS copies FROM d),
x AS (SELECT *, unnest(generate_series(0, copies - 1)) AS copy FROM q WHERE copies > 0)
SELECT doc_id, source, n_chars, text_md5, copies, copy, ('0x' || substr(md5('{SEED}:' || doc_id || ':' || copy), 1, 15))::BIGINT AS shuffle_key FROM x
"""
