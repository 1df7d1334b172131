"""The catalogue: every query by name, and the SQL of those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import binary, relational

QUERIES = {**relational.QUERIES, **binary.QUERIES}
ORACLES = {**relational.ORACLES, **binary.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines to decoded rows, summed by program."""
    rows = binary.log_events_fast(spark, sf_dir)
    return rows.groupBy("program_id").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))
