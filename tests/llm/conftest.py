from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) tuples, in a few partitions."""

    def build(rows, parts=3):
        rows = [(*r, *(None,) * (4 - len(r)), None if len(r) < 2 or r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(rows, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)

    return build


#: Nulls, empties, ties, repeats, control signs, other scripts, long runs.
ODD = [(1, None), (2, ""), (3, " \t\n\x0b\r "), (4, "one"), (5, "one two three four"), (5, "one two three four"), (6, "One TWO three\x0bfour"), (None, "a null id here of five words"), (7, "x" * 70_000), (8, "a b " * 30_000), (9, "\x01\x02\x03\x1c\x85\xa0 é́ 日本語 😀   z"), (10, "<|endoftext|> mid<|startoftext|>dle <|endoftext|>"), (11, "12345 !! ..."), (12, None)]


@pytest.fixture(scope="session")
def odd(make, spark):
    from pyspark.sql import functions as F

    df = make([(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}") for k, (i, t) in enumerate(ODD)])
    for name in ("sig", "n", "h", "g", "base", "safe", "copies", "_h", "key", "part", "score", "spans"):
        df = df.withColumn(name, F.lit("clash"))
    return df
