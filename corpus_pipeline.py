"""A training corpus from raw documents: language, near duplicates, secrets, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's docs; all but the last
keep the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import langid, mixing, secret_scan
from quern.llm.common import DOCUMENT_COLUMNS, documents, fresh_path
from quern.llm.jaccard import one_of_each_class
from quern.llm.packing import pack

#: Texts whose language is less sure than this, or that have no letter, are rejected.
LEAST_LANGUAGE_SCORE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised, repeated ones alike, and with any id. Rejected: null or letterless texts, and those with a posterior below LEAST_LANGUAGE_SCORE. lang stays as it was."""
    return langid.recognised(docs, langid.fit(docs), LEAST_LANGUAGE_SCORE).select(*DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: of the class's smallest doc_id, and one where that comes more than once. Ids may be null or repeated. Texts without words link with nothing, and all of them stay."""
    return one_of_each_class(docs).select(*DOCUMENT_COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their text replaced and n_chars counted anew. Null texts stay null, empty ones empty; repeated rows and ids alike; an empty table gives none. Of other columns only those of documents stay."""
    return secret_scan.redact(docs).select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated so that each source has the same expected share, in random order. A null source is one of its own, a null id counts as empty text, repeated rows are drawn alike; an empty table gives no rows. Only the columns of documents stay."""
    return mixing.poisson_mix(docs).select(*DOCUMENT_COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4,096 tokens, similar texts together. Null texts are empty and give the end id alone; rows with a repeated or null id are packed each on its own; an empty table gives no rows."""
    return pack(docs)


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the language model nor the tokenizer. The tests of the operators hold these against brute force, those of the pipeline what its stages keep, change and repeat.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := fresh_path(spark, f"pipeline-{name}"))
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
