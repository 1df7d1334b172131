"""Token ids in ORC files: stripes of run-length encoded integers, row indexes, and Bloom filters on document ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, pieces_for, range_bounds, slices
from .tokens import crc32, vocabulary, word_encoder

END_ID = 1
#: Where so many files have one row each in the table of their starts, it is broadcast.
FILES = 200_000
#: part: number of the file, ascending with doc_id; at: ids of the documents before this one in its file.
SCHEMA = "doc_id long, part int, at long, n_tokens int, tokens array<int>"
OPTIONS = {"orc.compress": "SNAPPY", "orc.create.index": "true", "orc.row.index.stride": "2000", "orc.stripe.size": str(4 << 20), "orc.rows.between.memory.checks": "500", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


def write_tokens(docs: DataFrame, path: str, end_id: int = END_ID, vocabulary_path: str | None = None, part_mb: float = 12) -> None:
    """Encodes every whole text, appends `end_id`, and writes one file per range of doc_id, rows ascending.

    Texts are dealt by range of doc_id before they are encoded, so ids are shuffled nowhere. ORC encodes each stripe's integers by run
    length; readers prune files and stripes by the row indexes and Bloom filters of doc_id. Null text: empty (the end id alone).
    Repeated doc_ids: ordered by text. Null doc_id: first. Empty table: no rows. Other columns are ignored."""
    vocabulary_path = vocabulary_path or vocabulary("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = word_encoder(vocabulary_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, _, _ in slices(batch.column(1)):
                ids, at = encoder.encode(batch.column(1).slice(a, b - a).to_pylist(), end_id)
                n = b - a
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(np.full(n, part, np.int32)), pa.array(before + at[:-1]), pa.array(np.diff(at).astype(np.int32)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], ["doc_id", "part", "at", "n_tokens", "tokens"])
                before += int(at[-1])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_o", F.coalesce("doc_id", F.lit(-(1 << 63))))
    bounds = np.unique(range_bounds(docs.select("_o"), pieces_for(docs, part_mb)))
    place = F.arrow_udf(lambda o: pa.array(np.searchsorted(bounds, o.to_numpy(zero_copy_only=False), "right").astype(np.int32)), "int")
    dealt = docs.repartitionById(len(bounds) + 1, place("_o")).sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    dealt.mapInArrow(run, SCHEMA).write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, of: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """The rows of such files, or what `of` makes of them and leaves with the columns part and at, with start, the ids of all documents before each; where each file starts comes from the counts column alone, one row a file.

    A filter on doc_id reads only the stripes and row groups whose statistics and Bloom filters allow it. Files without rows: no rows."""
    rows = spark.read.schema(SCHEMA).orc(path)
    starts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = starts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    if len(rows.inputFiles()) <= FILES:
        starts = F.broadcast(starts)
    return of(rows).join(starts, "part").withColumn("start", F.col("base") + F.col("at")).drop("base")


def token_digest(rows: DataFrame) -> DataFrame:
    """doc_id, part, at, n_tokens, ids_crc32 of rows with doc_id, part, at, tokens. Empty lists have no ids and the crc 0; repeated rows alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            crc = [crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "part", "at", "tokens").mapInArrow(run, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")


def tokens_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the ids of all documents with write_tokens(), reads the files back with read_tokens(), and returns their digest: doc_id, start, n_tokens, ids_crc32 per row. Nulls, ties and empty tables as there."""
    path = path or fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    return read_tokens(docs.sparkSession, path, token_digest).select("doc_id", "start", "n_tokens", "ids_crc32")
