"""What the operators of this subpackage share: sizes, checkpoints and Arrow text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The white space of every word rule here: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_CACHES: list[dict] = []


def worker_cache() -> dict:
    """A dict for what an operator keeps from task to task in a Python worker."""
    _CACHES.append({})
    return _CACHES[-1]


def alone(cache: dict) -> None:
    """Frees what other operators have kept in this worker, which they share in a pipeline."""
    for other in _CACHES:
        if other and other is not cache:
            other.clear()
            give_back()


def give_back() -> None:
    """Returns what a task has freed to the system, where the C library can: idle workers otherwise keep it while later stages run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes that a plan reads; files count as stored."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces_for(df: DataFrame, mb: float, least: int = 8) -> int:
    """How many parts of about `mb` stored MB the input makes. Where the optimizer has no estimate (rows from memory, or a product of joins): the session's shuffle partitions."""
    size = plan_bytes(df)
    if size >= 1 << 52:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(1 << 22, int(size / (mb * 1e6)) + 1))


def range_bounds(keys: DataFrame, parts: int, most: int = 1 << 16) -> np.ndarray:
    """Ascending bounds that cut the rows of `keys`, one long column, into `parts` ranges of about as many rows; equal ones where a key fills several ranges.

    They are quantiles of one mergeable sketch, so at most `most` numbers reach the driver; further bounds are put evenly between these. Without rows: none."""
    n = min(parts, most)
    if n < 2:
        return np.zeros(0, np.int64)
    found = keys.agg(F.percentile_approx(F.col(keys.columns[0]), [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0]
    if not found:
        return np.zeros(0, np.int64)
    found = np.array(found, np.int64)
    return found if n == parts else np.interp(np.linspace(0, n - 2, parts - 1), np.arange(n - 1), found).astype(np.int64)


#: Tables of so many rows at most are broadcast by beside().
MOST_BROADCAST, SALTS = 100_000, 32


def beside(rows: DataFrame, table: DataFrame, on: Column, n: int, how: str = "left") -> DataFrame:
    """rows joined with a narrow table of n rows by `on`: broadcast if it is small; else its rows are repeated for some salts, so that no task gets all rows of one key."""
    if n <= MOST_BROADCAST:
        return rows.join(F.broadcast(table), on, how)
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    table = table.withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(table, on & (F.col("_salt") == F.col("_salt_of")), how).drop("_salt", "_salt_of")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which executors share; a temporary one where it is unset."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back."""
    df.write.parquet(path := fresh_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_id_hash(df: DataFrame, modulus: int, name: str) -> DataFrame:
    """Adds crc32(doc_id as text) mod `modulus`; a null id counts as empty text."""
    return df.withColumn(name, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows with about `most` bytes; a longer text is a run of its own."""
    data, offsets = utf8(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def long_list(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64; fixed values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full(max(n, 1 << 20), self.base, np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = pow(self.base, -1, 1 << 64)
            self.down = np.multiply.accumulate(steps)
        return self.up, self.down


_POWERS = Powers(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of some texts, and n + 1 offsets of each text's words.

    A word's hash is its span in a prefix sum of byte values times powers, so all words cost a few passes over the bytes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = LOWER[data]
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _POWERS.to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)
