"""Packing along a space-filling curve: similar documents are neighbours in the sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_for, range_bounds, slices, word_hashes
from .tokens import crc32, vocabulary, word_encoder

LENGTH, END_ID, DIMENSIONS, BITS = 4096, 2, 3, 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES_WITH_IDS = PIECES + ", ids array<int>"


def hilbert_key(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indexes of points given as columns of `axes` (n x dims, integers below 2**bits), after Skilling's transform."""
    x = [axes[:, i].astype(np.int64) for i in range(axes.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


def document_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hilbert key of each text: its hashed words' sign vector, averaged, on DIMENSIONS axes. Without words: the centre's key."""
    hashes, at = word_hashes(data, offsets)
    count = np.maximum(np.diff(at), 1)
    axes = []
    for d in range(DIMENSIONS):
        signs = np.zeros(len(hashes) + 1, np.int64)
        np.cumsum(((hashes >> np.uint64(7 * d + 3)) & np.uint64(1)).astype(np.int64) * 2 - 1, out=signs[1:])
        axes.append(((signs[at[1:]] - signs[at[:-1]]) / count + 1) / 2)
    return hilbert_key(np.minimum((np.stack(axes, 1) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def _key_column(bounds: np.ndarray | None):
    """A UDF text, doc_id -> key; with `bounds` struct<key, part>. Equal keys that cover several parts are spread over these by doc_id."""

    def keys(text: pa.Array) -> np.ndarray:
        return np.concatenate([document_keys(data, offsets) for _, _, data, offsets in slices(text)] or [np.zeros(0, np.int64)])

    if bounds is None:
        return F.arrow_udf(lambda text: pa.array(keys(text)), "long")

    def placed(text: pa.Array, spread: pa.Array) -> pa.Array:
        key = keys(text)
        low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
        part = low + spread.to_numpy(zero_copy_only=False) % (high - low + 1)
        return pa.StructArray.from_arrays([pa.array(key), pa.array(part.astype(np.int32))], ["key", "part"])

    return F.arrow_udf(placed, "key long, part int")


def along_curve(docs: DataFrame, part_mb: float = 12, sample_per_part: int = 64) -> DataFrame:
    """docs range-partitioned and sorted by Hilbert key. The range bounds come from about `sample_per_part` sampled keys a part;
    they only balance the parts, every row is kept. Null and empty texts have the centre's key, repeated rows the same one."""
    parts = pieces_for(docs, part_mb)
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    total = docs.agg(F.sum(size)).first()[0] or 1
    # rows are picked in proportion to their bytes, as long texts lie together: their averages are alike
    picked = size * F.lit(sample_per_part * parts / total) > F.rand(7)
    bounds = range_bounds(docs.where(picked).select(_key_column(None)("text")), parts)
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    keyed = docs.withColumn("_place", _key_column(bounds)("text", spread))
    return keyed.repartitionById(parts, F.col("_place.part")).sortWithinPartitions("_place.key", "doc_id", "text")


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, vocabulary_path: str | None = None, with_ids: bool = False, cached: int = 120_000) -> DataFrame:
    """Packs each row's ids and the end id into sequences of at most `length`, neighbours on the curve together; one row per piece.

    Each range of the curve is one running stream, cut every `length` ids; what is left at its end is cut into powers of two, so nothing
    is padded. sequence_id: number of the range times 2**32 plus the sequence's in it. Null text: empty. Repeated rows are packed as often as they
    come. Empty table: no rows. Other columns are ignored.
    A worker keeps the ids of at most twice `cached` pieces of text."""
    vocabulary_path = vocabulary_path or vocabulary("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = word_encoder(vocabulary_path, cached), TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        open_pieces: list[tuple] = []  # of the sequence that isn't full: doc_id, start, doc_tokens, ids
        fill = 0

        def close(pieces: list[tuple], most: int) -> list[tuple]:
            """Puts pieces into the next sequence up to `most` ids; what is over."""
            nonlocal sequence
            offset = 0
            while pieces and offset < most:
                doc, start, total, ids = pieces.pop(0)
                took, over = ids[: most - offset], ids[most - offset :]
                out.append((doc, start, len(took), crc32(took), total, sequence, offset, took))
                offset += len(took)
                if len(over):
                    pieces.insert(0, (doc, start + len(took), total, over))
            sequence += 1
            return pieces

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in list(zip(*(r[:7] for r in rows), strict=True))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([r[7] for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for a, b, _, _ in slices(batch.column(1)):
                ids, at = encoder.encode(batch.column(1).slice(a, b - a).to_pylist(), end_id)
                for doc, x, y in zip(batch.column(0).slice(a, b - a).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    first, total = x, y - x
                    while x < y:
                        z = min(y, x + length - fill)
                        open_pieces.append((doc, x - first, total, ids[x:z]))
                        fill += z - x
                        x = z
                        if fill == length:
                            open_pieces, fill = close(open_pieces, length), 0
                if out:
                    yield batch_of(out)
                    out.clear()
                open_pieces = [(*p[:3], p[3].copy()) for p in open_pieces]
        while fill:
            size = 1 << (fill.bit_length() - 1)
            open_pieces = close(open_pieces, size)
            fill -= size
        if out:
            yield batch_of(out)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return along_curve(docs).select("doc_id", "text").mapInArrow(run, PIECES_WITH_IDS if with_ids else PIECES)
