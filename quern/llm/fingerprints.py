"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces_for, range_bounds

WINDOW, KEEP, DIGITS = 24, 32, 10
#: Two primes below 2**31 and a base for each: products fit in 64 bits. Fixed values.
_PRIMES, _BASES = (2147483647, 2147483629), (1000003, 92821)


class _Tables:
    """Powers of a base and of its inverse modulo a prime, doubled as far as asked for."""

    def __init__(self, base: int, prime: int) -> None:
        self.base, self.prime = base, prime
        self.up = self.down = np.ones(1, np.int64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate((self.up, self.up * pow(self.base, k, self.prime) % self.prime))
            self.down = np.concatenate((self.down, self.down * pow(self.base, -k, self.prime) % self.prime))
        return self.up, self.down


_TABLES = [_Tables(b, p) for b, p in zip(_BASES, _PRIMES, strict=True)]


class PrefixHash:
    """Prefix arrays of a text's code points: any span's hash, span equality, and the longest common extension of two places."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        self.n = len(points)
        self.sums = []
        for t in _TABLES:
            up, _ = t.to(self.n + 1)
            s = np.zeros(self.n + 1, np.int64)
            np.cumsum(points * up[: self.n] % t.prime, out=s[1:])
            self.sums.append(s)

    def span(self, start: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
        """Hash of [start, end), the same wherever it stands."""
        out = np.uint64(0)
        for s, t in zip(self.sums, _TABLES, strict=True):
            h = (s[end] - s[start]) % t.prime * t.to(self.n + 1)[1][start] % t.prime
            out = (out << np.uint64(31)) | np.asarray(h).astype(np.uint64)
        return out

    def equal(self, start: int, other: PrefixHash, other_start: int, length: int) -> bool:
        return bool(self.span(start, start + length) == other.span(other_start, other_start + length))

    def extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """Length of the longest common extension from two places, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            half = (low + high + 1) // 2
            if self.equal(start, other, other_start, half):
                low = half
            else:
                high = half - 1
        return low

    def windows(self, start: int = 0, end: int | None = None, window: int = WINDOW) -> np.ndarray:
        """Mixed hashes, cut to DIGITS hex digits, of all windows that lie in [start, end); a shorter span is one window."""
        end = self.n if end is None else end
        if end <= start:
            return np.zeros(0, np.uint64)
        at = np.arange(start, max(start + 1, end - window + 1))
        return mix(self.span(at, np.minimum(at + window, end))) >> np.uint64(64 - 4 * DIGITS)


def smallest(values: np.ndarray, keep: int = KEEP) -> np.ndarray:
    """The `keep` smallest distinct values, ascending."""
    for most in (4 * keep, 64 * keep):
        if len(values) > 2 * most and len(found := np.unique(np.partition(values, most)[:most])) >= keep:
            return found[:keep]
    return np.unique(values)[:keep]


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Estimated share of windows in common: of the smallest values of both together, how many are in each. Both empty: 1."""
    both = np.union1d(a, b)[:keep]
    return float(np.isin(both, np.intersect1d(a, b)).mean()) if len(both) else 1.0


def as_text(values: np.ndarray) -> str:
    return "".join(f"{v:0{DIGITS}x}" for v in values.tolist())


def fingerprint(text: str) -> str:
    return as_text(smallest(PrefixHash(text).windows()))


#: Heads of so many ranges at most are broadcast.
RANGES = 200_000
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"


class _Document:
    """A row with what its neighbours ask of it; nothing is worked out twice."""

    def __init__(self, doc_id: int | None, text: str | None) -> None:
        self.doc_id, self.text = doc_id, text or ""
        self.hash = PrefixHash(self.text)
        self.own = self.hash.windows()
        self.print = smallest(self.own)

    def row(self, following: _Document) -> tuple:
        n = len(self.text)
        replaced = n // 4
        kept = n - replaced
        new = following.text[:replaced]
        edited = self.text[:kept] + new
        if replaced:
            # windows of the kept part are this text's own; those that reach the new part are hashed from a short tail
            inside = self.own[: max(0, kept - WINDOW + 1)]
            tail = PrefixHash(edited[len(inside) :]).windows() if len(new) or not len(inside) else inside[:0]
            prints = smallest(np.concatenate((inside, tail)))
            first = kept + self.hash.extension(kept, following.hash, 0) if len(new) else kept
            first = min(first, kept + len(new))
        else:
            prints, first = self.print, n
        return self.doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(self.print), as_text(prints), likeness(self.print, prints), likeness(self.print, following.print), first


def in_order(docs: DataFrame, part_mb: float = 12) -> DataFrame:
    """(doc_id, text, head): ranges of doc_id, sorted. The first row after a range is in it too, last and marked `head`; after the last range the first row of all.

    Only one id a range reaches the driver. Null ids come first."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_o", F.coalesce("doc_id", F.lit(-(1 << 63))))
    bounds = np.unique(range_bounds(docs.select("_o"), pieces_for(docs, part_mb)))
    place = F.arrow_udf(lambda o: pa.array(np.searchsorted(bounds, o.to_numpy(zero_copy_only=False), "right").astype(np.int32)), "int")
    least = sorted((r[0], r[1]) for r in docs.select("_o", place("_o").alias("p")).groupBy("p").agg(F.min("_o")).collect())
    heads = [(o, least[i - 1][0]) for i, (_, o) in enumerate(least)]
    few = len(heads) <= RANGES
    heads = spark.createDataFrame(heads, "_o long, _to int")  # one row a range
    heads = F.broadcast(heads) if few else heads
    placed = docs.join(heads, "_o", "left").withColumn("_p", place("_o"))
    copies = F.when(F.col("_to").isNull(), F.array(F.struct(F.lit(False).alias("head"), F.col("_p").alias("p")))).otherwise(F.array(F.struct(F.lit(False).alias("head"), F.col("_p").alias("p")), F.struct(F.lit(True).alias("head"), F.col("_to").alias("p"))))
    spread = placed.select("_o", "doc_id", "text", F.inline(copies))
    return spread.repartitionById(max(1, len(bounds) + 1), "p").sortWithinPartitions("head", "_o", "text").select("doc_id", "text", "head")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, fingerprint; of the text whose last quarter is replaced by the next document's beginning edited_sha256 and edited_fingerprint;
    near_edited, near_next, and common_prefix, the code points that text and edited text have in common at the start.

    A fingerprint is the smallest hashes of the text's windows, so equal texts have equal ones. Null text: empty, with an empty fingerprint, which is like an empty one only.
    Rows with the same doc_id are ordered by text; a single row is its own next. Empty table: no rows. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out, done = None, [], False

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _OUT.split(", ")])

        for batch in batches:
            if done:
                continue
            for i in range(batch.num_rows):
                head = batch.column(2)[i].as_py()
                now = _Document(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if last is not None:
                    out.append(last.row(now))
                last = now
                if head:
                    done = True
                    break
                if len(out) >= 2000:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return in_order(docs).mapInArrow(run, _OUT)
