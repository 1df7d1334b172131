"""Exact near-duplicate classes of documents: a grouped prefix join on sets of word shingles.

1. A document's set is its distinct word shingles, as 64-bit hashes. Documents with equal sets, by 128 bits, are one class from the start.
2. Every (shingle, class) entry goes to a bucket of the shingle, as 48 bits beside the bucket; a map task sends equal sets once. The bucket counts in how many classes the shingle
   is, and answers the class only for shingles of two classes or more: others can't be shared. Shingles in more than one of 500 sets are counted beforehand and need no bucket.
3. Shingles are ordered by that count, then hash. Two sets that link share a shingle among the first n - ceil(t n) + 1
   of each (the prefix). A set with so many unshared shingles links with nothing and is left out here.
4. Sets with the same prefix and size are one group; group pairs that share a prefix shingle pass a length and a
   position filter, then are expanded and their members verified on all their shared shingles.
5. Pairs are formed in two rounds, so that a large group of near copies costs no square of its size. First each group of a
   shingle is tried against the shingle's most central one. Then only groups in different components are paired: every such
   pair is tried, so no link that could join two classes is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, mix, pieces_for, slices, word_hashes
from .components import connected_components

WORDS, PERCENT = 5, 75
#: A shingle in such a share of the different sets is hot: it goes to no bucket, where one task would get all of its sets.
HOT = 1 / 500
_NONE = np.zeros(0, np.uint64)
_TURN = mix(np.arange(11, 11 + 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of `words`-word runs of each text, ascending, and n + 1 offsets. With fewer words, the whole sequence is one."""
    hashes, at = word_hashes(data, offsets)
    n = len(hashes)
    run = np.zeros(n, np.uint64)
    for k in range(words):
        run[: n - k] += mix(hashes[k:] ^ _TURN[k]) * _TURN[k]
    run = mix(run)
    out, ends = [], [0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            own = np.sort(run[a : b - words + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = mix((mix(hashes[a:b] ^ _TURN[: b - a]) * _TURN[: b - a]).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(b - a))
        else:
            own = hashes[:0]
        out.append(own)
        ends.append(ends[-1] + len(own))
    return np.concatenate(out) if out else hashes[:0], np.array(ends, np.int64)


_FIRST, _SECOND, _MOVED = (np.uint64(x) for x in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03))


def _summed(sets: np.ndarray, at: np.ndarray, turn: np.uint64) -> np.ndarray:
    """One hash a set: of its size and the sum of its members' hashes."""
    sums = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(mix(sets ^ turn), out=sums[1:])
    return mix((sums[at[1:]] - sums[at[:-1]]) + np.diff(at).astype(np.uint64))


def signatures(sets: np.ndarray, at: np.ndarray, moved: np.ndarray, bits: int = 64) -> np.ndarray:
    """What stands for a set: a hash of `bits` bits, or one made from a second hash if that of several sets, named in `moved`, is the same."""
    sig = _summed(sets, at, _FIRST) >> np.uint64(64 - bits)
    if len(moved) and (again := np.isin(sig, moved)).any():
        sig[again] = mix(_summed(sets, at, _SECOND)[again] ^ _MOVED)
    return sig


def document_sets(docs: DataFrame, words: int = WORDS, beside: tuple[str, ...] = (), moved: np.ndarray = _NONE, bits: int = 64, most: int = 1 << 20) -> DataFrame:
    """(doc_id, n_shingles, sig, check) of each row, and the long columns named in `beside`; check is a second hash of the set. Null and wordless texts have 0 shingles.

    Rows with n_shingles -1 name in sig a shingle that is in so many different sets as check says of about `most` shingles in a row."""

    def often(held: list) -> pa.RecordBatch:
        sig, sets, n = (np.concatenate([x[i] for x in held]) for i in range(3))
        _, first = np.unique(sig, return_index=True)
        one = np.zeros(len(sig), bool)
        one[first] = True
        one &= n > 0
        found, counts = np.unique(sets[np.repeat(one, n)], return_counts=True)
        hot = counts >= max(4, one.sum() * HOT / 2)
        k = int(hot.sum())
        return pa.RecordBatch.from_arrays([pa.nulls(k + 1, pa.int64()), pa.array([-1] * k + [-2]), pa.array(np.append(found[hot].view(np.int64), 0)), pa.array(np.append(counts[hot], one.sum())), *[pa.nulls(k + 1, pa.int64())] * len(beside)], names)

    names = ["doc_id", "n_shingles", "sig", "check", *beside]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                sets, at = shingle_sets(data, offsets, words)
                sig, n = signatures(sets, at, moved, bits), np.diff(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(sig.view(np.int64)), pa.array(_summed(sets, at, _SECOND).view(np.int64)), *(batch.column(i + 2).slice(a, b - a) for i in range(len(beside)))], names)
                held.append((sig, sets, n))
                size += len(sets)
                if size >= most:
                    yield often(held)
                    held, size = [], 0
        if held:
            yield often(held)
        held.clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text", *beside).mapInArrow(run, ", ".join(f"{c} long" for c in names))


class Sets:
    """The table of document_sets(), without two different sets under one sig, and what a join on it has to know: the sigs that were moved for that, and the hot shingles with their counts."""

    def __init__(self, docs: DataFrame, words: int = WORDS, beside: tuple[str, ...] = (), bits: int = 64) -> None:
        self.bits, self.moved = bits, _NONE
        while True:
            rows = cut(document_sets(docs, words, beside, self.moved, bits))
            same = rows.where("n_shingles > 0").groupBy("sig").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("sig")
            # of 64 bits about n * n / 2 ** 65: a few hundred at 1e11 different texts
            new = np.array([r.sig for r in same.collect()], np.int64).view(np.uint64)
            if not len(new):
                break
            self.moved = np.union1d(self.moved, new)
        self.rows = rows.where("n_shingles >= 0")
        marks = rows.where("n_shingles < 0")
        sets = marks.where("n_shingles = -2").agg(F.sum("check")).first()[0] or 0
        # at most the mean size of a set, divided by HOT
        hot = marks.where("n_shingles = -1").groupBy("sig").agg(F.sum("check").alias("n")).where(F.col("n") >= max(8, sets * HOT)).collect()
        order = np.argsort(shingles := np.array([r.sig for r in hot], np.int64).view(np.uint64))
        self.hot, self.counts = shingles[order], np.minimum(np.array([r.n for r in hot], np.int64)[order], (1 << 31) - 1).astype(np.int32)


#: An entry block: its classes, their set sizes, how many shingles each has in it, and those shingles.
_BLOCK = "part int, sig binary, n binary, len binary, hash binary"


def _entries(docs: DataFrame, words: int, parts: int, known: Sets, most: int = 1 << 20) -> DataFrame:
    """What goes to the buckets of shingles that aren't hot."""
    moved, bits, hot = known.moved, known.bits, known.hot

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        sig, first = np.unique(np.concatenate([x[0] for x in held]), return_index=True)
        n = np.concatenate([x[1] for x in held])
        ends = np.cumsum(n)
        sets = np.concatenate([x[2] for x in held])
        n, ends = n[first], ends[first]
        keep = np.repeat(ends - n - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        sets, owner = sets[keep], np.repeat(np.arange(len(sig), dtype=np.int32), n)
        if len(hot):
            cold = _places(hot, sets) < 0
            sets, owner = sets[cold], owner[cold]
        part = (sets % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        part, owner, sets = part[order], owner[order], (sets // np.uint64(parts))[order]
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist() if len(part) else []
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
            new = np.flatnonzero(np.concatenate(([True], owner[a + 1 : b] != owner[a : b - 1])))
            own = owner[a:b][new]
            rows.append((int(part[a]), sig[own].tobytes(), n[own].astype(np.int32).tobytes(), np.diff(np.append(new, b - a)).astype(np.int32).tobytes(), _six(sets[a:b])))
            if len(rows) == 256:
                yield block(rows)
                rows = []
        if rows:
            yield block(rows)

    def block(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5))], ["part", "sig", "n", "len", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                sets, at = shingle_sets(data, offsets, words)
                held.append((signatures(sets, at, moved, bits), np.diff(at), sets))
                size += len(sets)
                if size >= most:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)
        held.clear()
        give_back()

    return docs.select("text").mapInArrow(run, _BLOCK)


def _places(hot: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Where in `hot` each shingle is; -1: nowhere."""
    at = np.minimum(np.searchsorted(hot, sets), len(hot) - 1)
    return np.where(hot[at] == sets, at, -1)


def _token(low: np.ndarray, bucket: np.ndarray | np.uint64) -> np.ndarray:
    """What stands for a shingle after its bucket: of its low six bytes and the bucket."""
    return mix(low + mix(bucket + np.uint64(1)))


def _blocks(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5))]


def _answers(parts: int, sig: np.ndarray, n: np.ndarray, classes: np.ndarray, tokens: np.ndarray) -> list[pa.Array]:
    """Blocks for the second grouping, by class: each shared shingle of a class with the number of classes it is in."""
    part = (mix(sig) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))[: len(part)]).tolist()
    return _blocks([(int(part[a]), sig[i].tobytes(), n[i].tobytes(), classes[i].astype(np.int32).tobytes(), tokens[i].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(part)]) for i in [order[a:b]]])


_NAMES = ["part", "sig", "n", "len", "hash"]


def _hot_answers(docs: DataFrame, words: int, parts: int, known: Sets) -> DataFrame:
    """The answers for hot shingles, which need no bucket: that they are shared, and about how often, is known."""
    moved, bits, hot, counts = known.moved, known.bits, known.hot, known.counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                sets, at = shingle_sets(data, offsets, words)
                sig, n = signatures(sets, at, moved, bits), np.diff(at)
                _, first = np.unique(sig, return_index=True)
                one = np.zeros(len(sig), bool)
                one[first] = True
                place = np.where(np.repeat(one, n), _places(hot, sets), -1)
                owner = np.repeat(np.arange(len(n)), n)[place >= 0]
                if len(owner):
                    some, place = sets[place >= 0], place[place >= 0]
                    tokens = _token(some // np.uint64(parts) & np.uint64((1 << 48) - 1), some % np.uint64(parts))
                    yield pa.RecordBatch.from_arrays(_answers(parts, sig[owner], n[owner].astype(np.int32), counts[place], tokens), _NAMES)

    return docs.select("text").mapInArrow(run, _BLOCK)


def _six(values: np.ndarray) -> bytes:
    """The low six bytes of each: with the number of the bucket they tell shingles apart, and are a quarter shorter to shuffle."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _whole(packed: np.ndarray) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = packed.reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _join(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)


def shared_sets(docs: DataFrame, known: Sets, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(sig, n, prefix, score, tokens): classes that could link, with their shared shingles ordered rarest first and how many of these are in the prefix."""
    parts = pieces_for(docs, 6)

    def count(table: pa.Table) -> pa.Table:
        hashes, sigs, sizes = _whole(_join(table, "hash", np.uint8)), _join(table, "sig", np.uint64), _join(table, "n", np.int32)
        owner = np.repeat(np.arange(len(sigs)), _join(table, "len", np.int32))
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        same = hashes[1:] == hashes[:-1]
        many = np.concatenate((same, [False])) | np.concatenate(([False], same))
        hashes, owner = hashes[many], owner[many]
        sig = sigs[owner]
        order = np.lexsort((sig, hashes))
        hashes, owner, sig = hashes[order], owner[order], sig[order]
        keep = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (sig[1:] != sig[:-1])))[: len(hashes)]
        hashes, owner, sig = hashes[keep], owner[keep], sig[keep]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))[: len(hashes)])
        classes = np.diff(np.append(first, len(hashes)))
        classes = np.repeat(classes, classes)
        keep = classes > 1
        bucket = np.array(table.column("part").to_numpy()[:1], np.uint64)
        rows = _answers(parts, sig[keep], sizes[owner[keep]], classes[keep], _token(hashes[keep], bucket))
        return pa.Table.from_arrays(rows, _NAMES)

    def gather(table: pa.Table) -> pa.Table:
        sig, n, classes, hashes = _join(table, "sig", np.uint64), _join(table, "n", np.int32), _join(table, "len", np.int32), _join(table, "hash", np.uint64)
        order = np.lexsort((hashes, classes, sig))
        # a hot shingle's answer comes from each block that has the set
        order = order[np.concatenate(([True], (sig[order[1:]] != sig[order[:-1]]) | (hashes[order[1:]] != hashes[order[:-1]])))[: len(order)]]
        sig, n, classes, hashes = sig[order], n[order].astype(np.int64), classes[order], hashes[order]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        count = np.diff(np.append(first, len(sig)))
        size = n[first]
        prefix = size - (-(-percent * size // 100)) + 1 - (size - count)
        score = np.add.reduceat(np.log2(classes), first) / size
        keep = prefix > 0
        member = np.repeat(keep, count)
        ends = np.concatenate(([0], np.cumsum(count[keep])))
        return pa.Table.from_arrays([pa.array(sig[first][keep].view(np.int64)), pa.array(size[keep]), pa.array(np.minimum(prefix, count)[keep]), pa.array(score[keep]), long_list_of(hashes[member], ends)], ["sig", "n", "prefix", "score", "tokens"])

    counted = _entries(docs, words, parts, known).groupBy("part").applyInArrow(count, _BLOCK)
    if len(known.hot):
        counted = counted.unionAll(_hot_answers(docs, words, parts, known))
    return counted.groupBy("part").applyInArrow(gather, "sig long, n long, prefix long, score double, tokens array<long>")


def long_list_of(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))


def links(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of (u, v) pairs of classes, those whose sets link, by all their shared shingles."""
    a = sets.select(F.col("sig").alias("u"), F.col("n").alias("nu"), F.col("tokens").alias("tu"))
    b = sets.select(F.col("sig").alias("v"), F.col("n").alias("nv"), F.col("tokens").alias("tv"))
    both = F.size(F.array_intersect("tu", "tv")).cast("long")
    joined = pairs.join(a, "u").join(b, "v").withColumn("both", both)
    return joined.where(100 * F.col("both") >= percent * (F.col("nu") + F.col("nv") - F.col("both"))).select("u", "v")


def _may_link(percent: int) -> F.Column:
    """Length and position filter on sides a and b of one prefix shingle, as what each can still share after it."""
    na, nb = F.col("a.n"), F.col("b.n")
    left = F.least(na - F.col("a.pos"), nb - F.col("b.pos"))
    return (100 * na >= percent * nb) & (100 * nb >= percent * na) & ((100 + percent) * left >= percent * (na + nb))


def class_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, root) of the classes that link with another: components of the links."""
    head = F.slice("tokens", 1, F.col("prefix").cast("int"))
    # a prefix with a shingle of its own is no other's
    plain = F.col("n") - F.size("tokens") == 0
    grouped = sets.select("sig", "n", "prefix", "score", F.size("tokens").alias("shared"), head.alias("head"), F.when(plain, F.xxhash64("n", head)).otherwise(F.col("sig")).alias("key"))
    groups = grouped.groupBy("key", "n").agg(F.min("sig").alias("g"), F.count("*").alias("members"))
    member = cut(grouped.join(groups, ["key", "n"]).select("sig", "n", "g", "members", "score", "shared", "head"))
    # pos: shingles before this one in the group's order, those of its own first
    posted = member.where("sig = g").select("g", "n", "members", "score", F.posexplode("head").alias("i", "h"), "shared").withColumn("pos", F.col("i") + F.col("n") - F.col("shared"))
    posted = cut(posted.select("h", "g", "n", "pos", "score", "members"))
    # what is summed up by shingle is cut off before each join by shingle, so that the join's own stage can split a frequent one
    hub = cut(posted.groupBy("h").agg(F.max(F.struct("score", "g", "n", "pos")).alias("s"), F.count("*").alias("k")).where("k > 1").select("h", "s.g", "s.n", "s.pos"))
    first = posted.alias("a").join(hub.alias("b"), "h").where("a.g <> b.g").where(_may_link(percent)).select(F.col("a.g").alias("u"), F.col("b.g").alias("v")).distinct()
    inside = member.where("sig <> g").select(F.col("sig").alias("u"), F.col("g").alias("v"))
    edges = cut(links(first.unionAll(inside), sets, percent))
    roots = cut(connected_components(edges))

    # second round: what is still apart
    placed = cut(member.select("sig", "g", "members").join(roots.withColumnRenamed("u", "sig"), "sig", "left").select("sig", "g", "members", F.coalesce("root", "sig").alias("root")))
    of_group = placed.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    entries = cut(posted.select("h", "g", "n", "pos").join(of_group, "g"))
    apart = cut(entries.groupBy("h").agg(F.min("lo").alias("x"), F.max("hi").alias("y")).where("x <> y").select("h"))
    entries = cut(entries.join(apart, "h"))
    # the component of most entries of a shingle needs no pairs within itself
    most = cut(entries.where("lo = hi").groupBy("h", "lo").count().groupBy("h").agg(F.max(F.struct("count", "lo")).alias("m")).select("h", F.col("m.lo").alias("major")))
    rest = cut(entries.join(most, "h", "left").where("major is null or lo <> major or hi <> major"))
    differ = (F.col("a.lo") != F.col("b.lo")) | (F.col("a.hi") != F.col("b.hi")) | (F.col("a.lo") != F.col("a.hi"))
    second = rest.alias("a").join(entries.alias("b"), "h").where("a.g <> b.g").where(differ).where(_may_link(percent))
    second = second.select(F.least("a.g", "b.g").alias("ga"), F.greatest("a.g", "b.g").alias("gb")).distinct()
    torn = of_group.where("lo <> hi").select(F.col("g").alias("ga"), F.col("g").alias("gb"))
    second = second.unionAll(torn)
    left, right = placed.select(F.col("g").alias("ga"), F.col("sig").alias("u"), F.col("root").alias("ru")), placed.select(F.col("g").alias("gb"), F.col("sig").alias("v"), F.col("root").alias("rv"))
    pairs = second.join(left, "ga").join(right, "gb").where("ru <> rv").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    more = links(pairs, sets, percent)
    return connected_components(edges.unionAll(more))


def _classes(known: Sets, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, least, root) of each set of words: the smallest doc_id with it, and the component it is in."""
    sets = cut(shared_sets(docs, known, words, percent))
    roots = class_links(sets, percent)
    classes = known.rows.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    return cut(classes.join(roots.withColumnRenamed("u", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")))


def near_duplicate_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bits: int = 64) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, the smallest doc_id reachable by links of Jaccard similarity percent / 100 or more.

    Null or wordless texts have no set and are linked with nothing; repeated rows and equal sets are one class; an empty table gives
    no rows; columns other than doc_id and text are ignored. A null doc_id takes part, and is never a component's smallest unless all are null."""
    docs = docs.select("doc_id", "text")
    known = Sets(docs, words, bits=bits)
    meta, classes = known.rows, _classes(known, docs, words, percent)
    leasts = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(leasts, "root").select("sig", "component_id")
    out = meta.where("n_shingles > 0").join(named, "sig").select("doc_id", "n_shingles", "component_id")
    return out.unionAll(meta.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each_class(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component of near duplicates, and every row without words. doc_id needn't name a row: ids may be null or repeated.

    The row kept has the component's smallest doc_id (a null one only if all are null), of several texts with that id the smallest hash, and of rows equal in both
    the smallest in the other columns. All columns stay; they must be orderable."""
    columns = docs.columns
    # two hashes, so that two texts are mistaken for one only under one id and with a chance of 2 ** -128
    keyed = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_x", F.xxhash64("text")).withColumn("_y", F.xxhash64(F.lit(1), "text"))
    known = Sets(keyed, words, ("_x", "_y"))
    meta, classes = known.rows, _classes(known, docs.select("doc_id", "text"), words, percent)
    rows = meta.where("n_shingles > 0").groupBy("sig", "doc_id", "_x", "_y").agg(F.count("*").alias("_n"))
    # a struct with a null sorts first, so that is told apart by a field before it
    first = rows.join(classes.select("sig", "root"), "sig").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_x", "_y", "_n")).alias("s"))
    kept = cut(first.select(F.col("s.doc_id").alias("_k"), "s._x", "s._y", "s._n"))
    found = keyed.join(kept, keyed["_id"].eqNullSafe(kept["_k"]) & (keyed["_x"] == kept["_x"]) & (keyed["_y"] == kept["_y"]), "inner").select(*[keyed[c] for c in (*columns, "_id", "_x", "_y")], "_n")
    repeated = found.where("_n > 1").groupBy("_id", "_x", "_y").agg(F.min(F.struct(*columns)).alias("_row")).select("_row.*")
    wordless = docs.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return found.where("_n = 1").select(*columns).unionAll(repeated).unionAll(wordless)
