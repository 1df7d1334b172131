"""Secret scans with DataFrame functions alone: fixed patterns, and a battery of randomness tests with false-discovery control.

Fixed patterns give the base spans. Beside these, each long run of encoding characters gets an inferred encoding (hex, base32, base36, base62, base64), and
1. under "it is uniform noise in that encoding" a chi-squared test of the alphabet, a runs test and a count test of digits against others, and a lag-1
   serial-correlation test; noise must pass all of them;
2. under "it is ordinary language" a likelihood-ratio test against letter frequencies gathered from all texts. Its p-values go through Benjamini-Hochberg
   control over all candidates of all texts, by stratum of length: short runs, where chance finds are commonest, get the smaller part of the error rate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "random")
# fixed values: the base patterns
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: A candidate of the battery, which may follow the '=' of an assignment or of a query's field, and words of ordinary language: one case, or a capital first.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][a-z]{9,}(?![A-Za-z0-9+/_=-])"
#: What ordinary language is counted by: letters without their case, and digits.
CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
ORDER = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-"
#: A true random run fails one of the tests of uniformity this seldom, in all; the share of false finds that is allowed.
UNIFORM_ALPHA, DISCOVERY_ALPHA = 0.002, 0.001
#: Letters of a word depend on each other, so a p-value made for independent ones counts only from 1e-6 down.
LEAST = 6.0
#: Strata: runs of less than 32, 64, 128 ... characters; bins of -log10(p), half a unit each.
STRATA, BINS, BIN = 12, 120, 0.5
REDACTED = "<SECRET>"
#: Parts of a text, an even number, that are folded together.
BLOCK = 512
_SPANS = "array<struct<start:int,rank:int,end:int,text:string>>"


@dataclass(frozen=True)
class Calibration:
    """Frequencies of characters in ordinary words, and the least -log10(p) of a find in each stratum of length (None: none is)."""

    frequency: tuple[float, ...]
    cutoff: tuple[float | None, ...] = ()


def _safe(text: Column) -> Column:
    """The text with the two marks that spans are cut at replaced by a third control sign: no pattern has any of them, so places stay."""
    return F.translate(F.coalesce(text, F.lit("")), "\x01\x02", "\x03\x03")


def _matches(text: Column, pattern: str, rank: int) -> Column:
    """Leftmost non-overlapping matches with their places in code points: the text is cut at marks around them, and lengths are summed up."""
    none = F.array().cast(_SPANS)
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit("\x01$0\x02")), "[\x01\x02]", -1)

    def step(s: Column, part: Column) -> Column:
        end = s["at"] + F.length(part)
        one = F.struct(s["at"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"), part.alias("text"))
        return F.struct(end.alias("at"), (~s["hit"]).alias("hit"), F.when(s["hit"], F.array_append(s["out"], one)).otherwise(s["out"]).cast(_SPANS).alias("out"))

    def found(some: Column, at: Column) -> Column:
        """Matches of an even number of parts, of which the first is none."""
        return F.aggregate(some, F.struct(at.alias("at"), F.lit(False).alias("hit"), none.alias("out")), step, lambda s: s["out"])

    # arrays that grow in a fold cost the square of their length, so many parts are folded BLOCK at a time, from where each block starts
    blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int"))
    sizes = F.transform(blocks, lambda b: F.aggregate(F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + F.length(x)))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(sizes, first, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])
    whole = F.flatten(F.transform(starts, lambda at, b: found(F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)), at)))
    return F.when(~text.rlike(pattern), none).when(F.size(parts) <= BLOCK, found(parts, F.lit(0))).otherwise(whole)


def base_spans(text: Column) -> Column:
    assign = F.filter(_matches(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 6)
    access = F.filter(_matches(text, ACCESS, 1), lambda s: F.length(s["text"]) >= 20)
    return F.array_sort(F.concat(assign, access, _matches(text, HEX, 2)))


def _tail(z: Column) -> Column:
    """-log10 of the normal distribution's upper tail: a rational approximation near the middle, the asymptotic series beyond 4."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    near = F.exp(-x * x / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    near = F.when(z < 0, 1 - near).otherwise(near)
    far = (x * x / 2 + F.log(x * math.sqrt(2 * math.pi)) - F.log(1 - 1 / (x * x) + 3 / (x * x * x * x))) / math.log(10)
    return F.when(z > 4, far).otherwise(-F.log10(F.greatest(near, F.lit(1e-300))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _more(items: Column, keep: str, **new) -> Column:
    """Each struct's fields named in `keep`, and new ones made from it: what a later step asks for often is worked out once."""
    return F.transform(items, lambda r: F.struct(*[r[k].alias(k) for k in keep.split()], *[f(r).alias(k) for k, f in new.items()]))


def battery(runs: Column, frequency: tuple[float, ...]) -> Column:
    """Of structs with start, end and text: start, end, size, uniform (the worst -log10(p) of the tests of uniformity) and language (the -log10(p) of ordinary language)."""
    x = _more(runs, "start end", body=lambda r: F.rtrim(r["text"], F.lit("=")))
    signs = lambda r: F.filter(F.split(r["body"], ""), lambda c: c != "")
    x = _more(x, "start end body", n=lambda r: F.length(r["body"]).cast("double"), signs=signs)
    x = _more(
        x, "start end body n",
        letters=lambda r: F.array_distinct(r["signs"]),
        value=lambda r: F.transform(r["signs"], lambda c: F.instr(F.lit(ORDER), c).cast("double")),
        size=lambda r: F.when(r["body"].rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(r["body"].rlike("^[A-Z2-7]+$"), 32).when(r["body"].rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36).when(r["body"].rlike("^[0-9A-Za-z]+$"), 62).otherwise(64).cast("double"),
        digits=lambda r: r["n"] - F.length(F.regexp_replace(r["body"], "[0-9]", "")),
        turns=lambda r: F.regexp_count(r["body"], F.lit("(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])")) + 1,
    )
    x = _more(
        x, "start end n letters value size digits turns",
        count=lambda r: F.transform(r["letters"], lambda c: (r["n"] - F.length(F.replace(r["body"], c, F.lit("")))).cast("double")),
        middle=lambda r: _sum(r["value"]) / r["n"],
        share=lambda r: F.when(r["size"] == 32, 6).otherwise(10) / r["size"],
        mean=lambda r: 2 * r["digits"] * (r["n"] - r["digits"]) / r["n"] + 1,
        k=lambda r: 2 / (9 * (r["size"] - 1)),
    )
    x = _more(
        x, "start end n letters size digits turns count share mean k",
        centred=lambda r: F.transform(r["value"], lambda v: v - r["middle"]),
        chi=lambda r: r["size"] / r["n"] * _sum(F.transform(r["count"], lambda c: c * c)) - r["n"],
    )
    x = _more(
        x, "start end n letters size digits turns count share mean k chi",
        square=lambda r: _sum(F.transform(r["centred"], lambda v: v * v)),
        along=lambda r: _sum(F.zip_with(F.slice(r["centred"], F.lit(1), F.size(r["centred"]) - 1), F.slice(r["centred"], F.lit(2), F.size(r["centred"]) - 1), lambda a, b: a * b)),
    )
    # ordinary language: mean and variance of the log frequencies under the frequencies themselves
    logs = [math.log(q) for q in frequency]
    mu = sum(q * v for q, v in zip(frequency, logs, strict=True))
    var = max(sum(q * (v - mu) ** 2 for q, v in zip(frequency, logs, strict=True)), 1e-9)
    # neither case nor the signs that also join ordinary words tell anything
    logs_of = dict(zip(CHARACTERS, logs, strict=True))
    table = F.map_from_arrays(F.lit(list(ORDER)), F.lit([logs_of.get(c.lower(), mu) for c in ORDER]))
    spread = lambda r: F.sqrt(F.greatest((r["mean"] - 1) * (r["mean"] - 2) / (r["n"] - 1), F.lit(1e-9)))
    x = _more(
        x, "start end n",
        # alphabet: chi-squared over size - 1 degrees, made normal by its cube root
        a=lambda r: (F.pow(F.greatest(r["chi"], F.lit(0.0)) / (r["size"] - 1), F.lit(1 / 3)) - (1 - r["k"])) / F.sqrt(r["k"]),
        b=lambda r: F.abs(r["digits"] - r["n"] * r["share"]) / F.sqrt(r["n"] * r["share"] * (1 - r["share"])),
        c=lambda r: F.when((r["digits"] > 0) & (r["digits"] < r["n"]), F.abs(r["turns"] - r["mean"]) / spread(r)).otherwise(0.0),
        d=lambda r: F.when(r["square"] > 0, F.abs(r["along"] / r["square"] + 1 / r["n"]) * F.sqrt(r["n"])).otherwise(99.0),
        e=lambda r: (r["n"] * mu - _sum(F.zip_with(r["letters"], r["count"], lambda c, m: F.coalesce(F.try_element_at(table, c), F.lit(min(logs))) * m))) / F.sqrt(r["n"] * var),
    )
    two = math.log10(2)
    return _more(x, "start end", size=lambda r: r["n"].cast("int"), uniform=lambda r: F.greatest(_tail(r["a"]), _tail(r["b"]) - two, _tail(r["c"]) - two, _tail(r["d"]) - two), language=lambda r: _tail(r["e"]))


def _stratum(size: Column) -> Column:
    return F.least(F.greatest(F.floor(F.log2(size / 32.0)) + 1, F.lit(0)), F.lit(STRATA - 1)).cast("int")


def candidates(text: Column, base: Column, frequency: tuple[float, ...]) -> Column:
    """Runs outside the base spans that pass the tests of uniformity, with their stratum and language -log10(p); numbers are none."""
    runs = F.filter(_matches(text, RUN, 3), lambda r: ~r["text"].rlike("^[0-9+/_=-]*$") & ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return _more(battery(runs, frequency), "start end language", stratum=lambda r: _stratum(r["size"]), uniform=lambda r: r["uniform"] <= -math.log10(UNIFORM_ALPHA / 4))


def letter_frequencies(docs: DataFrame) -> tuple[float, ...]:
    """Shares of the encoding characters in the long plain words of all texts, one of each counted beside; at most one number per character reaches the driver."""
    words = docs.select(F.explode(F.regexp_extract_all(_safe(F.col("text")), F.lit(WORD), 0)).alias("w")).select(F.lower("w").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    counts = {r.c: r.n for r in words.select(F.explode(F.split("w", "")).alias("c"), "n").where("c <> ''").groupBy("c").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.get(c, 0) + 1 for c in CHARACTERS)
    return tuple((counts.get(c, 0) + 1) / total for c in CHARACTERS)


def cutoffs(found: DataFrame) -> tuple[float | None, ...]:
    """Benjamini-Hochberg by stratum over rows (stratum, uniform, language): binned p-values, each bin taken at its larger edge, so the error rate holds.

    A stratum's part of the rate is in proportion to its characters' length. Only strata x bins numbers are ordered."""
    bins = found.select("stratum", F.least(F.floor(F.greatest("language", F.lit(0.0)) / BIN), F.lit(BINS - 1)).cast("int").alias("bin")).groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    cumulated = bins.select("stratum", "bin", F.sum("n").over(down).alias("over"), F.sum("n").over(Window.partitionBy("stratum")).alias("all"))
    best: dict[int, float] = {}
    weight = [2.0**s for s in range(STRATA)]
    for r in cumulated.collect():
        alpha = DISCOVERY_ALPHA * min(1.0, weight[r.stratum] / 4)
        if r["all"] * 10 ** (-r.bin * BIN) / r.over <= alpha:
            best[r.stratum] = min(best.get(r.stratum, 1e9), r.bin * BIN)
    return tuple(None if (c := best.get(s)) is None else max(c, LEAST) for s in range(STRATA))


def _finds(tested: Column, calibration: Calibration) -> Column:
    cut = F.array(*[F.lit(c).cast("double") for c in calibration.cutoff])
    return F.filter(tested, lambda t: t["uniform"] & F.coalesce(t["language"] >= cut[t["stratum"]], F.lit(False)))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def calibrate(docs: DataFrame) -> Calibration:
    """Letter frequencies, then the cutoffs of all candidates of all texts."""
    frequency = letter_frequencies(docs)
    safe = docs.select(_safe(F.col("text")).alias("safe")).where(F.col("safe").rlike(RUN))
    rows = safe.select("safe", base_spans(F.col("safe")).alias("base"))
    tested = rows.select(F.inline(candidates(F.col("safe"), F.col("base"), frequency)))
    return Calibration(frequency, cutoffs(tested))


def scan(docs: DataFrame, calibration: Calibration | None = None) -> DataFrame:
    """docs with `base` and `all_spans` (start, rank in KINDS, end; code points, end exclusive), ordered by start, then kind.

    Null text: empty, no spans. Empty table: no rows. Repeated rows: each on its own. Other columns stay; columns named base, all_spans, safe or tested are replaced."""
    calibration = calibration or calibrate(docs)
    rows = docs.withColumn("safe", _safe(F.col("text"))).withColumn("base", base_spans(F.col("safe")))
    rows = rows.withColumn("tested", candidates(F.col("safe"), F.col("base"), calibration.frequency))
    more = F.transform(_finds(F.col("tested"), calibration), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("rank"), t["end"].alias("end")))
    own = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return rows.withColumn("base", own).withColumn("all_spans", F.array_sort(F.concat("base", more))).drop("safe", "tested")


def _of_rank(rank: int):
    return lambda s: s["rank"] == rank


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per row; n_random beside."""
    rows = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    n = {k: F.size(F.filter("all_spans", _of_rank(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)}
    return rows.select("doc_id", n["assign"], n["access"], n["hex"], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all_spans")).alias("spans"), n["random"])


def redact(docs: DataFrame, calibration: Calibration | None = None) -> DataFrame:
    """docs with every span in text replaced by REDACTED, spans that overlap as one, and n_chars counted anew. Rows without spans stay as they are; none is dropped, and all columns stay."""
    rows = scan(docs.select(F.struct("*").alias("_row"), "text"), calibration)

    def step(s: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= s["at"], F.concat(F.col("text").substr(s["at"] + 1, x["start"] - s["at"]), F.lit(REDACTED))).otherwise("")
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], gap).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate("all_spans", start, step, lambda s: F.concat(s["out"], F.col("text").substr(s["at"] + 1, F.length("text"))))
    found = F.size("all_spans") > 0
    rows = rows.withColumn("_found", found).withColumn("_new", F.when(found, rest).otherwise(F.col("text")))
    new = {"text": F.col("_new"), "n_chars": F.when(F.col("_found"), F.length("_new").cast("long")).otherwise(F.col("_row")["n_chars"]) if "n_chars" in docs.columns else None}
    return rows.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns])
