"""Quality rules with DataFrame functions alone: fixed counts, and robust multivariate outliers by language and source.

The verdict is by minimum covariance determinant: of several starts in each group (medians and median deviations, and random subsets) concentration steps keep
the three quarters of rows that are nearest by Mahalanobis distance and take mean and covariance from these; the start whose covariance has the least determinant
goes on until it changes no more; at last a row whose distance is beyond the cutoff is rejected.
All of it is grouped sums and mergeable quantiles on a narrow table, so a group of any size is combined before it is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, cut

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SPACES = "\x20\t\n\x0b\x0c\r"
_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Share of rows a concentration step keeps; the least rows of a group, smaller ones are taken together by language, then all.
KEEP, LEAST_ROWS = 0.75, 50
#: Starts beside the medians' with the rows of each on average, steps of all starts, then most steps of the best, and the change of the determinant's logarithm that ends them.
STARTS, SUBSET, TRIAL, STEPS, STILL = 4, 16, 2, 20, 1e-4
#: Of quantiles: ranks are right to one in so many.
RANKS = 10_000
#: The 97.5 % point of chi-squared in four dimensions, and what the covariance of the nearest three quarters is short of that of all: 0.75 / P(chi-squared in six <= 5.385).
CUTOFF, CONSISTENCY = 11.143, 1.486
#: Statistics and the spread that each has at least, where its estimate is smaller: log mean word length, symbols a word, share of capitals, share of repeated lines.
SPREADS = {"x1": 0.15, "x2": 0.5, "x3": 0.3, "x4": 0.6}
#: What is added to every spread, in squares, so that no covariance is singular.
FLOORS = {x: s / 100 for x, s in SPREADS.items()}
_X = tuple(FLOORS)
_PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]


def text_counts(docs: DataFrame) -> DataFrame:
    """docs with the base counts, and n_lines and n_capitals, of each whole text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    w = docs.withColumn("_t", t).withColumn("_w", F.filter(F.split("_t", _GAP), lambda x: x != ""))
    w = w.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    w = w.withColumn("n_words", F.size("_w").cast("long")).withColumn("word_chars", F.length(F.translate("_t", SPACES, "")).cast("long"))
    at = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))).otherwise(F.array().cast("array<int>"))
    w = w.withColumn("_v", F.transform(at, lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)])))
    twice = F.size(F.array_distinct("_v")) < F.size("_v")
    ranked = F.when(twice, F.array_sort(F.transform("_v", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    w = w.withColumn("_s", ranked)
    same = F.filter("_s", lambda x, i: ((i > 0) & (F.get("_s", i - 1)["h"] == x["h"])) | F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False)))
    w = w.withColumn("_p", F.array_sort(F.transform(same, lambda x: x["i"])))
    # words under a repeated window: each window adds what the next doesn't cover
    cover = F.aggregate(F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    w = w.withColumn("n_repeat_words", F.when(F.size("_p") > 0, cover).otherwise(0).cast("long"))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    w = w.withColumn("_l", lines).withColumn("n_lines", F.size("_l").cast("long")).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    w = w.withColumn("n_symbols", (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"))
    w = w.withColumn("n_capitals", (F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"))
    return w.drop("_t", "_w", "_h", "_v", "_s", "_p", "_l")


def statistics(counts: DataFrame) -> DataFrame:
    """The four transformed statistics; a text without words has them all 0."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return counts.withColumns({"x1": F.log(chars / n), "x2": F.log1p(10 * F.col("n_symbols") / n), "x3": F.log1p(10 * F.col("n_capitals") / chars), "x4": F.log1p(10 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))})


def _grouped(stats: DataFrame) -> DataFrame:
    """Adds g, the group by which a row is judged: language and source, or what these leave too few rows."""
    lang, source = F.coalesce("lang", F.lit("\x00")), F.coalesce("source", F.lit("\x00"))
    stats = stats.withColumn("_a", lang).withColumn("_b", F.concat_ws("\x01", lang, source))
    fine = cut(stats.groupBy("_b").agg(F.first("_a").alias("_l"), F.count("*").alias("_n")))
    coarse = fine.where(F.col("_n") < LEAST_ROWS).groupBy("_l").agg(F.sum("_n").alias("_m"))
    g = F.when(F.col("_n") >= LEAST_ROWS, F.col("_k")).when(F.col("_m") >= LEAST_ROWS, F.col("_l")).otherwise("")
    named = cut(fine.join(coarse, "_l", "left").select(F.col("_b").alias("_k"), "_n", "_m", "_l").select("_k", g.alias("g")))
    return beside(stats, named, F.col("_b") == F.col("_k"), named.count()).drop("_a", "_b", "_k")


def _factor(c: dict[tuple[int, int], Column]) -> dict[tuple[int, int], Column]:
    """Cholesky factor of a 4 x 4 covariance; columns are named as they are made, so no entry is written out twice."""
    out = {}
    for i, j in _PAIRS:
        rest = c[i, j]
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}")
    return out


def _variance(estimate: Column, x: str) -> Column:
    """A variance that is the least spread's at least, and a little more."""
    return F.greatest(estimate, F.lit(SPREADS[x] ** 2)) + FLOORS[x] ** 2


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d, the squared Mahalanobis distance, by forward substitution in the factor."""
    for i in range(4):
        rest = F.col(_X[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"_y{k}")
        rows = rows.withColumn(f"_y{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d", sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(1, 4)), F.col("_y0") * F.col("_y0"))).drop(*[f"_y{i}" for i in range(4)])


_M, _L = [f"m{i}" for i in range(4)], [f"l{i}{j}" for i, j in _PAIRS]


def _estimate(sums: DataFrame, keys: list[str], variances: dict[tuple[int, int], Column]) -> DataFrame:
    """Location, Cholesky factor and det, the logarithm of the covariance's determinant."""
    for (i, j), entry in _factor({p: v if p[0] != p[1] else _variance(v, _X[p[0]]) for p, v in variances.items()}).items():
        sums = sums.withColumn(f"l{i}{j}", entry)
    return sums.select(*keys, *_M, *_L, (2 * sum((F.log(F.col(f"l{i}{i}")) for i in range(1, 4)), F.log(F.col("l00")))).alias("det"))


def _moments(over: Column) -> list[Column]:
    """Sums, over rows for which `over` holds, of 1, the statistics about m0..m3, and their products."""
    x = [F.when(over, F.col(n) - F.col(m)) for n, m in zip(_X, _M)]
    return [F.count_if(over), *[F.sum(v) for v in x], *[F.sum(x[i] * x[j]) for i, j in _PAIRS]]


def _step(rows: DataFrame, estimate: DataFrame, keys: list[str], n: int) -> DataFrame:
    """One concentration step of each estimate: exactly KEEP of a group's rows count; of rows at the last distance each counts in part."""
    estimate = estimate.withColumnRenamed("g", "_g")
    near = _distance(beside(rows, estimate, F.col("g") == F.col("_g"), n, "inner"))
    limit = near.groupBy(*keys).agg(F.percentile_approx("d", KEEP, RANKS).alias("h"), F.count("*").alias("all"))
    limit = cut(limit.select(*[F.col(k).alias(f"_{k}") for k in keys], "h", "all"))
    same = F.col("g") == F.col("_g")
    for k in keys[1:]:
        same &= F.col(k) == F.col(f"_{k}")
    near = beside(near.drop("_g"), limit, same, n, "inner")
    names = ["n", *[f"e{i}" for i in range(4)], *[f"p{i}{j}" for i, j in _PAIRS]]
    inside, edge = ([c.alias(f"{t}_{name}") for c, name in zip(_moments(over), names)] for t, over in (("in", F.col("d") < F.col("h")), ("at", F.col("d") == F.col("h"))))
    sums = near.groupBy(*keys).agg(F.first("all").alias("all"), *[F.first(m).alias(m) for m in _M], *inside, *edge)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (KEEP * F.col("all") - F.col("in_n")) / F.greatest(F.col("at_n"), F.lit(1))))
    whole = lambda name: F.coalesce(F.col(f"in_{name}"), F.lit(0.0)) + F.col("_w") * F.coalesce(F.col(f"at_{name}"), F.lit(0.0))
    sums = sums.withColumn("_w", part).select(*keys, *_M, *[whole(name).alias(name) for name in names])
    sums = sums.select(*keys, *_M, *[(F.col(name) / F.col("n")).alias(name) for name in names[1:]])
    spread = {(i, j): (F.col(f"p{i}{j}") - F.col(f"e{i}") * F.col(f"e{j}")) * CONSISTENCY for i, j in _PAIRS}
    sums = sums.select(*keys, *[(F.col(m) + F.col(f"e{i}")).alias(m) for i, m in enumerate(_M)], *[v.alias(f"c{i}{j}") for (i, j), v in spread.items()])
    return cut(_estimate(sums, keys, {(i, j): F.col(f"c{i}{j}") for i, j in _PAIRS}))


def robust_estimates(rows: DataFrame) -> DataFrame:
    """(g, m0..m3, l00..l33, det): location and Cholesky factor of each group by minimum covariance determinant. Rows need g and the four statistics, without nulls; no rows: no groups."""
    rows = cut(rows.select("g", *_X))
    sizes = cut(rows.groupBy("g").agg(F.count("*").alias("_n"), *[F.percentile_approx(x, 0.5, RANKS).alias(f"m{i}") for i, x in enumerate(_X)]).withColumnRenamed("g", "_g"))
    n = sizes.count()
    placed = beside(rows, sizes, F.col("g") == F.col("_g"), n, "inner")
    off = placed.groupBy("g").agg(*[F.first(m).alias(m) for m in _M], *[F.percentile_approx(F.abs(F.col(x) - F.col(m)), 0.5, RANKS).alias(f"s{i}") for i, (x, m) in enumerate(zip(_X, _M))])
    middle = _estimate(off, ["g"], {(i, j): F.pow(1.4826 * F.col(f"s{i}"), F.lit(2)) if i == j else F.lit(0.0) for i, j in _PAIRS}).withColumn("start", F.lit(0))
    picks = F.filter(F.array(*[F.when(F.rand(17 + k) < SUBSET / F.col("_n"), F.lit(k)) for k in range(1, STARTS + 1)]), lambda k: k.isNotNull())
    some = placed.select("g", *_X, F.explode(picks).alias("start")).groupBy("g", "start").agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(_X)], *[F.covar_pop(_X[i], _X[j]).alias(f"c{i}{j}") for i, j in _PAIRS])
    starts = cut(middle.unionByName(_estimate(some, ["g", "start"], {(i, j): F.col(f"c{i}{j}") for i, j in _PAIRS})))
    for _ in range(TRIAL):
        starts = _step(rows, starts, ["g", "start"], n * (STARTS + 1))
    best = cut(starts.groupBy("g").agg(F.min_by(F.struct(*_M, *_L, "det"), F.struct("det", "start")).alias("s")).select("g", "s.*"))
    for _ in range(STEPS):
        following = _step(rows, best, ["g"], n)
        change = following.select("g", F.col("det").alias("_d")).join(best, "g").agg(F.max(F.abs(F.col("_d") - F.col("det")))).first()[0]
        best = following
        if change is None or change < STILL:
            break
    return best


def quality(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, lang, source): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; distance beside.

    Null text: no words, so base_failed. Null lang or source: a group of its own. Repeated rows: judged alike. Empty table: no rows. Other columns are ignored.
    The estimates are made from the rows that pass the base rules; a group without any has no verdict but the base rules'."""
    counts = text_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")).drop("text")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = cut(statistics(counts.withColumn("base_failed", failed)))
    rows = cut(_grouped(rows))
    estimate = robust_estimates(rows.where("not base_failed").select("g", *_X))
    judged = _distance(beside(rows, estimate.withColumnRenamed("g", "_g"), F.col("g") == F.col("_g"), estimate.count()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d") <= CUTOFF, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d").alias("distance"))
