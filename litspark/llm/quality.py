"""Quality rules: robust multivariate outliers by the minimum covariance determinant.

Each document gets text statistics and a vector of five transformed ones. For every group of language and source the
location and scatter of the majority are estimated by the minimum covariance determinant (MCD): from two deterministic
starts, concentration steps keep the share ``majority`` of the rows with the smallest Mahalanobis distance and estimate
again, until the logarithm of the determinant moves by less than ``SETTLED``; only groups that still move are estimated
again. The start that ends with the smaller one wins and is reweighted once. A document is rejected if its
squared Mahalanobis distance from the estimate is over ``cutoff``, the quantile that normal rows exceed with ``TAIL``.

All of it is grouped aggregation. Vectors are integers (thousandths), so that sums don't depend on the order of rows and
reruns agree. Equal vectors are counted first, so copies and large groups cost one row per partition. The share is found
as an exact percentile of binned distances, whose aggregation buffer is bounded by the number of bins, so no group is
ever sorted in one task.

Defined cases: null or empty text has no words and fails the base rules; null language or source is a value of its own;
groups with under ``min_group`` usable rows are pooled by language, then altogether, and below that the base rules alone
decide; repeated rows count as often as they occur; other columns are carried unchanged and may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.llm.common import has_word, let, saved, word_array

SYMBOLS = "[#*$%&|<>]+"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
P = 5
#: Least standard deviation of each transformed statistic, in thousandths: a group that is constant in one of them
#: must not reject a small deviation. For the logarithms of length, word length and symbols, and the two shares.
#: With the cutoff of 20.5 each can reject alone, in a group without it at over 14% copied lines or 9% repeated words.
FLOORS = (500, 80, 250, 600, 500)
#: share of the rows of a normal group that is over the cutoff
TAIL = 0.001
#: a determinant that moves by less than this share is settled
SETTLED = 0.01
UNIT = 1000
BINS = 40


def repeat_words(words: Column, width: int = 5) -> Column:
    """Number of words inside of windows of ``width`` words that occur twice or more in the text, first ones included."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - width),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]),
    )

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - p, F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def of_sorted(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda e, i: F.coalesce(e["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False)),
        )
        return let(F.array_sort(F.transform(twice, lambda e: e["i"])), covered)

    def of_hashes(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), of_sorted))

    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(let(windows, of_hashes))


def text_statistics(text: Column) -> Column:
    """Struct of the base statistics, all long, and of the number of lines that have a word."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), has_word)

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeat_words(words).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return F.struct(
        let(word_array(text), of_words).alias("w"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, of_lines).alias("l"),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with a struct ``__quality`` of statistics, base verdict and the vector x0 to x4 in thousandths."""
    q = F.col("__quality")
    df = docs.withColumn("__quality", text_statistics(F.col("text")))
    df = df.withColumn(
        "__quality",
        F.struct(q["w"]["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"), q["l"]["n_dup_lines"].alias("n_dup_lines"), q["w"]["n_repeat_words"].alias("n_repeat_words"), q["l"]["n_lines"].alias("n_lines")),
    )
    per = lambda a, b: F.col(f"__quality.{a}") / F.greatest(F.col(f"__quality.{b}"), F.lit(1))
    vector = [
        F.log1p(q["n_words"]),
        F.log1p(per("word_chars", "n_words")),
        F.log1p(100 * per("n_symbols", "word_chars")),
        F.log1p(100 * per("n_dup_lines", "n_lines")),
        F.log1p(100 * per("n_repeat_words", "n_words")),
    ]
    failed = (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])
    return df.withColumn(
        "__quality",
        F.struct(*[q[c].alias(c) for c in STATS], failed.alias("base_failed"), *[F.round(UNIT * x).cast("long").alias(f"x{i}") for i, x in enumerate(vector)]),
    )


def chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-square with k degrees of freedom, by its power series."""
    term = total = 1.0 / (k / 2)
    for n in range(1, 400):
        term *= (x / 2) / (k / 2 + n)
        total += term
    return total * math.exp(-x / 2 + (k / 2) * math.log(x / 2) - math.lgamma(k / 2))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 1e-9, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return low


CUTOFF = chi2_quantile(1 - TAIL, P)


def consistency(share: float, k: int = P) -> float:
    """Factor that makes the covariance of the central ``share`` of a normal sample consistent."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2)


def with_cholesky(df: DataFrame, scale: float) -> DataFrame:
    """From means m0.. and covariances c00.. the lower factor l00.. of scale * covariance + floors, and its log determinant."""
    for j in range(P):
        inner = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") * scale + float(FLOORS[j] ** 2) - inner, F.lit(1.0))))
        df = df.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") * scale - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    return df.withColumn("log_det", sum((F.log(F.col(f"l{j}{j}")) for j in range(P)), F.lit(0.0)))


FACTOR = [f"l{i}{j}" for i in range(P) for j in range(i + 1)]
STATE = [f"m{i}" for i in range(P)] + FACTOR + ["log_det"]


def with_distance(df: DataFrame, x, to: str = "d2") -> DataFrame:
    """Squared Mahalanobis distance of the vector columns x(0).. by forward substitution in the factor."""
    for i in range(P):
        df = df.withColumn(f"z{i}", (x(i) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return df.withColumn(to, sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0))).drop(*[f"z{i}" for i in range(P)])


def moments(df: DataFrame, keys: list[str], x, unit: float = 1.0) -> DataFrame:
    """Means and covariances by weight n, from sums of integers, which are exact in any order."""
    sums = [F.sum("n").alias("n")] + [F.sum(x(i) * F.col("n")).alias(f"s{i}") for i in range(P)]
    # long sums of numbers of about 10,000 squared hold for some 10 ** 10 rows of a group; more would fail, not go wrong
    sums += [F.sum(x(i) * x(j) * F.col("n")).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)]
    df = df.groupBy(*keys).agg(*sums).withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(P)})
    df = df.withColumns({f"c{i}{j}": (F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) / unit**2 for i in range(P) for j in range(i + 1)})
    return df.select(*keys, "n", *[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i in range(P) for j in range(i + 1)])


def group_key(*cols: str) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in cols]))


def small_side(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table of one short row for each group, broadcast up to ``most`` rows; a larger one is joined by shuffle."""
    return F.broadcast(table) if table.count() <= most else table


def assign_groups(stats: DataFrame, min_group: int) -> DataFrame:
    """(key, grp): of each key of language and source the group that is estimated together; null if there are too few rows."""
    sizes = stats.groupBy("key", "lang_key").agg(F.sum("n").alias("n"))
    sizes = sizes.withColumn("small", F.col("n") < min_group)
    langs = sizes.filter("small").groupBy("lang_key").agg(F.sum("n").alias("n_lang"))
    total = langs.filter(F.col("n_lang") < min_group).agg(F.coalesce(F.sum("n_lang"), F.lit(0)).alias("n_rest"))
    found = sizes.join(langs, "lang_key", "left").crossJoin(F.broadcast(total))  # one row
    grp = F.when(~F.col("small"), F.col("key")).when(F.col("n_lang") >= min_group, F.col("lang_key")).when(F.col("n_rest") >= min_group, F.lit("{}"))
    return found.select("key", grp.alias("grp"))


def fit(stats: DataFrame, min_group: int = 50, majority: float = 0.75, steps: int = 20) -> DataFrame:
    """Estimates by key of language and source: key, means and factor of the reweighted MCD of its group.

    stats: key, lang_key, x0 to x4, of the rows that pass the base rules. Concentration steps never raise a determinant
    but by the floors, so they end long before ``steps``, which only guards against an estimate that swings.
    """
    xs = [f"x{i}" for i in range(P)]
    x = lambda i: F.col(f"x{i}")
    counted = saved(stats.groupBy("key", "lang_key", *xs).agg(F.count(F.lit(1)).alias("n")), "vectors")
    groups = saved(assign_groups(counted, min_group), "groups")
    rows = saved(counted.join(small_side(groups).filter("grp IS NOT NULL"), "key").groupBy("grp", *xs).agg(F.sum("n").alias("n")), "rows")

    # Start 0: medians and median absolute deviations. Start 1: covariance of the same after tanh.
    med = rows.groupBy("grp").agg(*[F.expr(f"percentile(x{i}, 0.5, n)").alias(f"m{i}") for i in range(P)])
    med = small_side(saved(med, "medians"))
    mad = rows.join(med, "grp").groupBy("grp").agg(*[F.expr(f"percentile(round(abs(x{i} - m{i})), 0.5, n)").alias(f"a{i}") for i in range(P)])
    base = saved(med.join(mad, "grp").withColumns({f"a{i}": F.sqrt(F.pow(1.4826 * F.col(f"a{i}"), 2) + float(FLOORS[i] ** 2)) for i in range(P)}), "starts")
    base = small_side(base)
    flat = {f"c{i}{j}": (F.col(f"a{i}") * F.col(f"a{i}") if i == j else F.lit(0.0)) for i in range(P) for j in range(i + 1)}
    first = with_cholesky(base.withColumns(flat), 1.0).withColumn("start", F.lit(0)).select("grp", "start", *STATE)
    soft = rows.join(base, "grp").withColumns({f"y{i}": F.round(UNIT * F.tanh((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"a{i}"))).cast("long") for i in range(P)})
    soft = moments(soft, ["grp"], lambda i: F.col(f"y{i}"), UNIT).drop("n", *[f"m{i}" for i in range(P)]).join(base, "grp")
    soft = soft.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") * F.col(f"a{i}") * F.col(f"a{j}") for i in range(P) for j in range(i + 1)})
    second = with_cholesky(soft, 1.0).withColumn("start", F.lit(1)).select("grp", "start", *STATE)
    state = saved(first.unionByName(second), "state")

    def near(state: DataFrame, keys: list[str]) -> DataFrame:
        return with_distance(rows.join(small_side(state), "grp"), x).withColumn("bin", F.floor(BINS * F.log1p("d2")).cast("int")).select(*keys, *xs, "n", "bin")

    settled = state.limit(0)
    for _ in range(steps):
        seen = near(state, ["grp", "start"])
        # one row a group: written, so that its size is known and the rows needn't be dealt by group to meet it
        cut = small_side(saved(seen.groupBy("grp", "start").agg(F.expr(f"percentile(bin, {majority}, n)").alias("cut")), "cut"))
        new = with_cholesky(moments(seen.join(cut, ["grp", "start"]).filter("bin <= cut"), ["grp", "start"], x), consistency(majority)).select("grp", "start", *STATE)
        new = saved(new.join(small_side(state).select("grp", "start", F.col("log_det").alias("before")), ["grp", "start"]), "state")
        moves = F.abs(F.col("log_det") - F.col("before")) > SETTLED
        settled, state = settled.unionByName(new.filter(~moves).drop("before")), new.filter(moves).drop("before")
        if state.isEmpty():
            break
    state = settled.unionByName(state)

    best = saved(state.groupBy("grp").agg(F.min_by(F.struct("start", *STATE), F.struct("log_det", "start")).alias("s")).select("grp", "s.*"), "best")
    keep = near(best, ["grp"]).filter(F.col("bin") <= int(BINS * math.log1p(chi2_quantile(0.975, P))))
    final = with_cholesky(moments(keep, ["grp"], x), consistency(0.975)).select("grp", *STATE)
    return saved(groups.join(final, "grp").drop("grp"), "estimates")


def described(docs: DataFrame, *columns: Column) -> DataFrame:
    """The given columns with ``__quality`` and keys of language and source, written once. docs: text, lang, source."""
    df = with_statistics(docs).withColumns({"__key": group_key("lang", "source"), "__lang_key": group_key("lang")})
    return saved(df.select(*columns, "__quality", "__key", "__lang_key"), "statistics")


def stats_of(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("__quality.base_failed")).select(F.col("__key").alias("key"), F.col("__lang_key").alias("lang_key"), *[F.col(f"__quality.x{i}") for i in range(P)])


def scored(df: DataFrame, estimates: DataFrame, cutoff: float) -> DataFrame:
    """df of ``described``, with distance2 (null without an estimate) and kept in ``__quality``."""
    q = F.col("__quality")
    out = with_distance(df.join(small_side(estimates.withColumnRenamed("key", "__key")), "__key", "left"), lambda i: F.col(f"__quality.x{i}"), "__d2")
    kept = ~q["base_failed"] & F.coalesce(F.col("__d2") <= cutoff, F.lit(True))
    return out.withColumn("__quality", q.withField("distance2", F.when(~q["base_failed"], F.col("__d2"))).withField("kept", kept))


def mcd_quality(docs: DataFrame, cutoff: float = CUTOFF, **fit_options) -> DataFrame:
    """One row per row of docs: doc_id, the statistics, base_failed, distance2 and kept."""
    df = described(docs.select("doc_id", "text", "lang", "source"), F.col("doc_id"))
    out = scored(df, fit(stats_of(df), **fit_options), cutoff)
    return out.select("doc_id", *[f"__quality.{c}" for c in [*STATS, "base_failed", "distance2", "kept"]])


def filter_quality(docs: DataFrame, cutoff: float = CUTOFF, **fit_options) -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    Rows are written with their statistics as one struct, so texts are scanned once and columns may have any name.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    df = described(docs.select(whole, F.col("text"), F.col("lang"), F.col("source")), F.col("__row"))
    out = scored(df, fit(stats_of(df), **fit_options), cutoff).filter("__quality.kept")
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
