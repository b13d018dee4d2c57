"""Bibliographic records: cleaning, scoring, classifying, dedup and ranking. Tables in, tables out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.functions.text import contains_any, count_terms, norm_doi, norm_title


def empty(col: Column) -> Column:
    return F.coalesce(F.trim(col), F.lit("")) == ""


def clean_records(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """df with ``reason``: the first rule whose condition holds, null for records to keep. All reasons are counted."""
    reason = F.lit(None).cast("string")
    for name, bad in reversed(rules):
        reason = F.when(bad, F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason)


def record_rules(author: str, summary: str, keyword: str, short: int = 200) -> list[tuple[str, Column]]:
    """Missing author, summary or keyword, and notices marked as such that are short."""
    text = F.col(summary)
    return [("no_author", empty(F.col(author))), ("no_summary", empty(text)), ("no_keyword", empty(F.col(keyword))), ("short_notice", text.startswith("<正>") & (F.length(text) < short))]


def reason_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def exclude_terms(df: DataFrame, col: str, terms: list[str]) -> DataFrame:
    return df.filter(~contains_any(F.coalesce(F.col(col), F.lit("")), terms))


def require_terms(df: DataFrame, col: str, terms: list[str]) -> DataFrame:
    return df.filter(contains_any(F.col(col), terms))


def match_terms(col: Column, terms: list[str]) -> Column:
    """The terms that the text contains, in the order of the dictionary."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(col, t))


def score_quality(df: DataFrame, summary: str, full: Column, depth_terms: tuple[list[str], list[str]], value_terms: tuple[list[str], list[str]], topic_terms: tuple[list[str], list[str]]) -> DataFrame:
    """df with depth, value, topical, quality and level.

    Depth and value grow with the summary's length and by one for each of two groups of terms, 5 at most.
    """
    text, n = F.coalesce(F.col(summary), F.lit("")), F.length(F.coalesce(F.col(summary), F.lit("")))

    def grade(long: int, mid: int, groups: tuple[list[str], list[str]]) -> Column:
        base = F.when(n > long, 3).when(n > mid, 2).otherwise(1)
        return reduce(lambda acc, g: F.least(F.lit(5), acc + contains_any(text, g).cast("int")), groups, base)

    df = df.withColumns({"depth": grade(300, 150, depth_terms), "value": grade(200, 100, value_terms)})
    df = df.withColumn("topical", F.when(contains_any(full, topic_terms[0]), 5).when(contains_any(full, topic_terms[1]), 3).otherwise(1))
    df = df.withColumn("quality", F.col("depth") + F.col("value"))
    high, mid = (F.col("quality") >= 4) & (F.col("topical") >= 4), (F.col("quality") >= 2) & (F.col("topical") >= 3)
    return df.withColumn("level", F.when(high, "high").when(mid, "mid").otherwise("low"))


def relevance_score(cols: list[Column], terms: list[str]) -> Column:
    """Number of topic terms in any of the columns; 1 if there are no terms. Repeated terms count again."""
    text = F.concat_ws("\n", *cols)
    return count_terms(F.lower(text), [t.lower() for t in terms]) if terms else F.lit(1)


def review_pack(cards: DataFrame, score: Column, paper: str, card: str, title: str, outline: int = 8) -> DataFrame:
    """Cards with a positive score by falling score, then paper and card; ``outline`` marks the first titles.

    The rank is that of a sorted result: rows are numbered by a range-partitioned sort of the few columns it needs.
    """
    df = cards.withColumn("score", score).filter("score > 0").select(paper, card, title, "score")
    top = df.orderBy(F.desc("score"), paper, card).limit(outline).select(card, F.lit(True).alias("in_outline"))
    return df.join(F.broadcast(top), card, "left").withColumn("in_outline", F.coalesce("in_outline", F.lit(False)))  # top has ``outline`` rows


def rank_rows(df: DataFrame, *order: Column, limit: int | None = None) -> DataFrame:
    """Rows in order; with a limit only the first ones, found without a global sort."""
    df = df.orderBy(*order)
    return df.limit(limit) if limit else df


def first_by(df: DataFrame, keys: list[str], order: list[str], to: str = "rn") -> DataFrame:
    """One row for each key: the first in order.

    As an aggregate with a partial step, so that a key with many rows isn't sorted in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return best.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest])


def union_sources(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def dedup_hits(hits: DataFrame, doi: str, title: str, source: str, position: str, priority: dict[str, int] | None = None) -> DataFrame:
    """One hit for each DOI (the first), and for those without by normalised title (highest source priority, then first).

    Rows with and without DOI aren't compared with each other; rows without any key are dropped.
    """
    d, t = norm_doi(F.coalesce(F.col(doi), F.lit(""))), norm_title(F.coalesce(F.col(title), F.lit("")))
    key = F.when(d != "", F.concat(F.lit("doi:"), d)).when(t != "", F.concat(F.lit("title:"), t))
    rank = F.lit(0)
    for name, p in (priority or {}).items():
        rank = F.when(F.col(source) == name, F.lit(-p)).otherwise(rank)
    keyed = hits.withColumns({"dedup_key": key, "__rank": F.when(d != "", F.lit(0)).otherwise(rank)}).filter("dedup_key IS NOT NULL")
    return first_by(keyed, ["dedup_key"], ["__rank", position]).drop("__rank")


def classify_theme_multi(full: Column, terms: list[tuple[str, str]], navigation: list[str], fallback: tuple[str, str] = ("B", "F")) -> Column:
    """Sorted themes of all terms in the text; without any, one of two fallbacks. A term listed twice has its last theme."""
    hits = F.array_compact(F.array(*[F.when(F.contains(full, F.lit(t)), F.lit(theme)) for t, theme in dict(terms).items()]))
    themes = F.array_sort(F.array_distinct(hits))
    return F.when(F.size(themes) > 0, themes).when(contains_any(full, navigation), F.array(F.lit(fallback[0]))).otherwise(F.array(F.lit(fallback[1])))


def classify_theme_priority(themes: Column, order: list[str], fallback: str) -> Column:
    """The first class of the order that one of the themes begins with, a letter."""
    out = F.lit(fallback)
    for name in reversed(order):
        has = F.array_contains(F.transform(themes, lambda t: F.substring(t, 1, 1)), name)
        out = F.when(has, F.lit(name)).otherwise(out)
    return out


def theme_stats(df: DataFrame, theme: str, level: str) -> DataFrame:
    count = lambda v: F.count_if(F.col(level) == v)
    return df.groupBy(theme).agg(F.count(F.lit(1)).alias("total"), count("high").alias("n_high"), count("mid").alias("n_mid"))


def theme_rollup(df: DataFrame, themes: str, mode: str = "rollup", classes: tuple[str, ...] = ("B", "C", "D", "E", "F")) -> DataFrame:
    """Rows per sub-theme and main class. ``exact`` counts a main class only where its bare letter is a theme."""
    each = df.select(F.explode(themes).alias("sub"))
    if mode == "rollup":
        both = each.withColumn("main", F.substring("sub", 1, 1)).rollup("main", "sub").agg(F.count(F.lit(1)).alias("n"))
        return both.filter("main IS NOT NULL").select("main", F.coalesce("sub", F.lit("*")).alias("sub"), "n")
    main = df.agg(*[F.count_if(F.array_contains(themes, c)).alias(c) for c in classes])
    wide = main.select(F.explode(F.array(*[F.struct(F.lit(c).alias("main"), F.lit("*").alias("sub"), F.col(c).alias("n")) for c in classes])).alias("r")).select("r.*")
    return wide.unionByName(each.groupBy(F.substring("sub", 1, 1).alias("main"), "sub").agg(F.count(F.lit(1)).alias("n")))


def topn_by(df: DataFrame, by: list[str], order: list[Column], n: int, salts: int = 16) -> DataFrame:
    """The first n rows of each group; found within salted parts first, so no task sorts a large group."""
    key = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    first = lambda d, *keys: d.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= n)
    few = first(df.withColumn("__salt", key), *by, "__salt").drop("rn", "__salt")
    return first(few, *by)


def render_rows(df: DataFrame, by: list[str], line: Column, order: list[str], to: str = "body") -> DataFrame:
    """One text per group: its lines in order."""
    item = F.struct(*order, line.alias("__line"))
    return df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["__line"]), "\n").alias(to))
