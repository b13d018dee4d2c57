"""The part of a bundled file that is the expected paper: segments by headings, scored against the expected title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.functions.numeric import parse_numbering
from litspark.functions.text import canonical_title, matcher_ratio, norm_ws, title_similarity_native
from litspark.operators.structure import ordered
from litspark.operators.trees import written

#: The least score of a title, its least lead over the second, the score that needs no review, and titles of
#: parts that tell a degree document.
LEAST, LEAD, CONFIDENT = 0.72, 0.15, 0.85
DEGREE_MARKS = ["学位论文", "dissertation", "degreeofmaster", "degreeofdoctor", "原创性声明"]


def ratio_bound(a: Column, b: Column) -> Column:
    """No less than the share of matching blocks: characters of one that the other has at all, twice the fewer of both."""
    shared = lambda x, y: F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))
    return 2 * F.least(shared(a, b), shared(b, a)) / (F.length(a) + F.length(b))


def title_scores(pairs: DataFrame, wanted: str, title: str) -> DataFrame:
    """pairs with ``score`` of two titles. Blocks are matched only where neither the native rules nor the bound decide."""
    df = pairs.withColumns({"__a": F.coalesce(canonical_title(F.col(wanted)), F.lit("")), "__b": F.coalesce(canonical_title(F.col(title)), F.lit(""))})
    df = df.withColumn("__s", title_similarity_native(F.col("__a"), F.col("__b")))
    unsure = (F.col("__s") == 0) & (F.col("__a") != "") & (F.col("__b") != "") & (ratio_bound(F.col("__a"), F.col("__b")) >= LEAST)
    df = df.withColumn("__unsure", F.coalesce(unsure, F.lit(False)))
    matched = df.filter("__unsure").withColumn("__r", matcher_ratio("__a", "__b")).withColumn("score", F.when(F.col("__r") >= LEAST, F.col("__r")).otherwise(0.0)).drop("__r")
    return matched.unionByName(df.filter("NOT __unsure").withColumn("score", F.coalesce("__s", F.lit(0.0)))).drop("__a", "__b", "__s", "__unsure")


def best_of(scored: DataFrame, by: str) -> DataFrame:
    """(by, best, n, accepted, shared): the first of the best scored headings of each paper as a struct, whether it is good
    enough and ahead, and whether it is good enough and shares its score with the same title only."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), "line"))
    top = scored.withColumn("__place", place)
    cols = ["line", "level", "title", "score", "end_line"]
    out = top.groupBy(by).agg(F.max(F.when(F.col("__place") == 1, F.struct(*cols))).alias("best"), F.max(F.when(F.col("__place") == 2, F.col("score"))).alias("second"), F.count(F.lit(1)).alias("n"))
    tied = scored.join(out.select(by, F.col("best.score").alias("__top")), by).filter(F.col("score") == F.col("__top")).groupBy(by).agg(F.countDistinct(canonical_title(F.col("title"))).alias("titles"), F.count(F.lit(1)).alias("ties"))
    ahead = F.col("best.score") - F.coalesce("second", F.lit(0.0)) >= LEAD
    good = F.col("best.score") >= LEAST
    return out.join(tied, by).select(by, "best", "n", (good & ahead).alias("accepted"), (good & (F.col("ties") > 1) & (F.col("titles") == 1)).alias("shared"))


def select_segments(lines: DataFrame, papers: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """(by, start_line, end_line, level, title, score, code): one row for each of papers (by, title).

    Files are split at headings of level 1. Of several the one that matches the title best is taken, if it leads; a single
    one in any case, as the whole file. Where level 1 fails, headings of all levels are tried, each up to the next of its
    level or above. A degree document, which has typical parts and numbered chapters, is taken whole, and its title may
    come twice.
    Codes: title_fuzzy, other_level, identity_mismatch, no_heading; scope_ambiguous and no_lines have no range.
    """
    w = ordered(by, order)
    mark = F.regexp_extract(F.col(text), r"^(#{1,6})\s+\S", 1)
    heads = lines.withColumn("level", F.length(mark)).filter("level > 0").select(by, F.col(order).alias("line"), "level", norm_ws(F.regexp_replace(F.col(text), r"^#+\s*", "")).alias("title"))
    heads = heads.withColumn("valid", F.length(canonical_title(F.col("title"))) >= 2)
    extent = lines.groupBy(by).agg(F.min(order).alias("doc_start"), F.max(order).alias("doc_end"))
    after = Window.partitionBy(by).orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    closes = {level: F.min(F.when((F.col("level") <= level) & (F.col("valid") | F.lit(level > 1)), F.col("line"))).over(after) for level in range(1, 7)}
    end = F.coalesce(*[F.when(F.col("level") == level, c) for level, c in closes.items()])
    heads = heads.join(extent, by).withColumn("end_line", F.coalesce(end - 1, F.col("doc_end")))
    heads = written(heads.drop("doc_start", "doc_end"), "headings")
    scored = written(title_scores(heads.filter("valid").join(papers.select(by, F.col("title").alias("wanted")), by), "wanted", "title"), "scores")
    top = best_of(scored.filter("level = 1"), by).select(by, F.col("best").alias("one"), F.col("n").alias("n_one"), "accepted", "shared")
    nested = best_of(scored, by).filter("accepted").select(by, F.col("best").alias("any"))

    ones = heads.filter("valid AND level = 1")
    numbered = F.coalesce(parse_numbering(F.col("title"))["depth"] == 1, F.lit(False))
    marks = F.exists(F.array(*[F.lit(m) for m in DEGREE_MARKS]), lambda m: F.contains(canonical_title(F.col("title")), m))
    parts = ones.groupBy(by).agg(F.bool_or(marks).alias("marked"), F.bool_or(numbered).alias("chapters"), F.max("line").alias("last_one"))
    later = heads.filter("level > 1").join(parts.select(by, "last_one"), by).filter(F.col("line") > F.col("last_one")).groupBy(by).agg(F.bool_or(numbered).alias("later"))
    degree = parts.join(later, by, "left").select(by, (F.col("marked") & (F.col("chapters") | F.coalesce("later", F.lit(False)))).alias("degree"))

    df = papers.select(by).join(extent, by, "left").join(top, by, "left").join(nested, by, "left").join(degree, by, "left")
    single, several = F.col("n_one") == 1, F.col("n_one") > 1
    good = (several & (F.col("accepted") | (F.col("shared") & F.coalesce("degree", F.lit(False))))) | (single & (F.col("one.score") >= LEAST))
    case = (
        F.when(F.col("doc_end").isNull(), "no_lines").when(good, "one").when(F.col("n_one").isNotNull() & (F.col("any.level") > 1), "other_level")
        .when(single, "identity_mismatch").when(several, "scope_ambiguous").otherwise("no_heading")
    )
    df = df.withColumn("case", case)
    whole = (F.col("case") == "no_heading") | (F.col("case") == "identity_mismatch") | ((F.col("case") == "one") & (single | F.coalesce("degree", F.lit(False))))
    none = F.col("case").isin("no_lines", "scope_ambiguous")
    chosen = F.when(F.col("case") == "other_level", F.col("any")).when(F.col("case").isin("one", "identity_mismatch"), F.col("one"))
    df = df.withColumn("chosen", chosen)
    fuzzy = F.col("chosen.score") < F.when(single, CONFIDENT).otherwise(1.0)
    code = F.when(F.col("case") == "one", F.when(fuzzy, "title_fuzzy")).otherwise(F.col("case"))
    return df.select(
        by,
        F.when(~none, F.when(whole, F.col("doc_start")).otherwise(F.col("chosen.line"))).alias("start_line"),
        F.when(~none, F.when(whole, F.col("doc_end")).otherwise(F.col("chosen.end_line"))).alias("end_line"),
        F.col("chosen.level").alias("level"),
        F.col("chosen.title").alias("title"),
        F.col("chosen.score").alias("score"),
        code.alias("code"),
    )
