"""Blocks, cards and the audits of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.functions.text import fingerprint, strip
from litspark.operators.structure import ordered, paragraphs, running

TARGET, MOST, MIN_TAIL = 1100, 1400, 200


def build_blocks(lines: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Runs of lines that aren't blank as blocks; a block of pipe-separated lines only is a table."""
    spans = paragraphs(lines, by, order, text).withColumnRenamed(by, "__by")
    solid = lines.filter(F.trim(text) != "")
    met = solid.join(spans, (F.col(by) == F.col("__by")) & F.col(order).between(F.col("start_line"), F.col("end_line")))
    item = F.struct(order, F.col(text).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n")  # lines of one block
    kind = F.when(F.bool_and(F.contains(text, F.lit("|"))), "table").otherwise("paragraph")
    return met.groupBy(by, "start_line", "end_line").agg(kind.alias("content_kind"), joined.alias("text"))


def pack_cards(blocks: DataFrame, by: str, order: str, text: str, target: int = TARGET, most: int = MOST, min_tail: int = MIN_TAIL) -> DataFrame:
    """Cards of neighbouring blocks: a card is closed when the next block would make it longer than ``target``.

    A last card of under ``min_tail`` characters joins the one before if both fit in ``most``, else it is flagged. Blocks
    count two characters for the blank line between them. The blocks of a group meet in one row, as numbers only; their
    texts are joined again by number.
    """
    sizes = blocks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.length(text).alias("n")))).alias("b"))
    start = F.struct(F.array().cast("array<struct<card:int,o:int>>").alias("out"), F.lit(0).alias("card"), F.lit(-2).cast("int").alias("size"))

    def step(acc: Column, x: Column) -> Column:
        grown = acc["size"] + 2 + x["n"]
        new = (acc["size"] >= 0) & (grown > target)
        card = acc["card"] + new.cast("int")
        size = F.when(new, x["n"]).otherwise(grown).cast("int")
        item = F.struct(card.cast("int").alias("card"), x["o"].cast("int").alias("o"))
        return F.struct(F.concat(acc["out"], F.array(item)).alias("out"), card.cast("int").alias("card"), size.alias("size"))

    placed = sizes.select(by, F.explode(F.aggregate("b", start, step)["out"]).alias("p")).select(by, "p.card", F.col("p.o").alias(order))
    met = blocks.join(placed, [by, order])
    item = F.struct(F.col(order).alias("o"), F.col(text).alias("t"))
    packed = met.groupBy(by, "card").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n_blocks"), F.array_sort(F.collect_list(item)).alias("items"))
    packed = packed.withColumn("extract", F.array_join(F.transform("items", lambda x: x["t"]), "\n\n")).drop("items")
    w = Window.partitionBy(by)
    tail = (F.col("card") == F.max("card").over(w)) & (F.col("card") > 0) & (F.length("extract") < min_tail)
    flagged = packed.withColumn("__tail", tail).withColumn("__fits", F.length("extract") + 2 + F.lag(F.length("extract")).over(ordered(by, "card")) <= most)
    flagged = flagged.withColumn("card", F.when(F.col("__tail") & F.col("__fits"), F.col("card") - 1).otherwise(F.col("card")))
    whole = flagged.groupBy(by, "card").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sum("n_blocks").alias("n_blocks"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "extract"))), lambda x: x["extract"]), "\n\n").alias("extract"),
        F.bool_or(F.col("__tail") & ~F.col("__fits")).alias("short_tail"),
    )
    return whole


def card_rows(df: DataFrame, paper: str, order: str, kind: str, text: str) -> DataFrame:
    """df with id, title with its place among the paper's cards, and fingerprint."""
    nth = F.row_number().over(Window.partitionBy(paper, kind).orderBy(order))
    base = F.concat_ws(":", F.col(paper).cast("string"), F.col(kind))
    i, n = F.row_number().over(ordered(paper, order)), F.count(F.lit(1)).over(Window.partitionBy(paper))
    title = F.concat(F.col(kind), F.lit("（"), i.cast("string"), F.lit("/"), n.cast("string"), F.lit("）"))
    return df.withColumns({"id": F.concat(base, F.lit(":"), F.lpad(nth.cast("string"), 2, "0")), "title": title, "fingerprint": fingerprint(F.col(text))})


def rule_violations(df: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(key, code) of each rule that doesn't hold."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules]))
    return df.select(key, F.explode(broken).alias("code"))


def audit_cards(df: DataFrame, key: str, summary: str, extract: str) -> DataFrame:
    """(key, code) of the rules on summaries and extracts that a card breaks."""
    s, x = F.coalesce(F.col(summary), F.lit("")), F.coalesce(F.col(extract), F.lit(""))
    rules = [
        ("summary.empty", strip(s) != ""),
        ("summary.too_long", F.length(s) <= 500),
        ("summary.possibly_truncated", (F.length(s) < 300) | s.rlike(r"[.!?。！？]\z")),
        ("chunk.too_short", F.length(x) >= 80),
        ("chunk.too_long", F.length(x) <= 1600),
        ("summary.contains_markup", ~s.rlike("</?[a-z]+[^>]*>")),
    ]
    return rule_violations(df, key, rules)


def resolve_refs(refs: DataFrame, lines: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Text of a range of lines of each document, with a status: ok, clamped, out_of_range, missing."""
    r = refs.withColumnRenamed(by, "__by")
    met = lines.join(r, (F.col(by) == F.col("__by")) & F.col(order).between(F.col("start_line"), F.col("end_line")))
    item = F.struct(order, F.col(text).alias("t"))
    texts = met.groupBy(by, "start_line", "end_line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n").alias("text"))
    last = lines.groupBy(by).agg(F.max(order).alias("__last"))
    out = refs.join(last, by, "left").join(texts, [by, "start_line", "end_line"], "left")
    status = F.when(F.col("__last").isNull(), "missing").when(F.col("start_line") > F.col("__last"), "out_of_range").when(F.col("end_line") > F.col("__last"), "clamped").otherwise("ok")
    return out.withColumn("status", status).drop("__last")


def section_texts(sections: DataFrame, lines: DataFrame, by: str, section: str, order: str, text: str) -> DataFrame:
    s = sections.select(F.col(by).alias("__by"), section, "start_line", "end_line")
    met = lines.join(s, (F.col(by) == F.col("__by")) & F.col(order).between(F.col("start_line"), F.col("end_line")))
    item = F.struct(order, F.col(text).alias("t"))
    return met.groupBy(by, section).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n").alias("text"))


def coverage(ledger: DataFrame, by: str) -> DataFrame:
    """Per document lines, those in exactly one region, in several, the share, and whether it may be published."""
    df = ledger.groupBy(by).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("assignment_count") == 1).alias("covered"), F.count_if(F.col("assignment_count") > 1).alias("multiple"))
    return df.withColumns({"ratio": F.coalesce(F.try_divide("covered", "n_lines"), F.lit(0.0)), "publishable": F.col("covered") == F.col("n_lines")})


def duplicate_content(cards: DataFrame, paper: str, text: str) -> DataFrame:
    """Fingerprints found in two papers or more."""
    each = cards.groupBy(fingerprint(F.col(text)).alias("fingerprint"), paper).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_papers"), F.sum("n").alias("n_members")).filter("n_papers > 1")


def duplicate_source(docs: DataFrame, text: str) -> DataFrame:
    """Documents whose fingerprint occurs twice or more."""
    marked = docs.withColumn("fingerprint", fingerprint(F.col(text)))
    twice = marked.groupBy("fingerprint").count().filter("count > 1").select("fingerprint")
    return marked.join(twice, "fingerprint", "left_semi")


def quality_label(papers: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """red with an error, silver with any other issue, else gold."""
    worst = issues.groupBy(key).agg(F.max(F.col("severity") == "error").alias("__error"))
    label = F.when(F.col("__error"), "red").when(F.col("__error").isNotNull(), "silver").otherwise("gold")
    return papers.join(worst, key, "left").select(key, label.alias("label"))


def adjacent_spans(spans: DataFrame, by: str, order: str) -> DataFrame:
    """spans with whether the next one begins where each ends."""
    return spans.withColumn("adjacent", F.coalesce(F.lead("start_char").over(ordered(by, order)) == F.col("end_char"), F.lit(False)))


def dedup_chapters(nodes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of chapters with one title the last one."""
    rest = [c for c in nodes.columns if c not in keys]
    return nodes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__n")).select(*keys, *[F.col(f"__n.{c}").alias(c) for c in rest])


def section_map(headings: DataFrame, by: str, order: str, depth: str) -> DataFrame:
    """headings with chapter (the order of the last one of depth 1) and section, its number."""
    chapter = F.last(F.when(F.col(depth) == 1, F.col(order)), ignorenulls=True).over(running(by, order))
    df = headings.withColumn("chapter", chapter)
    return df.withColumn("section", F.concat(F.lit("c"), F.dense_rank().over(Window.partitionBy(by).orderBy("chapter")).cast("string")))


def tree_diff(a: DataFrame, b: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, status): same, moved, added or removed."""
    x, y = a.select(node, F.col(parent).alias("__a"), F.lit(1).alias("__x")), b.select(node, F.col(parent).alias("__b"), F.lit(1).alias("__y"))
    status = F.when(F.col("__y").isNull(), "removed").when(F.col("__x").isNull(), "added").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("moved")
    return x.join(y, node, "full_outer").select(node, status.alias("status"))


def project_cards(df: DataFrame, keys: list[str], first: dict[str, list[str]], union: dict[str, list[str]], trimmed: dict[str, str]) -> DataFrame:
    """A narrow card: keys, first values that aren't empty, arrays of different flags, and trimmed texts."""
    solid = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    out = [F.coalesce(*[solid(c) for c in cs]).alias(name) for name, cs in first.items()]
    out += [F.array_distinct(F.array_compact(F.array(*[solid(c) for c in cs]))).alias(name) for name, cs in union.items()]
    return df.select(*keys, *out, *[F.trim(c).alias(name) for name, c in trimmed.items()])
