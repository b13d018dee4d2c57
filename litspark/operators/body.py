"""Where the body of a document begins, from its headings: areas of front matter, contents, look-ahead, and what comes after.

All of it are windows over the headings of one document: which headings are entries of a table of contents depends on
the last heading before that opened or left the contents; the body is locked by the first heading that a look-ahead of
two confirms; and of the numbered headings that wait just before it, the last three are taken along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.functions.numeric import family_of, leading_ordinal, normalize_heading

#: Titles in lower case, and what titles contain or start with, by the part of a document that they open.
CONTENTS = ["目录", "目次", "contents", "table of contents"]
REFERENCES = ["参考文献", "reference", "references"]
ACKNOWLEDGEMENTS = ["致谢"]
AUTHOR = ["作者简介", "author biography"]
BEFORE_BODY = ["图目录", "表目录", "插图目录", "符号说明", "主要符号说明", "缩略语", "缩略语表", "缩略语说明"]
TITLE_PAGE = ["硕士学位论文", "博士学位论文", "dissertation", "thesis", "大学", "学院", "研究所", "school", "university", "institute"]
DECLARATION = ["独创性声明", "原创性声明"]
AUTHORIZATION = ["授权书", "authorization"]
BODY_STARTS = ["绪论", "引言", "前言", "研究背景", "文献综述", "研究设计", "研究方法", "方法", "实验", "结果", "讨论", "结论", "概述"]
NUMBERED = ["chapter_cn", "arabic_main", "decimal_path", "cn_main"]
PENDING = 3


def contains_any_of(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def tail_area(title: Column) -> Column:
    """references, appendix or acknowledgements by a title in lower case; null for all others."""
    return F.when(title.isin(REFERENCES + AUTHOR), "references").when(title.rlike("^附录[a-z]?$") | title.startswith("appendix"), "appendix").when(title.isin(ACKNOWLEDGEMENTS) | title.startswith("acknowledg"), "acknowledgements")


def front_area(title: Column) -> Column:
    """The part before the body that a title in lower case opens; null for all others."""
    return (
        F.when(tail_area(title).isNotNull() & ~title.isin(AUTHOR), tail_area(title))
        .when(title.isin(CONTENTS), "contents")
        .when(contains_any_of(title, TITLE_PAGE), "title_block")
        .when(contains_any_of(title, DECLARATION), "declaration")
        .when(contains_any_of(title, AUTHORIZATION), "authorization")
        .when(F.contains(title, F.lit("摘要")), "abstract_cn")
        .when(title == "abstract", "abstract_en")
        .when(title.isin(BEFORE_BODY), "before_body")
    )


def is_front_title(title: Column) -> Column:
    return F.coalesce(front_area(title).isin("declaration", "authorization", "abstract_cn", "abstract_en"), F.lit(False)) | title.rlike("(硕士|博士).*学位.*论文") | title.startswith("research on") | title.startswith("a dissertation")


def is_contents_entry(raw: Column, title: Column, family: Column, content: Column) -> Column:
    """A line of a table of contents: dots or a page number at its end, or a content that is mostly numbers."""
    compact = F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", "")
    figures = F.length(compact) - F.length(F.regexp_replace(compact, r"[0-9.\-]", ""))
    index = (F.length(compact) > 0) & (F.length(compact) < 240) & (figures >= 0.18 * F.length(compact))
    numbered = family.isin(NUMBERED)
    return title.isin(CONTENTS) | raw.rlike(r"[.\-·•…]{2,}\s*[0-9]+\s*$") | (F.trim(raw).rlike(r"\s[0-9]+\s*-?$") & (numbered | (family == "plain"))) | index | (numbered & raw.rlike(r"[0-9]+\s*$"))


def heading_features(headings: DataFrame, title: str, content: str | None) -> DataFrame:
    """headings with __title, __family, __path, __words (title without number), and what it opens before or after the body."""
    text = F.lower(normalize_heading(F.col(title)))
    df = headings.withColumns({"__title": text, "__ordinal": leading_ordinal(text)})
    df = df.withColumns({"__family": family_of(F.col("__ordinal"))["family"], "__number": F.col("__ordinal.number")})
    path = F.when(F.col("__family").isin("arabic_main", "decimal_path"), F.transform(F.split("__number", r"\."), lambda x: x.cast("long")))
    words = F.regexp_replace(F.col("__title"), r"^第?\s*[0-9一二两三四五六七八九十百零]+(\.[0-9]+)*\s*章?\s*[.、):：\-]?\s*", "")
    df = df.withColumns({"__path": path, "__words": F.when(F.col("__family") == "plain", F.col("__title")).otherwise(words), "__front": front_area(F.col("__title")), "__tail": tail_area(F.col("__title"))})
    body = F.lit("") if content is None else F.col(content)
    return df.withColumn("__entry", is_contents_entry(F.col(title), F.col("__title"), F.col("__family"), body))


def follows(path: Column, family: Column, next_path: Column, next_family: Column) -> Column:
    """Whether a heading confirms the numbered one before it: a part of it, or one in parentheses."""
    part = (next_family == "decimal_path") & (F.size(next_path) > F.size(path)) & (F.slice(next_path, 1, F.size(next_path) - 1) == path)
    return ((family == "arabic_main") & next_family.isin("arabic_paren", "decimal_path")) | ((family == "decimal_path") & (part | next_family.isin("arabic_paren", "cn_paren")))


def lock_body(headings: DataFrame, by: str, order: str, title: str, content: str | None = None, journal: Column | None = None) -> DataFrame:
    """headings with area, role and reason.

    Before the body is locked: a title of contents opens them, and entries that follow are consumed; titles of other
    parts are front matter. The body is locked by a chapter; by a Chinese number if one of the next two headings is
    below it; by a number that one of the next two follows; by a number or a plain title with a word that starts bodies;
    in journals by any main number. Numbered headings that wait without a boundary between are taken along, the last
    three at most. After the lock all headings are body but those of references, appendix and acknowledgements, and
    titles of front matter, which stay apart.
    """
    w = Window.partitionBy(by).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = heading_features(headings, title, content)
    opens = F.col("__title").isin(CONTENTS)
    # entries neither open nor leave the contents
    toc_event = F.when(opens, F.lit(True)).when(~F.col("__entry") & F.col("__front").isNotNull(), F.lit(False))
    df = df.withColumns({"__event": toc_event, "__opens": opens})
    df = df.withColumn("__in_toc", F.coalesce(F.last("__event", ignorenulls=True).over(before), F.lit(False)))
    df = df.withColumn("__consumed", F.col("__in_toc") & F.col("__entry") & ~F.col("__opens"))
    df = df.withColumn("__sets", F.when(~F.col("__consumed"), F.col("__front")))
    df = df.withColumn("__was", F.coalesce(F.last("__sets", ignorenulls=True).over(before), F.lit("start")))
    df = df.withColumn("__special", F.col("__opens") | F.coalesce(F.col("__sets") != F.col("__was"), F.lit(False)))

    family, path, words = F.col("__family"), F.col("__path"), F.col("__words")
    ahead = [(F.lead("__path", k).over(w), F.lead("__family", k).over(w)) for k in (1, 2)]
    any_ahead = lambda test: F.coalesce(test(*ahead[0]), F.lit(False)) | F.coalesce(test(*ahead[1]), F.lit(False))
    starts = words.isin(BODY_STARTS)
    before_tail = ~F.coalesce(F.coalesce(F.col("__sets"), F.col("__was")).isin("references", "appendix", "acknowledgements"), F.lit(False))
    locks = (
        (family == "chapter_cn")
        | ((family == "arabic_main") & starts)
        | ((family == "cn_main") & any_ahead(lambda p, f: f.isin("cn_paren", "arabic_main", "decimal_path")))
        | any_ahead(lambda p, f: follows(path, family, p, f))
        | ((family == "plain") & starts & (before_tail | any_ahead(lambda p, f: f.isin("plain", *NUMBERED))))
    )
    if journal is not None:
        locks = locks | (journal & (family == "arabic_main"))
    free = ~F.col("__special") & ~F.col("__consumed")
    df = df.withColumns({"__locks": free & F.coalesce(locks, F.lit(False)), "__candidate": free & F.when(family == "plain", starts).otherwise(family.isin(NUMBERED))})
    df = df.withColumn("__start", F.min(F.when(F.col("__locks"), F.col(order))).over(Window.partitionBy(by)))
    # runs of waiting headings end at boundaries; consumed entries don't end them
    boundary = F.col("__special") | (free & ~F.col("__candidate"))
    df = df.withColumn("__run", F.sum(boundary.cast("int")).over(upto))
    df = df.withColumn("__last_run", F.max(F.when(F.col(order) < F.col("__start"), F.col("__run"))).over(Window.partitionBy(by)))
    early = F.col(order) < F.col("__start")
    waiting = early & F.col("__candidate") & (F.col("__run") == F.col("__last_run"))
    df = df.withColumn("__waits", F.coalesce(waiting, F.lit(False)))
    df = df.withColumn("__from_end", F.sum(F.col("__waits").cast("int")).over(w.rowsBetween(0, Window.unboundedFollowing)))
    taken = F.col("__waits") & (F.col("__from_end") <= PENDING)
    after = F.col(order) > F.col("__start")
    misplaced = is_front_title(F.col("__title")) | F.col("__title").isin(BEFORE_BODY)
    area_before = F.coalesce("__sets", "__was")
    role = (
        F.when(F.col(order) == F.col("__start"), "body").when(after & F.col("__tail").isNotNull(), F.col("__tail")).when(after & misplaced, "front_matter").when(after | taken, "body")
        .when(F.col("__opens"), "contents").otherwise("front_matter")
    )
    reason = (
        F.when(F.col(order) == F.col("__start"), "locks_body").when(after & F.col("__tail").isNotNull(), "tail_after_body").when(after & misplaced, "front_matter_after_body").when(after, "in_body").when(taken, "waited_for_body")
        .when(F.col("__opens"), "contents").when(F.col("__consumed"), "contents_entry").when(F.col("__special"), "opens_part").when(F.col("__candidate"), "body_not_confirmed").otherwise("before_body")
    )
    area = F.when(after & F.col("__tail").isNotNull(), F.col("__tail")).when(after | taken | (F.col(order) == F.col("__start")), "body").otherwise(area_before)
    return df.select(*headings.columns, area.alias("area"), role.alias("role"), reason.alias("reason"))
