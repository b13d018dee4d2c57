"""Lines, headings, regions, blocks and sections of documents.

Windows run within one document; its lines are short rows, so a long document stays a small partition of work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.functions.text import strip

#: Titles that mark parts of a document.
ABSTRACT_TITLES = ["摘要", "abstract"]
KEYWORD_TITLES = ["关键词", "关键字", "keywords"]
BACK_TITLES = ["参考文献", "references", "致谢", "附录", "acknowledgements"]
#: Sentence ends at which a long text is cut, and stronger and weaker breaks of quotations.
SENTENCE_ENDS = "。！？；.!?;\n"
STRONG, WEAK = "。！？；!?;.", "，、：,: "


def ordered(by: str, order: str) -> Window:
    return Window.partitionBy(by).orderBy(order)


def running(by: str, order: str) -> Window:
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)


def is_noise(line: Column) -> Column:
    """Page numbers, image and caption lines, and rules of signs."""
    x = strip(line)
    page = x.rlike(r"^[-‑—]{5,}\s*\d+\s*[-‑—]{5,}$") | (x.rlike(r"^\d+$") & (F.length(x) <= 6)) | x.rlike(r"^\[\d+\]$")
    media = x.rlike(r"^!\[.*\]\(.*\)$") | x.rlike(r"^(图|表|Figure|Table)\s*\d")
    return (x != "") & (page | media | x.rlike(r"^[_\-*=~]+$"))


def clean_lines(lines: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Lines without noise, and without short ones that repeat the line kept before. A run of equal lines keeps its first."""
    kept = lines.filter(~is_noise(F.col(text)))
    before = F.lag(text).over(ordered(by, order))
    x = strip(F.col(text))
    repeats = F.coalesce(F.col(text) == before, F.lit(False)) & (F.length(x) > 0) & (F.length(x) <= 80)
    return kept.withColumn("__r", repeats).filter("NOT __r").drop("__r")


def collapse_blanks(lines: DataFrame, by: str, order: str, text: str, most: int = 2) -> DataFrame:
    """At most two blank lines in a row."""
    solid = F.sum((F.trim(text) != "").cast("int")).over(running(by, order))
    df = lines.withColumns({"__run": solid, "__blank": F.trim(text) == ""})
    nth = F.sum(F.col("__blank").cast("int")).over(Window.partitionBy(by, "__run").orderBy(order))
    return df.withColumn("__n", nth).filter((~F.col("__blank")) | (F.col("__n") <= most)).drop("__run", "__blank", "__n")


def number_rows(df: DataFrame, by: str, order: list[str], to: str = "number") -> DataFrame:
    return df.withColumn(to, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def close_spans(df: DataFrame, by: str, start: str, doc_end: str) -> DataFrame:
    """df with end_line: one before the next start, or the end of the document."""
    return df.withColumn("end_line", F.coalesce(F.lead(start).over(ordered(by, start)) - 1, F.col(doc_end)))


def adjacent_groups(df: DataFrame, by: str, order: str, keys: list[str], to: str = "group") -> DataFrame:
    """df with the number of the run of neighbours that agree in all keys."""
    changed = F.lit(False)
    for k in keys:
        changed = changed | ~F.col(k).eqNullSafe(F.lag(k).over(ordered(by, order)))
    first = F.lag(F.lit(1)).over(ordered(by, order)).isNull()
    return df.withColumn("__new", (changed | first).cast("int")).withColumn(to, F.sum("__new").over(running(by, order))).drop("__new")


def paragraphs(lines: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """(by, start_line, end_line, n_lines) of each run of lines that aren't blank."""
    blanks = F.sum((F.trim(text) == "").cast("int")).over(running(by, order))
    df = lines.withColumn("__p", blanks).filter(F.trim(text) != "")
    return df.groupBy(by, "__p").agg(F.min(order).alias("start_line"), F.max(order).alias("end_line"), F.count(F.lit(1)).alias("n_lines")).drop("__p")


def suffix_ids(df: DataFrame, base: Column, by: list[str], order: str) -> DataFrame:
    """df with base:nn, nn the place among equal bases."""
    df = df.withColumn("__base", base)
    nth = F.row_number().over(Window.partitionBy(*by, "__base").orderBy(order))
    return df.withColumn("id", F.concat(F.col("__base"), F.lit(":"), F.lpad(nth.cast("string"), 2, "0"))).drop("__base")


def part_of_n(df: DataFrame, by: str, order: str) -> DataFrame:
    return df.withColumns({"i": F.row_number().over(ordered(by, order)), "n": F.count(F.lit(1)).over(Window.partitionBy(by))})


def not_increasing(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows whose value isn't greater than all before it."""
    before = F.max(value).over(ordered(by, order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("before", before).filter(F.col(value) <= F.col("before"))


def heading_paths(headings: DataFrame, by: str, order: str, depth: str, title: str) -> DataFrame:
    """headings with path, the titles of its ancestors and itself; a jump of over one level starts a new stack.

    The stack after a jump depends on all before it, so this is a small function over the headings of one document.
    """
    out = T.StructType([*headings.schema.fields, T.StructField("path", T.ArrayType(T.StringType()))])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        stack: list[str] = []
        paths = []
        group = group.sort_values(order)
        for d, name in zip(group[depth].clip(lower=1), group[title], strict=True):
            stack = [*([] if d > len(stack) + 1 else stack[: d - 1]), name]
            paths.append(list(stack))
        return group.assign(path=paths)

    return headings.groupBy(by).applyInPandas(run, out)


def levels_of(headings: DataFrame, level: str) -> list[int]:
    """The different levels of all headings, ascending; a few numbers."""
    return sorted(r[0] for r in headings.select(level).filter(F.col(level).isNotNull()).distinct().collect())


def flat_heading_paths(headings: DataFrame, by: str, order: str, depth: str, title: str) -> DataFrame:
    """The same with windows only, for documents in which no heading jumps by more than a level."""
    w, levels = running(by, order), levels_of(headings, depth)
    at = {d: F.last(F.when(F.col(depth) == d, F.col(order)), ignorenulls=True).over(w) for d in levels}
    named = {d: F.last(F.when(F.col(depth) == d, F.col(title)), ignorenulls=True).over(w) for d in levels}
    df = headings.withColumns({f"__a{d}": x for d, x in at.items()} | {f"__t{d}": x for d, x in named.items()})
    parts = [F.when((F.col(depth) >= d) & F.col(f"__a{d}").isNotNull(), F.col(f"__t{d}")) for d in levels]
    return df.withColumn("path", F.array_compact(F.array(*parts, F.lit(None).cast("string")))).drop(*[f"__{x}{d}" for x in "at" for d in levels])


def first_marker(df: DataFrame, by: str, order: str, mark: Column, to: str = "first") -> DataFrame:
    return df.groupBy(by).agg(F.min(F.when(mark, F.col(order))).alias(to))


def latest_by(df: DataFrame, by: str, ts: list[str]) -> DataFrame:
    """The last row of each key, as an aggregate."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(*ts)).alias("__last")).select(by, *[F.col(f"__last.{c}").alias(c) for c in rest])


def best_margin(df: DataFrame, by: str, score: str, item: str, least: float, margin: float, allow_ties: bool = False) -> DataFrame:
    """(by, best, best_score, accepted): accepted if the best is good enough and ahead of the second, or a tie where allowed."""
    top = df.groupBy(by).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(item)).alias("i"))).alias("t"), F.max_by(item, F.struct(F.col(score), -F.col(item))).alias("best"))
    rest = df.join(top, by).filter(F.col(item) != F.col("best")).groupBy(by).agg(F.max(score).alias("second"))
    out = top.join(rest, by, "left").select(by, "best", F.col("t.s").alias("best_score"), F.coalesce("second", F.lit(0.0)).alias("second"))
    ahead = F.col("best_score") - F.col("second") >= margin
    ok = (F.col("best_score") >= least) & (ahead | ((F.col("best_score") == F.col("second")) if allow_ties else F.lit(False)))
    return out.select(by, "best", "best_score", ok.alias("accepted"))


def fill_state(df: DataFrame, by: str, order: str, state: Column, locked: str | None = None, to: str = "area") -> DataFrame:
    """df with the last state set at or before each row; once ``locked`` was reached only tail states follow."""
    df = df.withColumn("__s", state)
    if locked:
        seen = F.max((F.col("__s") == locked).cast("int")).over(running(by, order).rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn("__s", F.when(F.coalesce(seen, F.lit(0)) == 1, F.when(F.col("__s").startswith("tail"), F.col("__s"))).otherwise(F.col("__s")))
    return df.withColumn(to, F.last("__s", ignorenulls=True).over(running(by, order))).drop("__s")


def table_runs(lines: DataFrame, by: str, order: str, opens: Column, closes: Column) -> DataFrame:
    """lines with ``inside``: whether a table is open at or before the line."""
    depth = F.sum(opens.cast("int") - F.coalesce(F.lag(closes.cast("int")).over(ordered(by, order)), F.lit(0))).over(running(by, order))
    return lines.withColumns({"__o": opens, "__c": closes}).withColumn("inside", depth > 0).drop("__o", "__c")


def extract_headings(lines: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Markdown headings with depth, and numbered lines between blank lines that have a neighbour in the sequence."""
    from litspark.functions.numeric import parse_numbering
    from litspark.operators.relations import supported_ordinals

    w = ordered(by, order)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    df = lines.withColumns({"__before": F.lag(text).over(w), "__after": F.lead(text).over(w)})
    mark = F.regexp_extract(text, r"^(#{1,6})\s+\S", 1)
    marked = df.filter(mark != "").select(by, order, F.length(mark).alias("depth"), F.trim(F.regexp_replace(text, r"^#+\s*", "")).alias("title"), F.lit("markdown").alias("origin"))
    number = parse_numbering(F.col(text))
    plain = df.filter((mark == "") & number.isNotNull() & blank(F.col("__before")) & blank(F.col("__after")) & (F.length(text) <= 60) & ~F.col(text).rlike("[。；;，,]$"))
    plain = plain.select(by, order, number["depth"].alias("depth"), F.trim(text).alias("title"), F.lit("numbered").alias("origin"), number["ordinal_path"][0].alias("__ordinal"))
    return marked.unionByName(supported_ordinals(plain, by, "__ordinal").drop("__ordinal"))


def label_regions(headings: DataFrame, title: Column) -> Column:
    """Role of the region below a heading by its title."""
    return F.when(title.isin(ABSTRACT_TITLES), "abstract").when(title.isin(KEYWORD_TITLES), "keywords").when(title.isin(BACK_TITLES), "back_matter").otherwise("body")


def build_regions(headings: DataFrame, by: str, role: str, ends: DataFrame) -> DataFrame:
    """Regions from each heading's line to before the next; everything from the first back matter on is back matter.

    headings: by, start_line, role; ends: by, doc_end. Lines before the first heading are front matter.
    """
    closed = close_spans(headings.join(ends, by), by, "start_line", "doc_end")
    back = F.min(F.when(F.col(role) == "back_matter", F.col("start_line"))).over(Window.partitionBy(by))
    closed = closed.withColumn("role", F.when(F.col("start_line") >= back, F.lit("back_matter")).otherwise(F.col(role)))
    front = closed.groupBy(by).agg(F.min("start_line").alias("__first")).filter("__first > 1").select(by, F.lit(1).alias("start_line"), (F.col("__first") - 1).alias("end_line"), F.lit("front_matter").alias("role"))
    return closed.select(by, "start_line", "end_line", "role").unionByName(front.withColumns({"start_line": F.col("start_line").cast("int"), "end_line": F.col("end_line").cast("int")}))


def split_text(value: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters that end after a sentence where one ends in the last two thirds."""
    out, start = [], 0
    while len(value) - start > most:
        low = start + most // 3
        cut = max(value.rfind(c, low, start + most) for c in SENTENCE_ENDS) + 1
        end = cut if cut > low else start + most
        out.append(value[start:end])
        start = end
    return [*out, value[start:]]


def split_long_texts(df: DataFrame, key: str, text: str, most: int = 1400) -> DataFrame:
    """(key, part, piece): long texts in pieces whose concatenation is the text."""
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pieces = pdf["__text"].map(lambda x: split_text(x, most))
            out = pd.DataFrame({key: pdf[key], "piece": pieces}).explode("piece")
            out["part"] = out.groupby(level=0).cumcount().astype("int32")
            yield out[[key, "part", "piece"]]

    return rows.mapInPandas(run, f"{key} {kind}, part int, piece string")


def choose_end(text: str, start: int, end: int, most: int) -> int:
    """End of a quotation: after a strong, else a weak break in its second half, never inside of a number."""
    if end - start <= most:
        return end
    for marks in (STRONG, WEAK):
        for i in range(start + most - 1, start + most // 2 - 1, -1):
            inside_number = text[i] in ".," and text[i - 1].isdigit() and i + 1 < end and text[i + 1].isdigit()
            if text[i] in marks and not inside_number:
                return i + 1
    return start + most


def split_quotes(cards: DataFrame, key: str, text: str, most: int = 240) -> DataFrame:
    """(key, quote_id, start_char, end_char, quote): spans of single lines that cover all that isn't white space."""
    from litspark.functions.text import stable_id

    rows = cards.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kind = rows.schema[key].dataType.simpleString()

    def spans(value: str) -> list[tuple[int, int, str]]:
        out, line_start = [], 0
        for line in value.split("\n"):
            at, end = line_start, line_start + len(line)
            while at < end:
                stop = choose_end(value, at, end, most)
                piece = value[at:stop]
                lead = len(piece) - len(piece.lstrip())
                if piece.strip():
                    out.append((at + lead, at + lead + len(piece.strip()), piece.strip()))
                at = stop
            line_start = end + 1
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *s) for k, value in zip(pdf[key], pdf["__text"], strict=True) for s in spans(value)]
            yield pd.DataFrame(rows, columns=[key, "start_char", "end_char", "quote"])

    found = rows.mapInPandas(run, f"{key} {kind}, start_char int, end_char int, quote string")
    return found.withColumn("quote_id", stable_id("quote_", F.col(key), F.col("start_char"), F.col("end_char"), F.col("quote")))


#: White space that needs no quote, as Python's strip() takes it.
BLANK = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def quote_violations(quotes: DataFrame, cards: DataFrame, key: str, text: str, most: int = 240, kind: Column | None = None) -> DataFrame:
    """(key, quote_id, code, at, n): what is wrong with quotes (key, quote_id, start_char, end_char, quote) of cards.

    A quote must be the exact slice of its card's text that its places say, of at most ``most`` characters on one line, and
    its id must be unique. Cards whose ``kind`` is image have no quotes. All others are swept by place: spans sorted by
    start, with the running maximum of the ends before, leave gaps, and each gap must be blank. A gap that isn't gives
    ``not_covered`` with the place of its first solid character and their number; overlaps cover nothing twice.
    """
    from litspark.operators.trees import written

    c = cards.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"), F.coalesce(F.lit(False) if kind is None else kind == "image", F.lit(False)).alias("__image"))
    own = quotes.select(F.col(key).alias("__key"), "quote_id", F.col("start_char").cast("long").alias("start"), F.col("end_char").cast("long").alias("end"), "quote")
    own = written(own, "quotes")  # read twice below, and dear where the quotes are cut in Python
    ends = c.select("__key", F.lit(None).cast(own.schema["quote_id"].dataType).alias("quote_id"), F.length("__text").cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("string").alias("quote"))
    spans = own.withColumn("last", F.lit(False)).unionByName(ends.withColumn("last", F.lit(True)))
    before = Window.partitionBy("__key").orderBy("start", "last", "end", "quote_id").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("covered", F.greatest(F.coalesce(F.max(F.when(F.col("start") >= 0, F.col("end"))).over(before), F.lit(0).cast("long")), F.lit(0).cast("long")))
    met = spans.join(c.withColumn("__length", F.length("__text")), "__key", "left")
    start, end, covered, quote = (F.col(x) for x in ("start", "end", "covered", "quote"))
    # one walk through the text for each span: from what is covered to its end, where both the gap and the quote lie
    met = met.withColumn("__low", F.greatest(F.least(covered, start), F.lit(0).cast("long")))
    part_of = lambda x, at, n: F.substring(x, (at + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int"))
    low, piece = F.col("__low"), F.col("__piece")
    met = met.withColumn("__piece", part_of(F.col("__text"), low, F.greatest(start, F.coalesce(end, start)) - low))
    slice_of = lambda a, z: part_of(piece, a - low, z - a)
    known = F.col("__text").isNotNull()
    exact = F.coalesce((start >= 0) & (start < end) & (end <= F.col("__length")) & (slice_of(start, end) == quote), F.lit(False))
    row = lambda bad, code: F.when(bad, F.struct(F.lit(code).alias("code"), start.alias("at"), F.lit(1).cast("long").alias("n")))
    of_quote = [row(~known, "unknown_card"), row(known & ~exact, "not_a_slice"), row(F.length(quote) > most, "too_long"), row(quote.rlike(r"[\r\n]"), "several_lines"), row(F.col("__image"), "quote_of_image"), row(F.coalesce(F.col("quote_id").cast("string"), F.lit("")) == "", "id_missing")]
    solid = F.when(known & ~F.col("__image") & (covered < start), F.regexp_replace(slice_of(covered, start), f"^[{BLANK}]+", ""))
    first = start - F.length(solid)
    gap = F.when(F.length(solid) > 0, F.struct(F.lit("not_covered").alias("code"), first.alias("at"), F.length(F.regexp_replace(solid, f"[{BLANK}]+", "")).cast("long").alias("n")))
    found = F.array_compact(F.concat(F.when(F.col("last"), F.array(F.lit(None).cast("struct<code:string,at:bigint,n:bigint>"))).otherwise(F.array(*of_quote)), F.array(gap)))
    out = met.select(F.col("__key").alias(key), F.col("quote_id").cast("string").alias("quote_id"), F.explode(found).alias("v"))
    # a gap belongs to the card, not to the quote after it
    out = out.select(key, F.when(F.col("v.code") != "not_covered", F.col("quote_id")).alias("quote_id"), "v.*")
    repeated = own.filter("quote_id IS NOT NULL").groupBy("quote_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("__key", "start")).alias("m")).filter("n > 1")
    return out.unionByName(repeated.select(F.col("m.__key").alias(key), F.col("quote_id").cast("string").alias("quote_id"), F.lit("id_repeated").alias("code"), F.col("m.start").alias("at"), "n"))


def resolve_hierarchy(headings: DataFrame, by: str, order: str, level: str) -> DataFrame:
    """headings with parent: the order of the nearest heading before of a lower level, of however many levels there are."""
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.lit(None).cast(headings.schema[order].dataType)
    for d in levels_of(headings, level):
        last = F.max(F.when(F.col(level) == d, F.col(order))).over(w)
        best = F.when(F.col(level) > d, F.greatest(best, last)).otherwise(best)
    return headings.withColumn("parent", best)


def detect_profile(headings: DataFrame, by: str, family: str) -> DataFrame:
    """Numbering profile of a document by the families of its headings."""
    n = lambda *f: F.count_if(F.col(family).isin(*f))
    df = headings.groupBy(by).agg(n("chapter_cn").alias("n_chapter"), n("decimal_path").alias("n_decimal"), n("arabic_main").alias("n_arabic"), n("cn_main", "cn_paren").alias("n_cn"), F.count(F.lit(1)).alias("n"))
    profile = F.when(F.col("n_chapter") >= 2, "chapter").when(F.col("n_decimal") >= 2, "decimal").when(F.col("n_cn") >= 2, "chinese").when(F.col("n_arabic") >= 2, "arabic").otherwise("mixed_unknown")
    return df.select(by, "n", profile.alias("profile"))


#: Families a heading may stand below, by profile ("" for all others); the share of numbered headings that
#: makes a profile; families that may stand at the top.
PARENTS = {
    "arabic_main": {"journal_mixed_cn": ["cn_main", "cn_paren"]},
    "decimal_path": {"chapter_decimal": ["chapter_cn", "arabic_main"], "journal_mixed_cn": ["cn_main", "cn_paren", "arabic_main"], "": ["arabic_main", "chapter_cn"]},
    "cn_paren": {"": ["cn_main", "chapter_cn", "decimal_path"]},
    "arabic_paren": {"": ["cn_main", "cn_paren", "arabic_main", "decimal_path"]},
    "circled": {"": ["arabic_paren", "cn_paren", "decimal_path"]},
}
ROOTS = ["chapter_cn", "cn_main", "arabic_main", "plain"]


def numbering_profile(headings: DataFrame, by: str, order: str, family: str, least: float, first: int = 5) -> DataFrame:
    """(by, profile) of each document by its first headings, or by all of them if the first ones tell nothing."""
    placed = headings.select(by, F.col(family).alias("f"), (F.row_number().over(ordered(by, order)) <= first).alias("early"))

    def profile(which: Column) -> Column:
        n = lambda *f: F.count_if(which & F.col("f").isin(*f))
        arabic, chinese = n("decimal_path", "arabic_main"), n("cn_main", "cn_paren")
        dense = arabic >= least * F.count_if(which)
        return F.when((n("chapter_cn") > 0) & (arabic > 0), "chapter_decimal").when((chinese > 0) & (arabic > 0), "journal_mixed_cn").when((arabic > 0) & dense, "decimal_only")

    return placed.groupBy(by).agg(F.coalesce(profile(F.col("early")), profile(F.lit(True)), F.lit("mixed_unknown")).alias("profile"))


def family_hierarchy(headings: DataFrame, profiles: DataFrame, by: str, order: str) -> DataFrame:
    """headings with parent (order of the heading it stands below, null at the top), level, and whether that is a fallback.

    headings: family, path (numbers of a decimal heading) and markdown level ``depth``. The parent is the nearest heading
    before of a family that fits by ``PARENTS``; a decimal of three parts or more needs the one with its path but the last
    part; a plain heading the nearest of a lower depth. Without a parent a heading stands at the top if it is the first or
    of ``ROOTS``, else below the nearest one at the top. Parents come from windows and one join by path; levels, which
    depend on all before, from a fold over one document's headings.
    """
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, -1)
    o, f = F.col(order), F.col("family")
    df = headings.join(profiles, by)
    nearest = F.lit(None).cast(headings.schema[order].dataType)
    for child, rules in PARENTS.items():
        for profile, parents in rules.items():
            fits = (f == child) & ((F.col("profile") == profile) if profile else ~F.col("profile").isin([p for p in rules if p] or [""]))
            fits = fits & ((F.size("path") <= 2) if child == "decimal_path" else F.lit(True))
            nearest = F.when(fits, F.max(F.when(f.isin(parents), o)).over(w)).otherwise(nearest)
    df = df.withColumn("__near", nearest)
    key = lambda path: F.array_join(path, ".")
    deep = (f == "decimal_path") & (F.size("path") > 2)
    below = df.filter(deep).select(by, order, key(F.slice("path", F.lit(1), F.size("path") - 1)).alias("__key"))
    above = df.filter(f == "decimal_path").select(F.col(by).alias("__by"), o.alias("__o"), key(F.col("path")).alias("__key2"))
    met = below.join(above, (F.col(by) == F.col("__by")) & (F.col("__key") == F.col("__key2")) & (F.col("__o") < o)).groupBy(by, order).agg(F.max("__o").alias("__exact"))
    plain = resolve_hierarchy(df, by, order, "depth").select(by, order, F.col("parent").alias("__plain"))
    df = df.join(met, [by, order], "left").join(plain, [by, order])
    found = F.when(deep, F.col("__exact")).when(f == "plain", F.col("__plain")).otherwise(F.col("__near"))
    top = found.isNull() & (f.isin(ROOTS) | (F.row_number().over(ordered(by, order)) == 1))
    df = df.withColumns({"__found": found, "__top": top})
    df = df.withColumn("parent", F.when(~F.col("__top"), F.coalesce("__found", F.max(F.when(F.col("__top"), o)).over(w))))
    df = df.withColumn("fallback", F.col("__found").isNull() & ~(F.col("__top") & f.isin(ROOTS)))
    df = df.select(*headings.columns, "profile", "parent", "fallback")
    out = T.StructType([*df.schema.fields, T.StructField("level", T.IntegerType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        levels: dict = {}
        for at, up in zip(group[order], group["parent"], strict=True):
            levels[at] = 1 if pd.isna(up) else levels[up] + 1
        return group.assign(level=[levels[at] for at in group[order]])

    return df.groupBy(by).applyInPandas(run, out)
