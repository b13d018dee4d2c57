"""Text functions: Column in, Column out."""

from __future__ import annotations

import difflib
import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The tags that are removed from text, and the characters unsafe in file names.
KNOWN_TAGS = "html body head title meta link style script table thead tbody tfoot tr td th caption colgroup col sub sup div span p br img figure figcaption a em strong b i u ol ul li h1 h2 h3 h4 h5 h6".split()
UNSAFE_NAME = r'[<>:"/\\|?*]'
#: Words that limit a claim and must not get lost from a quotation.
QUALIFIERS = ["尚不能", "不超过", "不低于", "尚未", "未能", "约为", "大约", "预计", "可能", "或许", "有望", "考虑", "至少", "至多", "计划", "建议", "仅", "约"]
COMMON_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
SENTENCE_END = r"(?<=[.!?。！？；;])\s*"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside of a lambda, which would compute it for each item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    """Without white space at both ends, the ideographic space included."""
    return F.regexp_replace(col, r"^[\s　]+|[\s　]+$", "")


def norm_ws(col: Column) -> Column:
    """Runs of white space as one space."""
    return F.trim(F.regexp_replace(col, r"[\s　]+", " "))


def canonical_title(col: Column) -> Column:
    """Letters, digits and CJK ideographs only, in lower case, tags removed."""
    return F.lower(F.regexp_replace(strip_markup(col), r"[^0-9A-Za-z一-鿿]+", ""))


def norm_title(col: Column) -> Column:
    """Lower case without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def norm_doi(col: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(col), r"(?i)^(https?://doi\.org/|doi:)\s*", "")))


def strip_markup(col: Column) -> Column:
    """Known tags removed; other angle brackets stay."""
    return F.regexp_replace(col, r"(?i)</?(?:" + "|".join(KNOWN_TAGS) + r")\b[^>]*>", "")


def unescape_common(col: Column) -> Column:
    """The frequent character references, ampersand last."""
    for name, value in COMMON_ENTITIES:
        col = F.replace(col, F.lit(name), F.lit(value))
    return col


@F.pandas_udf(T.StringType())
def unescape_html(col: pd.Series) -> pd.Series:
    """All character references."""
    return col.map(html.unescape, na_action="ignore")


def clean_visible(col: Column) -> Column:
    """Struct of visible text and whether markup had to be removed."""
    bare = norm_ws(unescape_common(strip_markup(col)))
    return F.struct(bare.alias("text"), (strip_markup(col) != col).alias("had_markup"))


def fingerprint(col: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(norm_ws(col), 256))


def stable_id(prefix: str, *cols: Column, length: int = 24) -> Column:
    """Prefix and the first characters of a hash of the values, which are told apart by a separator."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *[c.cast("string") for c in cols]), 256), 1, length))


def slugify(col: Column, fallback: str = "item-") -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(norm_ws(col)), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    return F.when(slug == "", stable_id(fallback, col, length=12)).otherwise(slug)


def safe_filename(col: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(col, UNSAFE_NAME, "_"), 1, most)


def lead_excerpt(col: Column, most: int = 280) -> Column:
    """The first two sentences as far as they fit, else the beginning."""
    parts = F.slice(F.filter(F.transform(F.split(col, SENTENCE_END), strip), lambda s: s != ""), 1, 2)
    first, both = F.get(parts, F.lit(0)), F.array_join(parts, " ")
    return F.when((F.size(parts) > 0) & (F.length(both) <= most), both).when(F.length(first) <= most, first).otherwise(strip(F.substring(col, 1, most)))


def preview(col: Column, n: int) -> Column:
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def contains_any(col: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | col.contains(t)
    return out


def count_terms(col: Column, terms: list[str]) -> Column:
    """How many of the terms the text contains; a term that is listed twice counts twice."""
    out = F.lit(0)
    for t in terms:
        out = out + col.contains(t).cast("int")
    return out


def compact_nfkc_text(x: str) -> str:
    return "".join(unicodedata.normalize("NFKC", x).split())


@F.pandas_udf(T.StringType())
def compact_nfkc(col: pd.Series) -> pd.Series:
    """Compatibility form without white space."""
    return col.map(compact_nfkc_text, na_action="ignore")


def title_similarity_native(a: Column, b: Column) -> Column:
    """1 for equal canonical titles, 0.85 if one of 6 characters or more is in the other, else 0; null arms aside."""
    x, y = canonical_title(a), canonical_title(b)
    inside = (F.least(F.length(x), F.length(y)) >= 6) & (F.contains(x, y) | F.contains(y, x))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(inside, 0.85).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def title_similarity(a: Column, b: Column, least: float = 0.72) -> Column:
    exact = title_similarity_native(a, b)
    ratio = matcher_ratio(canonical_title(a), canonical_title(b))
    return F.when((exact > 0) | (canonical_title(a) == "") | (canonical_title(b) == ""), exact).when(ratio >= least, ratio).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def char_overlap(source: pd.Series, other: pd.Series) -> pd.Series:
    """Share of the source's characters that matching blocks keep."""

    def one(x: str, y: str) -> float:
        kept = sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        return kept / len(x) if x else 0.0

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(source, other, strict=True)])


def bigrams(col: Column) -> Column:
    pairs = lambda x: F.when(F.length(x) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substr(x, i, F.lit(2)))))
    return let(F.regexp_replace(F.lower(col), r"\s+", ""), pairs)


def bigram_jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(F.array_union(a, b))), F.lit(0.0))


def extractive_summary(col: Column, n: int) -> Column:
    """Sentences until they hold n characters or more."""
    parts = F.filter(F.transform(F.split(col, SENTENCE_END), strip), lambda s: s != "")
    return F.aggregate(parts, F.lit(""), lambda acc, s: F.when(F.length(acc) >= n, acc).when(acc == "", s).otherwise(F.concat(acc, F.lit(" "), s)))


def clauses(col: Column) -> Column:
    return F.filter(F.transform(F.split(col, r"[，,；;。！？!?]+"), lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: x != "")


def ordered_clause_support(claim: Column, quote: Column) -> Column:
    """Whether all clauses of the claim are in the quotation one after another."""
    parts = clauses(claim)

    def held(text: Column) -> Column:
        def step(at: Column, clause: Column) -> Column:
            found = F.call_function("locate", clause, text, at)
            return F.when((at == 0) | (found == 0), F.lit(0)).otherwise(found + F.length(clause))

        return F.aggregate(parts, F.lit(1), step) > 0

    return (F.size(parts) > 0) & let(F.regexp_replace(quote, r"\s+", ""), held)


def qualifiers_dropped(claim: Column, quotes: Column, qualifiers: list[str] | None = None) -> Column:
    """The first qualifier of any quote without which a clause of the claim would be verbatim, if no quote has the clause; null if none."""
    words = F.array(*[F.lit(q) for q in qualifiers or QUALIFIERS])
    bare = F.transform(quotes, lambda q: F.regexp_replace(q, r"\s+", ""))

    def first(texts: Column, parts: Column) -> Column:
        lost = F.filter(parts, lambda c: ~F.exists(texts, lambda x: F.contains(x, c)))
        hit = lambda w: F.exists(texts, lambda x: F.contains(x, w) & F.exists(lost, lambda c: ~F.contains(c, w) & F.contains(F.replace(x, w, F.lit("")), c)))
        return F.get(F.filter(words, hit), F.lit(0))

    return let(bare, lambda texts: let(clauses(claim), lambda parts: first(texts, parts)))


def qualifier_dropped(claim: Column, quote: Column, qualifiers: list[str] | None = None) -> Column:
    """The first qualifier without which a clause of the claim would be verbatim, null if none."""
    words = F.array(*[F.lit(q) for q in qualifiers or QUALIFIERS])

    def lost(text: Column, parts: Column, q: Column) -> Column:
        bare = F.replace(text, q, F.lit(""))
        return F.contains(text, q) & F.exists(parts, lambda c: ~F.contains(text, c) & ~F.contains(c, q) & F.contains(bare, c))

    first = lambda text: let(clauses(claim), lambda parts: F.get(F.filter(words, lambda q: lost(text, parts, q)), F.lit(0)))
    return let(F.regexp_replace(quote, r"\s+", ""), first)
