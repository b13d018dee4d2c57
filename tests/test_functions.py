"""Scalar functions against plain Python, and the iterative ones by their invariants."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litspark.functions import arrays, numeric, text
from litspark.operators import structure


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_white_space_and_titles(spark):
    assert one(spark, text.norm_ws(F.lit(" a　 b\n\tc "))) == "a b c"
    assert one(spark, text.canonical_title(F.lit("<b>A-b</b> 中文!"))) == "ab中文"
    assert one(spark, text.norm_doi(F.lit(" https://DOI.org/10.1/AbC "))) == "10.1/abc"
    assert one(spark, text.safe_filename(F.lit('a<b>:"/\\|?*c'))) == "a_b________c"


def test_markup_and_entities(spark):
    assert one(spark, text.strip_markup(F.lit("<p>x</p> <y> 1 < 2"))) == "x <y> 1 < 2"
    assert one(spark, text.unescape_common(F.lit("&amp;lt; &lt;"))) == "&lt; <"
    assert one(spark, text.unescape_html(F.lit("&eacute;&#x41;"))) == "éA"
    assert one(spark, text.compact_nfkc(F.lit("Ａ 1　②"))) == unicodedata.normalize("NFKC", "Ａ1②")


def test_similarity(spark):
    s = lambda a, b: one(spark, text.title_similarity(F.lit(a), F.lit(b)))
    assert s("Deep Rivers", "deep rivers!") == 1.0
    assert s("Deep Rivers", "Deep Rivers of the North") == 0.85
    assert s("Deep Rivers", "unrelated") == 0.0
    assert one(spark, text.bigram_jaccard(text.bigrams(F.lit("abcd")), text.bigrams(F.lit("bcde")))) == 0.5


def test_claims(spark):
    held = lambda c, q: one(spark, text.ordered_clause_support(F.lit(c), F.lit(q)))
    assert held("a b，c", "x ab, then c") and not held("c，a", "a then c") and not held("", "a")
    assert one(spark, text.qualifier_dropped(F.lit("增长5%"), F.lit("预计增长5%"))) is None  # verbatim without the word already
    assert one(spark, text.qualifier_dropped(F.lit("成本可降低"), F.lit("成本可能降低".replace("可能", "可预计")))) == "预计"


def test_numbers(spark):
    facts = one(spark, numeric.numeric_facts(F.lit("1,234.5 and 12 % of a1 $1 2 3$")))
    assert set(facts) == {"1234.5", "12%", "1", "2", "3", "123"}
    formula = one(spark, numeric.numeric_facts(F.lit("$0 . 1 2$ and 5\n\\frac 3 ~ 4 and 1 000\nx 1 2")))
    assert set(formula) >= {"0.12", "34", "1000", "5"} and "12" in formula and "512" not in formula
    for word, value in (("十", 10), ("二十三", 23), ("一百零五", 105), ("零", 0), ("12", 12), ("x", None)):
        assert one(spark, numeric.cn_numeral(F.lit(word))) == value
    assert one(spark, numeric.guarded_ratio(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, numeric.circled_digit(F.lit("③"))) == 3


def test_numbering_and_families(spark):
    n = lambda t: one(spark, numeric.parse_numbering(F.lit(t)))
    assert n("第二章 方法").ordinal_path == [2] and n("一、引言").depth == 1 and n("1.2.3 x").ordinal_path == [1, 2, 3] and n("2 Methods").ordinal_path == [2] and n("Methods") is None
    f = lambda t: one(spark, numeric.heading_family(F.lit(t))).family
    assert [f(x) for x in ("第一章", "Chapter 2", "1.2 a", "3 b", "二、c", "（一）d", "(4) e", "①f", "plain")] == ["chapter_cn", "chapter_cn", "decimal_path", "arabic_main", "cn_main", "cn_paren", "arabic_paren", "circled", "plain"]


def test_contract_and_cells(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert [tuple(r) for r in arrays.check_contract(df, "id", [("required", "$.v", F.col("v").isNotNull())]).collect()] == [(2, "required", "$.v")]
    assert one(spark, arrays.pipe_cells(F.lit(r"| a | b\|c |"))) == ["a", "b|c"]
    assert one(spark, arrays.is_separator_row(F.array(F.lit("---"), F.lit(":-:"))))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.。 1,\n", max_size=400), st.integers(4, 60))
def test_split_text_keeps_all(value, most):
    parts = structure.split_text(value, most)
    assert "".join(parts) == value and all(len(p) <= most for p in parts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.。,1 ", min_size=1, max_size=300), st.integers(6, 40))
def test_choose_end_moves_on(value, most):
    at = 0
    while at < len(value):
        end = structure.choose_end(value, at, len(value), most)
        assert at < end <= at + most or end == len(value)
        at = end
