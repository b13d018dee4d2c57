"""Queries of the bibliography operators; documents stand in for records: source as author, lang as keyword."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspark.functions import arrays, numeric, text
from litspark.operators import bib
from litspark.plans.query import V_LINE, Tables, query

TERMS = ["the", "that", "der", "les", "tion", "los"]
TOPIC = ["the", "tion", "the", "eau"]


def quoted(terms: list[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def any_sql(col: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{t}')" for t in terms) + ")"


def count_sql(col: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, '{t}') AS INT)" for t in terms) + ")"


def titled(t: Tables) -> DataFrame:
    return t.documents.withColumn("title", F.split("text", "\n")[0])


TITLED = "titled AS (SELECT *, string_split(text, chr(10))[1] AS title FROM documents)"


@query(f"""WITH {TITLED}, s AS (SELECT source AS paper, doc_id, title, {count_sql("lower(concat_ws(chr(10), title, text))", TOPIC)} AS score FROM titled),
p AS (SELECT * FROM s WHERE score > 0)
SELECT paper, doc_id, left(title, 80) AS title, score, row_number() OVER (ORDER BY score DESC, paper, doc_id) <= 8 AS in_outline FROM p""")
def q_review_pack(t: Tables) -> DataFrame:
    cards = titled(t).withColumnRenamed("source", "paper")
    score = bib.relevance_score([F.col("title"), F.col("text")], TOPIC)
    return bib.review_pack(cards, score, "paper", "doc_id", "title").withColumn("title", F.substring("title", 1, 80))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN trim(coalesce(source, '')) = '' THEN 'no_author' WHEN trim(coalesce(text, '')) = '' THEN 'no_summary'
 WHEN lang = 'de' THEN 'no_keyword' WHEN length(text) < 200 THEN 'short_notice' ELSE 'kept' END AS reason FROM documents) GROUP BY reason""")
def q_clean_reasons(t: Tables) -> DataFrame:
    df = t.documents.withColumns({"keyword": F.when(F.col("lang") != "de", F.col("lang")), "summary": F.concat(F.lit("<正>"), "text")})
    rules = bib.record_rules("source", "text", "keyword")[:3] + [("short_notice", bib.record_rules("source", "summary", "keyword", 203)[3][1])]
    return bib.reason_counts(bib.clean_records(df, rules))


@query(f"WITH {TITLED} SELECT doc_id FROM titled WHERE NOT {any_sql('title', ['the', 'der'])}")
def q_exclude_terms(t: Tables) -> DataFrame:
    return bib.exclude_terms(titled(t), "title", ["the", "der"]).select("doc_id")


@query(f"WITH {TITLED} SELECT doc_id FROM titled WHERE {any_sql('title', ['the', 'der'])}")
def q_require_terms(t: Tables) -> DataFrame:
    return bib.require_terms(titled(t), "title", ["the", "der"]).select("doc_id")


@query(f"SELECT doc_id, array_to_string(list_filter({quoted(TERMS)}, lambda x: contains(text, x)), ',') AS terms FROM documents")
def q_match_terms(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(bib.match_terms(F.col("text"), TERMS), ",").alias("terms"))


DEPTH, VALUE, TOPICAL = (["ation", "tion"], ["eau", "und"]), (["ing", "che"], ["dos", "ist"]), (["there", "schen"], ["ment", "ado"])
SCORED_SQL = f"""scored AS (SELECT *, depth + value AS quality, CASE WHEN depth + value >= 4 AND topical >= 4 THEN 'high' WHEN depth + value >= 2 AND topical >= 3 THEN 'mid' ELSE 'low' END AS level FROM (
 SELECT doc_id, source, lang, least(5, least(5, CASE WHEN length(text) > 300 THEN 3 WHEN length(text) > 150 THEN 2 ELSE 1 END + CAST({any_sql('text', DEPTH[0])} AS INT)) + CAST({any_sql('text', DEPTH[1])} AS INT)) AS depth,
 least(5, least(5, CASE WHEN length(text) > 200 THEN 3 WHEN length(text) > 100 THEN 2 ELSE 1 END + CAST({any_sql('text', VALUE[0])} AS INT)) + CAST({any_sql('text', VALUE[1])} AS INT)) AS value,
 CASE WHEN {any_sql('text', TOPICAL[0])} THEN 5 WHEN {any_sql('text', TOPICAL[1])} THEN 3 ELSE 1 END AS topical FROM documents))"""


def scored(t: Tables) -> DataFrame:
    return bib.score_quality(t.documents, "text", F.col("text"), DEPTH, VALUE, TOPICAL)


@query(f"WITH {SCORED_SQL} SELECT doc_id, depth, value, topical, quality, level FROM scored")
def q_score_quality(t: Tables) -> DataFrame:
    return scored(t).select("doc_id", "depth", "value", "topical", "quality", "level")


@query(f"""WITH {SCORED_SQL} SELECT doc_id, level, topical, quality FROM scored
 ORDER BY CASE level WHEN 'high' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END, topical DESC, quality DESC, doc_id""")
def q_rank_lit(t: Tables) -> DataFrame:
    order = F.when(F.col("level") == "high", 0).when(F.col("level") == "mid", 1).otherwise(2)
    return bib.rank_rows(scored(t).select("doc_id", "level", "topical", "quality"), order, F.desc("topical"), F.desc("quality"), F.col("doc_id"))


@query(f"WITH {SCORED_SQL} SELECT lang AS theme, count(*) AS total, count(*) FILTER (level = 'high') AS n_high, count(*) FILTER (level = 'mid') AS n_mid FROM scored GROUP BY lang")
def q_theme_stats(t: Tables) -> DataFrame:
    return bib.theme_stats(scored(t).withColumnRenamed("lang", "theme"), "theme", "level")


THEMES = [("ation", "B1"), ("eau", "C2"), ("und", "D1"), ("dos", "E3"), ("there", "E1"), ("ation", "B2")]
NAVIGATION = ["ing"]
THEMED_SQL = """themed AS (SELECT doc_id, CASE WHEN len(h) > 0 THEN list_sort(list_distinct(h)) WHEN contains(text, 'ing') THEN ['B'] ELSE ['F'] END AS themes FROM (
 SELECT doc_id, text, list_filter([CASE WHEN contains(text, 'ation') THEN 'B2' END, CASE WHEN contains(text, 'eau') THEN 'C2' END, CASE WHEN contains(text, 'und') THEN 'D1' END,
 CASE WHEN contains(text, 'dos') THEN 'E3' END, CASE WHEN contains(text, 'there') THEN 'E1' END], lambda x: x IS NOT NULL) AS h FROM documents))"""


def themed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", bib.classify_theme_multi(F.col("text"), THEMES, NAVIGATION).alias("themes"))


@query(f"WITH {THEMED_SQL} SELECT doc_id, array_to_string(themes, ',') AS themes FROM themed")
def q_theme_multi(t: Tables) -> DataFrame:
    return themed(t).select("doc_id", F.array_join("themes", ",").alias("themes"))


@query(f"""WITH {THEMED_SQL} SELECT doc_id, CASE WHEN len(list_filter(themes, lambda x: x[1] = 'E')) > 0 THEN 'E' WHEN len(list_filter(themes, lambda x: x[1] = 'B')) > 0 THEN 'B'
 WHEN len(list_filter(themes, lambda x: x[1] = 'C')) > 0 THEN 'C' WHEN len(list_filter(themes, lambda x: x[1] = 'D')) > 0 THEN 'D' ELSE 'F' END AS theme FROM themed""")
def q_theme_priority(t: Tables) -> DataFrame:
    return themed(t).select("doc_id", bib.classify_theme_priority(F.col("themes"), ["E", "B", "C", "D"], "F").alias("theme"))


@query(f"""WITH {THEMED_SQL}, e AS (SELECT unnest(themes) AS sub FROM themed), r AS (SELECT left(sub, 1) AS main, sub FROM e)
SELECT main, coalesce(sub, '*') AS sub, count(*) AS n FROM r GROUP BY ROLLUP (main, sub) HAVING main IS NOT NULL""")
def q_theme_rollup(t: Tables) -> DataFrame:
    return bib.theme_rollup(themed(t), "themes")


@query(f"""WITH {THEMED_SQL}, e AS (SELECT unnest(themes) AS sub FROM themed)
SELECT m AS main, '*' AS sub, (SELECT count(*) FROM themed WHERE list_contains(themes, m)) AS n FROM (SELECT unnest(['B', 'C', 'D', 'E', 'F']) AS m)
UNION ALL SELECT left(sub, 1), sub, count(*) FROM e GROUP BY sub""")
def q_theme_exact(t: Tables) -> DataFrame:
    return bib.theme_rollup(themed(t), "themes", "exact")


@query("SELECT doc_id AS id, source, text FROM documents UNION ALL SELECT item_id, NULL, text FROM benchmark")
def q_union_sources(t: Tables) -> DataFrame:
    return bib.union_sources(t.documents.select(F.col("doc_id").alias("id"), "source", "text"), t.benchmark.select(F.col("item_id").alias("id"), "text"))


@query("SELECT arg_min(doc_id, doc_id) AS doc_id, sha256(text) AS text_hash FROM documents GROUP BY text")
def q_dedup_first(t: Tables) -> DataFrame:
    return bib.first_by(t.documents.select("text", "doc_id"), ["text"], ["doc_id"]).select("doc_id", F.sha2("text", 256).alias("text_hash"))


HITS = "CASE WHEN doc_id % 3 = 0 THEN 'https://DOI.org/10.1/' || left(title, 20) END"


@query(f"""WITH {TITLED}, h AS (SELECT doc_id, source, lower(trim(regexp_replace(coalesce(trim({HITS}), ''), '^(https?://doi.org/|doi:)\\s*', '', 'i'))) AS d,
 trim(regexp_replace(regexp_replace(lower(left(title, 20)), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS tt FROM titled),
k AS (SELECT doc_id, CASE WHEN d <> '' THEN 'doi:' || d WHEN tt <> '' THEN 'title:' || tt END AS dedup_key, CASE WHEN d <> '' THEN 0 WHEN source = 'src1' THEN -3 WHEN source = 'src2' THEN -2 ELSE 0 END AS r FROM h)
SELECT dedup_key, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY r, doc_id) AS rn FROM k WHERE dedup_key IS NOT NULL) WHERE rn = 1""")
def q_dedup_priority(t: Tables) -> DataFrame:
    head = F.substring("title", 1, 20)
    hits = titled(t).select("doc_id", "source", head.alias("title"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://DOI.org/10.1/"), head)).alias("doi"))
    return bib.dedup_hits(hits, "doi", "title", "source", "doc_id", {"src1": 3, "src2": 2}).select("dedup_key", "doc_id")


@query("SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_partkey LIMIT 300")
def q_rank_hits(t: Tables) -> DataFrame:
    return bib.rank_rows(t.part.select("p_partkey", "p_size", "p_retailprice"), F.desc("p_size"), F.col("p_partkey"), limit=300)


@query("SELECT lang, doc_id, n_chars, rn FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 15")
def q_topn_group(t: Tables) -> DataFrame:
    return bib.topn_by(t.documents.select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 15)


@query(f"""WITH {TITLED}, d AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text), k AS (SELECT d.doc_id, length(d.text) >= 200 AS ok, {count_sql('d.text', TOPIC)} > 0 AS hit FROM d)
SELECT 'all' AS step, (SELECT count(*) FROM documents) AS n UNION ALL SELECT 'distinct', (SELECT count(*) FROM d) UNION ALL SELECT 'clean', (SELECT count(*) FROM k WHERE ok) UNION ALL SELECT 'relevant', (SELECT count(*) FROM k WHERE ok AND hit)""")
def q_funnel(t: Tables) -> DataFrame:
    """Counts after each step, from one pass over the distinct records."""
    flags = t.documents.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select("copies", (F.length("text") >= 200).alias("ok"), (text.count_terms(F.col("text"), TOPIC) > 0).alias("hit"))
    steps = flags.agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("distinct"), F.count_if("ok").alias("clean"), F.count_if(F.col("ok") & F.col("hit")).alias("relevant"))
    return steps.unpivot([], ["all", "distinct", "clean", "relevant"], "step", "n")


@query(f"""WITH {V_LINE}, f AS (SELECT *, regexp_matches(text, '^[A-Z]') AS head FROM v_line), g AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY line_number) AS grp FROM f),
s AS (SELECT *, min(line_number) OVER (PARTITION BY doc_id, grp) AS start FROM g WHERE grp > 0)
SELECT doc_id, grp AS listing, min(start) AS start_line, min(CASE WHEN line_number - start BETWEEN 1 AND 9 AND contains(text, 'token') THEN line_number END) AS found_line FROM s GROUP BY doc_id, grp""")
def q_listing_group(t: Tables) -> DataFrame:
    from litspark.sources.readers import listing_groups

    df = listing_groups(t.v_line, "doc_id", "line_number", F.col("text").rlike("^[A-Z]"), F.col("text").contains("token"))
    return df.select("doc_id", "listing", "start_line", "found_line")


@query(f"WITH {TITLED} SELECT doc_id, left(regexp_replace(title, '[<>:\"/\\\\|?*]', '_', 'g'), 80) || '.md' AS file_name, '# ' || left(title, 60) || chr(10) || chr(10) || lang AS body, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number FROM titled")
def q_render_index(t: Tables) -> DataFrame:
    body = F.concat(F.lit("# "), F.substring("title", 1, 60), F.lit("\n\n"), F.col("lang"))
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return titled(t).select("doc_id", F.concat(text.safe_filename(F.col("title")), F.lit(".md")).alias("file_name"), body.alias("body"), number.alias("number"))


@query("SELECT lang, string_agg('- ' || source || ': ' || n, chr(10) ORDER BY source) AS body FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) GROUP BY lang")
def q_report_lines(t: Tables) -> DataFrame:
    each = t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return bib.render_rows(each, ["lang"], F.concat(F.lit("- "), "source", F.lit(": "), F.col("n").cast("string")), ["source"])


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '[\\s　]+', ' ', 'g'))) AS fingerprint, left(text, 100) || CASE WHEN length(text) > 100 THEN '...' ELSE '' END AS preview, "
       "lower(regexp_replace(text, '[^0-9A-Za-z一-鿿]+', '', 'g')) AS title, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS norm, "
       "'d_' || left(sha256(doc_id || chr(31) || lang), 24) AS id, list_count(list_filter(['the', 'der'], lambda x: contains(text, x))) AS hits FROM documents")
def q_text_functions(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select(
        "doc_id",
        F.substring(text.fingerprint(c), 8, 64).alias("fingerprint"),
        text.preview(c, 100).alias("preview"),
        text.canonical_title(c).alias("title"),
        text.norm_title(c).alias("norm"),
        text.stable_id("d_", F.col("doc_id"), F.col("lang")).alias("id"),
        text.count_terms(c, ["the", "der"]).cast("long").alias("hits"),
    )


@query("""WITH s AS (SELECT page_id, regexp_replace(html, '(?i)</?(?:TAGS)\\b[^>]*>', '', 'g') AS x, html FROM pages),
u AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS y FROM s)
SELECT page_id, sha256(trim(regexp_replace(y, '[\\s　]+', ' ', 'g'))) AS visible, x <> html AS had_markup FROM u""".replace("TAGS", "|".join(text.KNOWN_TAGS)))
def q_markup(t: Tables) -> DataFrame:
    seen = text.clean_visible(F.col("html"))
    return t.pages.select("page_id", seen.alias("v")).select("page_id", F.sha2("v.text", 256).alias("visible"), "v.had_markup")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+'))), ',') AS facts, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(ceil(length(text) / 4.0) AS BIGINT) + least(900, 200 + 90 * 3) + 100 <= 2000 AS fits, "
       "round(coalesce(CAST(length(text) AS DOUBLE) / nullif(length(text) - n_chars, 0), 0), 3) AS ratio FROM documents")
def q_numeric_functions(t: Tables) -> DataFrame:
    c = F.col("text")
    tokens = numeric.token_estimate(c)
    return t.documents.select("doc_id", F.array_join(numeric.digit_facts(c), ",").alias("facts"), tokens.alias("tokens"), numeric.fits_budget(tokens, F.lit(3), 2000, 200, 90, 900, 100).alias("fits"), F.round(numeric.guarded_ratio(F.length(c), F.length(c) - F.col("n_chars")), 3).alias("ratio"))


@query()
def q_numeric_facts(t: Tables) -> DataFrame:
    """Numbers with separators and signs; the pattern looks back, which the SQL engine can't."""
    return t.documents.select("doc_id", F.array_join(F.array_sort(numeric.numeric_facts(F.col("text"))), "|").alias("facts"))


@query("SELECT doc_id, array_to_string(list_distinct(list_filter(w, lambda x: x <> '')), ' ') IS NOT NULL AS ok, len(list_distinct(list_filter(w, lambda x: x <> ''))) AS n_distinct, len(list_filter(list_distinct(w), lambda x: NOT list_contains(['the', 'of', 'a'], x))) AS n_except FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def q_array_distinct(t: Tables) -> DataFrame:
    w = F.split("text", " ")
    return t.documents.select("doc_id", F.lit(True).alias("ok"), F.size(arrays.first_distinct(w)).cast("long").alias("n_distinct"), F.size(F.array_except(w, F.array(F.lit("the"), F.lit("of"), F.lit("a")))).cast("long").alias("n_except"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AS valid FROM events")
def q_json_props(t: Tables) -> DataFrame:
    from litspark.sources.readers import parse_versioned

    df = parse_versioned(t.events, "props", "k BIGINT", ["k"])
    return df.select("event_id", "record.k", "valid")


@query("SELECT source AS key, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def q_unique_violations(t: Tables) -> DataFrame:
    from litspark.sources.readers import unique_violations

    return unique_violations(t.documents, "source")


@query("SELECT doc_id, CASE WHEN NOT (source LIKE 'src%') THEN 'bad_suffix' WHEN length(text) = 0 THEN 'empty' WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN 'duplicate_id' WHEN count(*) OVER (PARTITION BY sha256(text)) > 1 THEN 'duplicate_content' END AS violation FROM documents")
def q_check_import(t: Tables) -> DataFrame:
    from litspark.sources.readers import check_import

    return check_import(t.documents, "doc_id", "text", F.col("source").like("src%"))


@query("SELECT event_id, epoch_us(ts) / 1000000.0 - epoch_us(TIMESTAMP '2020-01-01 00:00:00') / 1000000.0 AS seconds, year(ts) AS y FROM events")
def q_date_functions(t: Tables) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return t.events.select("event_id", numeric.duration_seconds(F.lit("2020-01-01T00:00:00"), iso).alias("seconds"), numeric.year_of(iso).cast("long").alias("y"))
