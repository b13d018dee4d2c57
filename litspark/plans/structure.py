"""Queries of the line, heading, window and block operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.functions import numeric
from litspark.functions.text import title_similarity_native
from litspark.operators import bib, body, cards, segments
from litspark.operators import structure as st
from litspark.plans.joins import SECTIONS, sections
from litspark.plans.query import V_LINE, V_MD, V_RUN, Tables, query

NOISE = r"""(x <> '' AND (regexp_matches(x, '^[-‑—]{5,}\s*[0-9]+\s*[-‑—]{5,}$') OR (regexp_matches(x, '^[0-9]+$') AND length(x) <= 6) OR regexp_matches(x, '^\[[0-9]+\]$')
 OR regexp_matches(x, '^!\[.*\]\(.*\)$') OR regexp_matches(x, '^(图|表|Figure|Table)\s*[0-9]') OR regexp_matches(x, '^[_\-*=~]+$')))"""


@query(rf"""WITH {V_LINE}, s AS (SELECT *, regexp_replace(text, '^[\s　]+|[\s　]+$', '', 'g') AS x FROM v_line), k AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY line_number) AS before FROM s WHERE NOT {NOISE})
SELECT doc_id, line_number FROM k WHERE NOT (coalesce(text = before, false) AND length(x) BETWEEN 1 AND 80)""")
def q_clean_lines(t: Tables) -> DataFrame:
    return st.clean_lines(t.v_line, "doc_id", "line_number", "text").select("doc_id", "line_number")


@query(f"""WITH {V_LINE}, b AS (SELECT *, length(text) < 12 AS blank FROM v_line), r AS (SELECT *, sum(CAST(NOT blank AS INT)) OVER (PARTITION BY doc_id ORDER BY line_number) AS run FROM b),
n AS (SELECT *, sum(CAST(blank AS INT)) OVER (PARTITION BY doc_id, run ORDER BY line_number) AS n FROM r) SELECT doc_id, line_number FROM n WHERE NOT blank OR n <= 2""")
def q_collapse_blanks(t: Tables) -> DataFrame:
    """Lines of under 12 characters stand for blank ones, which these texts lack."""
    lines = t.v_line.withColumn("text", F.when(F.length("text") < 12, "").otherwise(F.col("text")))
    return st.collapse_blanks(lines, "doc_id", "line_number", "text").select("doc_id", "line_number")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number FROM conversations")
def q_numbering(t: Tables) -> DataFrame:
    return st.number_rows(t.conversations, "conv_id", ["turn"]).select("conv_id", "turn", "number")


@query(f"{SECTIONS} SELECT conv_id, section_id, start_line, end_line FROM hd")
def q_heading_spans(t: Tables) -> DataFrame:
    return sections(t).select("conv_id", "section_id", "start_line", "end_line")


@query("""WITH a AS (SELECT *, CAST(role IS DISTINCT FROM lag(role) OVER w OR lag(1) OVER w IS NULL AS INT) AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS "group" FROM a""")
def q_adjacent_groups(t: Tables) -> DataFrame:
    return st.adjacent_groups(t.conversations, "conv_id", "turn", ["role"]).select("conv_id", "turn", "group")


@query(f"""WITH {V_LINE}, p AS (SELECT *, sum(CAST(length(text) < 40 AS INT)) OVER (PARTITION BY doc_id ORDER BY line_number) AS p FROM v_line)
SELECT doc_id, min(line_number) AS start_line, max(line_number) AS end_line, count(*) AS n_lines FROM p WHERE length(text) >= 40 GROUP BY doc_id, p""")
def q_paragraphs(t: Tables) -> DataFrame:
    lines = t.v_line.withColumn("text", F.when(F.length("text") < 40, "").otherwise(F.col("text")))
    return st.paragraphs(lines, "doc_id", "line_number", "text")


@query("SELECT o_orderkey, o_orderpriority || ':' || lpad(CAST(row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS VARCHAR), 2, '0') AS id FROM orders")
def q_id_suffix(t: Tables) -> DataFrame:
    return st.suffix_ids(t.orders, F.col("o_orderpriority"), ["o_custkey"], "o_orderkey").select("o_orderkey", "id")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations")
def q_part_of_n(t: Tables) -> DataFrame:
    return st.part_of_n(t.conversations, "conv_id", "turn").select("conv_id", "turn", "i", "n")


@query("SELECT event_id, before FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE value <= before")
def q_monotonic(t: Tables) -> DataFrame:
    return st.not_increasing(t.events, "user_id", "event_id", "value").select("event_id", "before")


def headings(t: Tables) -> DataFrame:
    """Headings of the Markdown view with a depth of 1 to 3 by speaker and turn, never jumping by two."""
    h = t.v_md.filter("is_heading").select("conv_id", "line_number", "turn", F.regexp_replace("text", "^#+ ", "").alias("title"))
    return h.withColumn("depth", F.when(F.col("turn") == 0, 1).otherwise(F.least(F.lit(3), (F.col("turn") % 3 + 1))).cast("int"))


HEADS = f"""WITH {V_MD}, h AS (SELECT conv_id, line_number, turn, regexp_replace(text, '^#+ ', '') AS title, CASE WHEN turn = 0 THEN 1 ELSE least(3, turn % 3 + 1) END AS depth FROM v_md WHERE is_heading)"""


@query(f"""{HEADS}, w AS (SELECT *, {', '.join(f"last_value(CASE WHEN depth = {d} THEN title END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS t{d}" for d in (1, 2, 3))} FROM h)
SELECT conv_id, line_number, array_to_string(list_filter([CASE WHEN depth >= 1 THEN t1 END, CASE WHEN depth >= 2 THEN t2 END, CASE WHEN depth >= 3 THEN t3 END], lambda x: x IS NOT NULL), ' > ') AS path FROM w""")
def q_heading_path(t: Tables) -> DataFrame:
    return st.flat_heading_paths(headings(t), "conv_id", "line_number", "depth", "title").select("conv_id", "line_number", F.array_join("path", " > ").alias("path"))


@query()
def q_heading_path_general(t: Tables) -> DataFrame:
    """With jumps, for which the stack depends on all headings before."""
    jumping = headings(t).withColumn("depth", (F.length("title") % 4 + 1).cast("int"))
    return st.heading_paths(jumping, "conv_id", "line_number", "depth", "title").select("conv_id", "line_number", F.array_join("path", " > ").alias("path"))


@query(f"WITH {V_MD} SELECT conv_id, min(CASE WHEN regexp_matches(text, '[0-9]') AND NOT is_heading THEN line_number END) AS first FROM v_md GROUP BY conv_id")
def q_first_marker(t: Tables) -> DataFrame:
    return st.first_marker(t.v_md, "conv_id", "line_number", F.col("text").rlike("[0-9]") & ~F.col("is_heading"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def q_latest_run(t: Tables) -> DataFrame:
    return st.latest_by(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""WITH r AS (SELECT user_id, event_id, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events)
SELECT a.user_id, a.event_id AS best, a.score AS best_score, a.score >= 36 AND a.score - coalesce(b.score, 0) >= 7 AS accepted FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.k = 2 WHERE a.k = 1""")
def q_best_margin(t: Tables) -> DataFrame:
    return st.best_margin(t.events.select("user_id", "event_id", F.col("value").alias("score")), "user_id", "score", "event_id", 36, 7)


@query("SELECT event_id, coalesce(lead(CAST(floor(value) AS INT) % 5) OVER (PARTITION BY user_id ORDER BY event_id) = CAST(floor(value) AS INT) % 5 + 1, false) AS adjacent FROM events")
def q_adjacent_spans(t: Tables) -> DataFrame:
    q = F.floor("value").cast("int") % 5
    spans = t.events.select("user_id", "event_id", q.alias("start_char"), (q + 1).alias("end_char"))
    return cards.adjacent_spans(spans, "user_id", "event_id").select("event_id", "adjacent")


AREA_SQL = "CASE WHEN turn = 0 THEN 'title' WHEN turn = 2 THEN 'abstract' WHEN turn = 3 THEN 'body' WHEN length(title) % 7 = 0 THEN 'tail' END"


@query(f"""{HEADS}, s AS (SELECT *, {AREA_SQL} AS s FROM h), l AS (SELECT *, coalesce(max(CAST(s = 'body' AS INT)) OVER (PARTITION BY conv_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS locked FROM s)
SELECT conv_id, line_number, last_value(CASE WHEN locked = 1 THEN CASE WHEN s = 'tail' THEN s END ELSE s END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS area FROM l""")
def q_area_fill(t: Tables) -> DataFrame:
    state = F.when(F.col("turn") == 0, "title").when(F.col("turn") == 2, "abstract").when(F.col("turn") == 3, "body").when(F.length("title") % 7 == 0, "tail")
    return st.fill_state(headings(t), "conv_id", "line_number", state, locked="body").select("conv_id", "line_number", "area")


@query(f"""WITH {V_LINE} SELECT doc_id, line_number, coalesce(last_value(CASE WHEN regexp_matches(text, '^(The|La|Die)') THEN 'abstract' WHEN contains(text, 'ing') THEN 'keywords' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_number ROWS UNBOUNDED PRECEDING), 'front_matter') AS area FROM v_line""")
def q_front_state(t: Tables) -> DataFrame:
    mark = F.when(F.col("text").rlike("^(The|La|Die)"), "abstract").when(F.contains("text", F.lit("ing")), "keywords")
    return st.fill_state(t.v_line, "doc_id", "line_number", mark).select("doc_id", "line_number", F.coalesce("area", F.lit("front_matter")).alias("area"))


@query(rf"""WITH {V_LINE}, f AS (SELECT *, CAST(contains(text, '|') AS INT) AS bar FROM v_line), o AS (SELECT *, CAST(bar = 1 AND coalesce(lag(bar) OVER w, 0) = 0 AS INT) AS o, CAST(bar = 1 AND coalesce(lead(bar) OVER w, 0) = 0 AS INT) AS c FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY line_number)),
d AS (SELECT *, o - coalesce(lag(c) OVER w, 0) AS step FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY line_number)) SELECT doc_id, line_number, sum(step) OVER (PARTITION BY doc_id ORDER BY line_number) > 0 AS inside FROM d""")
def q_table_runs(t: Tables) -> DataFrame:
    w = st.ordered("doc_id", "line_number")
    bar = F.contains("text", F.lit("|"))
    lines = t.v_line.withColumns({"o": bar & ~F.coalesce(F.lag(bar).over(w), F.lit(False)), "c": bar & ~F.coalesce(F.lead(bar).over(w), F.lit(False))})
    return st.table_runs(lines, "doc_id", "line_number", F.col("o"), F.col("c")).select("doc_id", "line_number", "inside")


@query(f"WITH {V_MD} SELECT conv_id, line_number, 2 AS depth, trim(regexp_replace(text, '^#+\\s*', '')) AS title, 'markdown' AS origin FROM v_md WHERE regexp_matches(text, '^#{{1,6}}\\s+\\S')")
def q_headings(t: Tables) -> DataFrame:
    return st.extract_headings(t.v_md, "conv_id", "line_number", "text")


@query(f"""{SECTIONS}, s AS (SELECT hd.*, text FROM hd JOIN v_md ON hd.conv_id = v_md.conv_id AND line_number = start_line), x AS (SELECT conv_id, section_id, start_line, end_line, CASE WHEN lower(regexp_replace(text, '[^0-9A-Za-z一-鿿]+', '', 'g')) = '2assistant' THEN 1.0 WHEN contains(lower(regexp_replace(text, '[^0-9A-Za-z一-鿿]+', '', 'g')), '2assistant') THEN 0.85 ELSE 0.0 END AS score FROM s)
SELECT conv_id, section_id AS best, score AS best_score, score >= 0.72 AND score - coalesce((SELECT max(score) FROM x y WHERE y.conv_id = x.conv_id AND y.section_id <> x.section_id), 0) >= 0.15 AS accepted FROM x
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, section_id) = 1""")
def q_segments(t: Tables) -> DataFrame:
    """The section whose title is nearest to an expected one."""
    titles = t.v_md.filter("is_heading").select("conv_id", F.col("line_number").alias("start_line"), "text")
    scored = sections(t).join(titles, ["conv_id", "start_line"]).withColumn("score", title_similarity_native(F.col("text"), F.lit("2. assistant")))
    return st.best_margin(scored, "conv_id", "score", "section_id", 0.72, 0.15)


@query(f"""{HEADS}, e AS (SELECT conv_id, max(line_number) AS doc_end FROM v_md GROUP BY 1), r AS (SELECT h.conv_id, line_number AS start_line, coalesce(lead(line_number) OVER (PARTITION BY h.conv_id ORDER BY line_number) - 1, doc_end) AS end_line, CASE WHEN turn = 1 THEN 'abstract' WHEN turn = 4 THEN 'back_matter' ELSE 'body' END AS role FROM h JOIN e ON h.conv_id = e.conv_id WHERE turn > 0),
b AS (SELECT *, min(CASE WHEN role = 'back_matter' THEN start_line END) OVER (PARTITION BY conv_id) AS back, min(start_line) OVER (PARTITION BY conv_id) AS first FROM r)
SELECT conv_id, start_line, end_line, CASE WHEN start_line >= back THEN 'back_matter' ELSE role END AS role FROM b UNION ALL SELECT DISTINCT conv_id, 1, first - 1, 'front_matter' FROM b WHERE first > 1""")
def q_regions(t: Tables) -> DataFrame:
    md = t.v_md
    role = F.when(F.col("turn") == 1, "abstract").when(F.col("turn") == 4, "back_matter").otherwise("body")
    heads = headings(t).filter("turn > 0").select("conv_id", F.col("line_number").alias("start_line"), role.alias("role"))
    return st.build_regions(heads, "conv_id", "role", md.groupBy("conv_id").agg(F.max("line_number").alias("doc_end")))


@query(f"""WITH {V_LINE}, p AS (SELECT *, sum(CAST(length(text) < 40 AS INT)) OVER (PARTITION BY doc_id ORDER BY line_number) AS p FROM v_line)
SELECT doc_id, min(line_number) AS start_line, CASE WHEN bool_and(contains(text, '|')) THEN 'table' ELSE 'paragraph' END AS content_kind, sha256(string_agg(text, chr(10) ORDER BY line_number)) AS text_hash FROM p WHERE length(text) >= 40 GROUP BY doc_id, p""")
def q_blocks(t: Tables) -> DataFrame:
    lines = t.v_line.withColumn("text", F.when(F.length("text") < 40, "").otherwise(F.col("text")))
    return cards.build_blocks(lines, "doc_id", "line_number", "text").select("doc_id", "start_line", "content_kind", F.sha2("text", 256).alias("text_hash"))


def blocks(t: Tables) -> DataFrame:
    return t.v_line.filter(F.trim("text") != "").select("doc_id", F.col("line_number").alias("order"), "text")


@query()
def q_pack_cards(t: Tables) -> DataFrame:
    """Greedy packing; tests hold its invariants: every block once, in order, within the limits."""
    return cards.pack_cards(blocks(t), "doc_id", "order", "text").select("doc_id", "card", "first", "last", F.length("extract").alias("n_chars"), "short_tail")


@query(f"""WITH {V_LINE} SELECT doc_id, count(*) AS n_blocks, sum(length(text)) AS n_chars FROM v_line WHERE trim(text) <> '' GROUP BY doc_id""")
def q_pack_invariants(t: Tables) -> DataFrame:
    """What the packed cards hold, which must be what the blocks hold."""
    packed = cards.pack_cards(blocks(t), "doc_id", "order", "text")
    return packed.groupBy("doc_id").agg(F.sum("n_blocks").alias("n_blocks"), F.sum(F.length("extract") - 2 * (F.col("n_blocks") - 1)).alias("n_chars"))


@query("""SELECT conv_id || ':' || role || ':' || lpad(CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS VARCHAR), 2, '0') AS id, sha256(trim(regexp_replace(text, '[\\s　]+', ' ', 'g'))) AS fingerprint,
 role || '（' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '/' || count(*) OVER (PARTITION BY conv_id) || '）' AS title FROM conversations""")
def q_card_rows(t: Tables) -> DataFrame:
    return cards.card_rows(t.conversations, "conv_id", "turn", "role", "text").select("id", F.substring("fingerprint", 8, 64).alias("fingerprint"), "title")


@query("""SELECT doc_id, unnest(list_filter([CASE WHEN trim(text) = '' THEN 'summary.empty' END, CASE WHEN length(text) > 500 THEN 'summary.too_long' END, CASE WHEN length(text) >= 300 AND NOT regexp_matches(text, '[.!?。！？]$') THEN 'summary.possibly_truncated' END,
 CASE WHEN length(text) < 80 THEN 'chunk.too_short' END, CASE WHEN length(text) > 1600 THEN 'chunk.too_long' END, CASE WHEN regexp_matches(text, '</?[a-z]+[^>]*>') THEN 'summary.contains_markup' END], lambda x: x IS NOT NULL)) AS code FROM documents""")
def q_card_audit(t: Tables) -> DataFrame:
    return cards.audit_cards(t.documents, "doc_id", "text", "text")


@query(f"WITH {V_LINE}, r AS (SELECT doc_id, 2 AS s, 4 + doc_id % 3 AS e FROM documents), n AS (SELECT doc_id, max(line_number) AS n FROM v_line GROUP BY 1)\n"
       "SELECT r.doc_id, CASE WHEN s > n THEN 'out_of_range' WHEN e > n THEN 'clamped' ELSE 'ok' END AS status, (SELECT sha256(string_agg(text, chr(10) ORDER BY line_number)) FROM v_line l WHERE l.doc_id = r.doc_id AND line_number BETWEEN s AND e) AS text_hash FROM r JOIN n ON r.doc_id = n.doc_id")
def q_content_ref(t: Tables) -> DataFrame:
    refs = t.documents.select("doc_id", F.lit(2).alias("start_line"), (4 + F.col("doc_id") % 3).cast("int").alias("end_line"))
    return cards.resolve_refs(refs, t.v_line, "doc_id", "line_number", "text").select("doc_id", "status", F.sha2("text", 256).alias("text_hash"))


@query(f"{SECTIONS} SELECT hd.conv_id, section_id, sha256(string_agg(text, chr(10) ORDER BY line_number)) AS text_hash FROM hd JOIN v_md ON hd.conv_id = v_md.conv_id AND line_number BETWEEN start_line AND end_line GROUP BY hd.conv_id, section_id")
def q_section_text(t: Tables) -> DataFrame:
    return cards.section_texts(sections(t), t.v_md, "conv_id", "section_id", "line_number", "text").select("conv_id", "section_id", F.sha2("text", 256).alias("text_hash"))


@query(f"""{SECTIONS}, a AS (SELECT v.conv_id, count(*) AS n_lines, count(*) FILTER (c.n = 1) AS covered, count(*) FILTER (c.n > 1) AS multiple FROM v_md v JOIN (SELECT v.conv_id, line_number, count(start_line) AS n FROM v_md v LEFT JOIN hd ON v.conv_id = hd.conv_id AND line_number BETWEEN start_line + 1 AND end_line GROUP BY 1, 2) c ON v.conv_id = c.conv_id AND v.line_number = c.line_number WHERE trim(text) <> '' GROUP BY 1)
SELECT conv_id, n_lines, covered, multiple, round(covered / n_lines, 6) AS ratio, covered = n_lines AS publishable FROM a""")
def q_coverage_ledger(t: Tables) -> DataFrame:
    from litspark.operators.relations import cover_lines

    ledger = cover_lines(t.v_md.filter(F.trim("text") != ""), sections(t).withColumn("start_line", F.col("start_line") + 1), "conv_id", "line_number")
    return cards.coverage(ledger, "conv_id").withColumn("ratio", F.round("ratio", 6))


@query("SELECT text_hash, n_papers, n_members FROM (SELECT sha256(trim(regexp_replace(text, '[\\s　]+', ' ', 'g'))) AS text_hash, count(DISTINCT source) AS n_papers, count(*) AS n_members FROM documents GROUP BY 1) WHERE n_papers > 1")
def q_dup_content(t: Tables) -> DataFrame:
    return cards.duplicate_content(t.documents, "source", "text").select(F.substring("fingerprint", 8, 64).alias("text_hash"), "n_papers", "n_members")


@query("SELECT doc_id FROM documents WHERE sha256(trim(regexp_replace(text, '[\\s　]+', ' ', 'g'))) IN (SELECT sha256(trim(regexp_replace(text, '[\\s　]+', ' ', 'g'))) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def q_dup_source(t: Tables) -> DataFrame:
    return cards.duplicate_source(t.documents, "text").select("doc_id")


@query("""SELECT doc_id, CASE WHEN n_chars < 100 THEN 'red' WHEN toxic = 1 OR n_chars > 4000 THEN 'silver' ELSE 'gold' END AS label FROM documents JOIN labels USING (doc_id)""")
def q_quality_label(t: Tables) -> DataFrame:
    both = t.documents.join(t.labels, "doc_id")
    found = F.array_compact(F.array(F.when(F.col("n_chars") < 100, "error"), F.when((F.col("toxic") == 1) | (F.col("n_chars") > 4000), "warning")))
    issues = both.select("doc_id", F.explode(found).alias("severity"))
    return cards.quality_label(both.select("doc_id"), issues, "doc_id")


@query(f"""WITH {V_MD}, m AS (SELECT conv_id, count(*) AS n, count(*) FILTER (is_heading) AS h, count(*) FILTER (NOT is_heading AND trim(text) = '') AS b FROM v_md GROUP BY 1)
SELECT conv_id, unnest(list_filter([CASE WHEN h < 2 THEN 'few_headings' END, CASE WHEN n < 5 THEN 'few_lines' END, CASE WHEN b > 0 THEN 'blank_lines' END], lambda x: x IS NOT NULL)) AS code FROM m""")
def q_acceptance(t: Tables) -> DataFrame:
    m = t.v_md.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_heading").alias("h"), F.count_if(~F.col("is_heading") & (F.trim("text") == "")).alias("b"))
    return cards.rule_violations(m, "conv_id", [("few_headings", F.col("h") >= 2), ("few_lines", F.col("n") >= 5), ("blank_lines", F.col("b") == 0)])


@query(f"""{SECTIONS}, g AS (SELECT conv_id, count(*) AS n, min(start_line) AS s, max(end_line) AS e FROM hd GROUP BY 1)
SELECT conv_id, unnest(list_filter([CASE WHEN s > 1 THEN 'starts_late' END, CASE WHEN e - s + 1 < 6 THEN 'chapter.too_short' END, CASE WHEN n > 8 THEN 'many_sections' END], lambda x: x IS NOT NULL)) AS code FROM g""")
def q_structure_audit(t: Tables) -> DataFrame:
    g = sections(t).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("start_line").alias("s"), F.max("end_line").alias("e"))
    return cards.rule_violations(g, "conv_id", [("starts_late", F.col("s") <= 1), ("chapter.too_short", F.col("e") - F.col("s") + 1 >= 6), ("many_sections", F.col("n") <= 8)])


TITLES = ["目录", "1 引言 ....... 3", "摘要", "第一章 绪论", "1 引言", "1.1 背景", "一、概述", "（一）细节", "2 Methods", "参考文献", "附录B", "致谢", "Abstract", "图目录", "结论", "some title", "3.2.1 数据", "某某大学", "独创性声明", "2 方法 7"]


@query()
def q_body_lock(t: Tables) -> DataFrame:
    """Turns with titles dealt from a list; tests hold the operator against a state machine in plain Python."""
    names = F.array(*[F.lit(x) for x in TITLES])
    h = t.conversations.select("conv_id", "turn", F.get(names, (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(len(TITLES)))).cast("int")).alias("title"), "text")
    return body.lock_body(h, "conv_id", "turn", "title").select("conv_id", "turn", "title", "area", "role", "reason")


@query(f"""{HEADS} SELECT conv_id, line_number, (SELECT max(p.line_number) FROM h p WHERE p.conv_id = h.conv_id AND p.line_number < h.line_number AND p.depth < h.depth) AS parent FROM h""")
def q_hierarchy(t: Tables) -> DataFrame:
    return st.resolve_hierarchy(headings(t), "conv_id", "line_number", "depth").select("conv_id", "line_number", "parent")


@query(f"""{HEADS} SELECT conv_id, count(*) AS n, CASE WHEN count(*) FILTER (regexp_matches(title, '^[0-9]+[.、)]')) >= 2 THEN 'arabic' ELSE 'mixed_unknown' END AS profile FROM h GROUP BY conv_id""")
def q_profile(t: Tables) -> DataFrame:
    h = headings(t).withColumn("family", numeric.heading_family(F.col("title"))["family"])
    return st.detect_profile(h, "conv_id", "family")


@query(f"""{HEADS} SELECT conv_id, line_number, 1 AS depth, CAST(regexp_extract(title, '^([0-9]+)', 1) AS INT) AS ordinal, 'arabic_main' AS family FROM h""")
def q_numbering_forms(t: Tables) -> DataFrame:
    n, f = numeric.parse_numbering(F.col("title")), numeric.heading_family(F.col("title"))
    return headings(t).select("conv_id", "line_number", n["depth"].alias("depth"), n["ordinal_path"][0].alias("ordinal"), f["family"].alias("family"))


@query(f"""{HEADS}, c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, length(title) ORDER BY line_number DESC) AS k FROM h) SELECT conv_id, length(title) AS key, line_number FROM c WHERE k = 1""")
def q_chapter_dedup(t: Tables) -> DataFrame:
    nodes = headings(t).withColumn("key", F.length("title"))
    return cards.dedup_chapters(nodes, ["conv_id", "key"], ["line_number"]).select("conv_id", "key", "line_number")


@query(f"""{HEADS}, c AS (SELECT *, last_value(CASE WHEN depth = 1 THEN line_number END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS chapter FROM h)
SELECT conv_id, line_number, chapter, 'c' || dense_rank() OVER (PARTITION BY conv_id ORDER BY chapter) AS section FROM c""")
def q_section_map(t: Tables) -> DataFrame:
    return cards.section_map(headings(t), "conv_id", "line_number", "depth").select("conv_id", "line_number", "chapter", "section")


@query("""SELECT n_nationkey AS id, CASE WHEN n_regionkey IS DISTINCT FROM n_nationkey % 5 THEN 'moved' ELSE 'same' END AS status FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, 'removed' FROM nation WHERE n_nationkey >= 20""")
def q_tree_diff(t: Tables) -> DataFrame:
    a = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("parent"))
    b = t.nation.filter("n_nationkey < 20").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 5).alias("parent"))
    return cards.tree_diff(a, b, "id", "parent")


@query(f"""WITH {V_RUN}, s AS (SELECT stage, count(*) AS n, round(avg(cost), 3) AS mean FROM v_run GROUP BY stage) SELECT stage, n, mean FROM s""")
def q_stage_means(t: Tables) -> DataFrame:
    return t.v_run.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cost"), 3).alias("mean"))


@query()
def q_split_text(t: Tables) -> DataFrame:
    """Pieces of long lines; tests hold that they join to the line."""
    lines = t.v_line.filter(F.length("text") > 1400).select(F.concat_ws(":", "doc_id", "line_number").alias("id"), "text")
    return st.split_long_texts(lines, "id", "text").select("id", "part", F.length("piece").alias("n_chars"))


WINDOWS = """w AS (SELECT doc_id, i, 200 * i AS b, least(200 * i + 200 + CASE WHEN doc_id % 3 = 0 THEN 30 WHEN doc_id % 3 = 1 THEN 60 ELSE 0 END, length(text)) AS e, text FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 199) // 200)) AS i FROM documents) WHERE NOT (doc_id % 4 = 1 AND i % 3 = 2)),
q AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 AND i = 1 THEN doc_id || ':0' ELSE doc_id || ':' || i END AS quote_id, b AS start_char, e AS end_char, CASE WHEN doc_id % 11 = 5 THEN substr(text, b + 2, e - b) ELSE substr(text, b + 1, e - b) END AS quote FROM w WHERE e > b)"""


@query(f"""WITH {WINDOWS},
places AS (SELECT doc_id, unnest(range(0, length(text))) AS p, unnest(string_split(text, '')) AS ch FROM documents WHERE doc_id % 13 <> 6 AND length(text) > 0),
held AS (SELECT DISTINCT doc_id, unnest(range(start_char, end_char)) AS p FROM q),
codes AS (
  SELECT doc_id, 'not_covered' AS code, p AS pos, 1 AS n FROM places ANTI JOIN held USING (doc_id, p) WHERE NOT regexp_matches(ch, '^[\\s\\x{{85}}\\x{{a0}}\\x{{3000}}]$')
  UNION ALL SELECT q.doc_id, 'not_a_slice', start_char, 1 FROM q JOIN documents d ON d.doc_id = q.doc_id WHERE substr(d.text, start_char + 1, end_char - start_char) <> quote
  UNION ALL SELECT doc_id, 'too_long', start_char, 1 FROM q WHERE length(quote) > 240
  UNION ALL SELECT doc_id, 'several_lines', start_char, 1 FROM q WHERE contains(quote, chr(10))
  UNION ALL SELECT doc_id, 'quote_of_image', start_char, 1 FROM q WHERE doc_id % 13 = 6
  UNION ALL SELECT min(doc_id), 'id_repeated', min(start_char), count(*) FROM q GROUP BY quote_id HAVING count(*) > 1)
SELECT doc_id, code, min(pos) AS first_char, CAST(sum(n) AS BIGINT) AS n FROM codes GROUP BY doc_id, code""")
def q_quote_coverage(t: Tables) -> DataFrame:
    """Windows of 200 characters as quotes, some of which overlap, are left out, shifted, of images or share an id; gaps by place."""
    d, k, i = t.documents.select("doc_id", "text"), F.col("doc_id"), F.col("i")
    w = d.select("doc_id", "text", F.explode(F.when(F.length("text") > 0, F.sequence(F.lit(0), F.floor((F.length("text") + 199) / 200).cast("int") - 1))).alias("i")).filter(~((k % 4 == 1) & (i % 3 == 2)))
    more = F.when(k % 3 == 0, 30).when(k % 3 == 1, 60).otherwise(0)
    w = w.withColumns({"start_char": 200 * i, "end_char": F.least(200 * i + 200 + more, F.length("text"))})
    quote = F.substring("text", F.col("start_char") + F.when(k % 11 == 5, 2).otherwise(1), F.col("end_char") - F.col("start_char"))
    quotes = w.select("doc_id", F.concat_ws(":", "doc_id", F.when((k % 50 == 7) & (i == 1), 0).otherwise(i)).alias("quote_id"), "start_char", "end_char", quote.alias("quote"))
    found = st.quote_violations(quotes, d, "doc_id", "text", kind=F.when(k % 13 == 6, "image").otherwise("text"))
    return found.groupBy("doc_id", "code").agg(F.min("at").alias("first_char"), F.sum("n").alias("n"))


@query("SELECT doc_id, CAST(0 AS BIGINT) AS n_violations FROM documents")
def q_own_quotes(t: Tables) -> DataFrame:
    """The spans that split_quotes cuts break no rule in any document."""
    docs = t.documents.select("doc_id", "text")
    found = st.quote_violations(st.split_quotes(docs, "doc_id", "text"), docs, "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_violations"))


BUNDLES = ["# Deep Rivers of the North", "# Deep Rivers", "# Deep Rivers of North", "## Deep Rivers of the North", "# 学位论文原创性声明", "# 第一章 绪论", "# Other matters", "### Deep River of the North", "plain text", "# Unrelated Paper"]


@query()
def q_bundles(t: Tables) -> DataFrame:
    """The part of each conversation, read as a bundled file, that is the expected paper; tests hold it against plain Python."""
    names = F.array(*[F.lit(x) for x in BUNDLES])
    lines = t.conversations.select("conv_id", "turn", F.get(names, F.pmod(F.xxhash64("conv_id", "turn"), F.lit(len(BUNDLES))).cast("int")).alias("text"))
    return segments.select_segments(lines, lines.select("conv_id").distinct().withColumn("title", F.lit("Deep Rivers of the North")), "conv_id", "turn", "text")


@query("SELECT doc_id, text_hash FROM (SELECT doc_id, sha256(text) AS text_hash FROM documents) ORDER BY doc_id")
def q_project_card(t: Tables) -> DataFrame:
    df = cards.project_cards(t.documents.join(t.labels, "doc_id", "left"), ["doc_id"], {"title": ["lang", "source"]}, {"flags": ["lang", "source"]}, {"text": "text"})
    return bib.rank_rows(df.select("doc_id", F.sha2("text", 256).alias("text_hash")), F.col("doc_id"))
