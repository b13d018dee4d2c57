"""Queries of the full audits, and of functions that no other query shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.functions import numeric, text
from litspark.operators import completeness as full
from litspark.operators import structure as st
from litspark.operators.relations import cover_lines
from litspark.plans.joins import SECTIONS, sections
from litspark.plans.query import Tables, query

LAYERS = f"""{SECTIONS}, rg AS (SELECT conv_id, section_id, start_line + 1 AS s, end_line AS e, CASE WHEN section_id = 1 THEN 'abstract' WHEN section_id % 4 = 0 THEN 'back_matter' ELSE 'body' END AS role FROM hd),
rg2 AS (SELECT conv_id, s, e, role FROM rg UNION ALL SELECT conv_id, s, e, role FROM rg WHERE conv_id % 7 = 0 AND section_id = 1),
bl AS (SELECT conv_id, section_id AS block, s, e FROM rg WHERE role <> 'back_matter' AND section_id % 5 <> 3),
mb AS (SELECT conv_id, block FROM bl, (VALUES (1), (2)) v(k) WHERE block % 3 <> 2 AND (k = 1 OR block % 6 = 1)),
lg AS (SELECT v.conv_id, v.line_number, count(s) AS n, min(role) AS role FROM v_md v LEFT JOIN rg2 ON v.conv_id = rg2.conv_id AND line_number BETWEEN s AND e WHERE trim(text) <> '' GROUP BY 1, 2),
lb AS (SELECT lg.conv_id, line_number, n, role, count(s) > 0 AS held, n = 1 AND coalesce(role IN ('abstract', 'body'), false) AS wanted FROM lg LEFT JOIN bl ON lg.conv_id = bl.conv_id AND line_number BETWEEN s AND e GROUP BY 1, 2, 3, 4),
lc AS (SELECT conv_id, count(*) FILTER (n = 1) / count(*) AS r1, coalesce(count(*) FILTER (wanted AND held) / nullif(count(*) FILTER (wanted), 0), 0) AS r2, string_agg(CASE WHEN n = 0 THEN line_number END, ',' ORDER BY line_number) AS none, string_agg(CASE WHEN n > 1 THEN line_number END, ',' ORDER BY line_number) AS many, string_agg(CASE WHEN wanted AND NOT held THEN line_number END, ',' ORDER BY line_number) AS out FROM lb GROUP BY 1),
bn AS (SELECT bl.conv_id, bl.block, count(mb.block) AS n FROM bl LEFT JOIN mb ON bl.conv_id = mb.conv_id AND bl.block = mb.block GROUP BY 1, 2),
bc AS (SELECT conv_id, count(*) FILTER (n > 0) / count(*) AS r3, string_agg(CASE WHEN n = 0 THEN block END, ',' ORDER BY block) AS missing, string_agg(CASE WHEN n > 1 THEN block END, ',' ORDER BY block) AS twice FROM bn GROUP BY 1)"""


def layers(t: Tables) -> dict[str, DataFrame]:
    """Regions, blocks, members and ledger of conversations: sections are regions by number, some twice, some without a block or card."""
    n = F.col("section_id")
    role = F.when(n == 1, "abstract").when(n % 4 == 0, "back_matter").otherwise("body")
    regions = sections(t).select("conv_id", "section_id", (F.col("start_line") + 1).alias("start_line"), "end_line", role.alias("role"))
    blocks = regions.filter("role <> 'back_matter' AND section_id % 5 <> 3").withColumnRenamed("section_id", "block")
    cards = F.when(F.col("block") % 6 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    members = blocks.filter("block % 3 <> 2").select("conv_id", F.explode(cards).alias("card"), "block")
    twice = regions.unionByName(regions.filter("conv_id % 7 = 0 AND section_id = 1"))
    lines = t.v_md.filter(F.trim("text") != "")
    return {"regions": regions, "blocks": blocks, "members": members, "lines": lines, "ledger": cover_lines(lines, twice, "conv_id", "line_number")}


@query(f"""{LAYERS} SELECT lc.conv_id, round(r1, 6) AS source_to_region_ratio, round(r2, 6) AS region_to_block_ratio, round(coalesce(r3, 0), 6) AS block_to_card_ratio, coalesce(none, '') AS unassigned_lines, coalesce(many, '') AS multiple_lines, coalesce(out, '') AS unblocked_lines, coalesce(missing, '') AS missing_blocks, coalesce(twice, '') AS multiple_blocks FROM lc LEFT JOIN bc ON lc.conv_id = bc.conv_id""")
def q_layered_coverage(t: Tables) -> DataFrame:
    x = layers(t)
    df = full.layered_coverage(x["ledger"], x["blocks"], x["members"], "conv_id", "line_number")
    return df.select("conv_id", *[F.round(c, 6).alias(c) if c.endswith("ratio") else F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in df.columns[1:]])


@query(f"""{LAYERS}, p AS (SELECT DISTINCT conv_id AS k FROM conversations), ru AS (SELECT k, CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, k % 3 AS g FROM p WHERE k % 11 < 10), cu AS (SELECT k, k % 4 AS g FROM p WHERE k % 9 <> 1),
ca AS (SELECT conv_id, s, CASE WHEN conv_id % 6 = 0 THEN e + 2 ELSE e END AS e FROM bl WHERE conv_id % 10 <> 7), bk AS (SELECT DISTINCT ca.conv_id AS k FROM ca JOIN rg ON ca.conv_id = rg.conv_id AND role = 'back_matter' AND ca.s <= rg.e AND ca.e >= rg.s),
le AS (SELECT conv_id, line_number, CASE WHEN n = 0 AND conv_id % 2 = 0 THEN 1 ELSE n END AS n FROM lg WHERE conv_id % 8 <> 5 AND NOT (conv_id % 10 = 2 AND line_number = 2)),
of AS (SELECT DISTINCT lg.conv_id AS k FROM lg LEFT JOIN le ON lg.conv_id = le.conv_id AND lg.line_number = le.line_number WHERE coalesce(le.n, 0) <> 1),
x AS (SELECT p.k, status, ru.g AS rg, cu.g AS cg, cu.k IS NOT NULL AS cur, lc.conv_id IS NOT NULL AS proof, lc.*, bc.*, p.k IN (SELECT conv_id FROM ca) AS held, p.k IN (SELECT k FROM bk) AS back, p.k IN (SELECT conv_id FROM le) AS led, p.k IN (SELECT k FROM of) AS off
 FROM p LEFT JOIN ru ON p.k = ru.k LEFT JOIN cu ON p.k = cu.k LEFT JOIN lc ON p.k = lc.conv_id AND p.k % 13 < 12 LEFT JOIN bc ON p.k = bc.conv_id)
SELECT k AS conv_id, unnest(list_filter([CASE WHEN status = 'failed' THEN 'run.latest_failed' END, CASE WHEN status = 'completed' AND NOT held THEN 'material.no_current_cards' END, CASE WHEN NOT proof THEN 'coverage.missing' END,
 CASE WHEN proof AND (r1 < 1 OR none IS NOT NULL) THEN 'coverage.unassigned_source_line' END, CASE WHEN proof AND many IS NOT NULL THEN 'coverage.overlapping_source_line' END, CASE WHEN proof AND (r2 < 1 OR out IS NOT NULL) THEN 'coverage.unblocked_source_line' END,
 CASE WHEN proof AND coalesce(r3, 0) < 1 THEN 'coverage.missing_body_content' END, CASE WHEN proof AND twice IS NOT NULL THEN 'coverage.unexpected_overlap' END, CASE WHEN back THEN 'region.back_matter_in_material' END,
 CASE WHEN status = 'completed' AND NOT cur THEN 'material.current_generation_missing' END, CASE WHEN status = 'completed' AND cur AND rg <> cg THEN 'material.current_generation_mismatch' END, CASE WHEN NOT led THEN 'coverage.line_ledger_missing' END, CASE WHEN led AND off THEN 'coverage.line_ledger_mismatch' END], lambda c: c IS NOT NULL)) AS code FROM x""")
def q_structure_issues(t: Tables) -> DataFrame:
    x, k = layers(t), F.col("conv_id")
    papers = t.conversations.select("conv_id").distinct()
    runs = papers.filter(k % 11 < 10).withColumns({"status": F.when(k % 5 == 0, "failed").otherwise("completed"), "generation": k % 3})
    current = papers.filter(k % 9 != 1).withColumn("generation", k % 4)
    coverage = full.layered_coverage(x["ledger"], x["blocks"], x["members"], "conv_id", "line_number").filter(k % 13 < 12)
    cards = x["blocks"].filter(k % 10 != 7).withColumn("end_line", F.when(k % 6 == 0, F.col("end_line") + 2).otherwise(F.col("end_line")))
    bare = (F.col("assignment_count") == 0) & (k % 2 == 0)
    ledger = x["ledger"].filter((k % 8 != 5) & ~((k % 10 == 2) & (F.col("line_number") == 2)))
    ledger = ledger.withColumns({"role": F.when(bare, "scope_marker").otherwise(F.col("role")), "assignment_count": F.when(bare, 1).otherwise(F.col("assignment_count"))})
    return full.audit_structure(papers, runs, current, coverage, cards, x["regions"], x["lines"], ledger, "conv_id", "line_number")


STRIPPED = lambda c: f"regexp_replace({c}, '^[\\s　]+|[\\s　]+$', '', 'g')"
TAG = "'(?i)</?(?:" + "|".join(text.KNOWN_TAGS) + ")\\b[^>]*>'"


@query(rf"""WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS v2, ['evidence_card', 'chapter', 'evidence_chunk', 'evidence_card'][doc_id % 4 + 1] AS kind, CASE WHEN doc_id % 5 = 0 THEN '' ELSE {STRIPPED('text')} END AS s, CASE WHEN doc_id % 7 = 0 THEN '' ELSE {STRIPPED('text')} END AS x, CASE WHEN doc_id % 7 = 0 THEN text ELSE text END AS w,
 CASE doc_id % 6 WHEN 0 THEN 'Evidence chunk 7' WHEN 1 THEN {STRIPPED('left(text, 5)')} WHEN 2 THEN '' WHEN 3 THEN 'A Record 1' ELSE '1 ' || lang END AS t, CASE WHEN doc_id % 3 = 0 THEN ['card.short_tail', 'table.row_too_long'] WHEN doc_id % 3 = 1 THEN ['other', 'media.image_omitted'] ELSE [] END AS f, len(string_split(text, chr(10))) AS n FROM documents)
SELECT doc_id, unnest(list_filter([CASE WHEN s = '' THEN 'summary.empty' END, CASE WHEN regexp_matches(s, {TAG}) THEN 'summary.contains_markup' END, CASE WHEN length(s) > 500 THEN 'summary.too_long' END, CASE WHEN length(s) >= 300 AND NOT regexp_matches(s, '[。！？!?；;.)）\]】]$') THEN 'summary.possibly_truncated' END, CASE WHEN s <> '' AND t <> '' AND starts_with(s, t) THEN 'summary.repeats_title' END,
 CASE WHEN v2 AND x = '' THEN 'extract.empty' END, CASE WHEN v2 AND regexp_matches(x, {TAG}) THEN 'extract.contains_markup' END, CASE WHEN v2 AND length(x) > 1400 AND doc_id % 3 > 0 THEN 'extract.too_long' END, CASE WHEN t = '' THEN 'title.empty' END, CASE WHEN regexp_matches(t, '(?i)^Evidence chunk [0-9]+$') THEN 'title.generic' END, CASE WHEN regexp_matches(t, 'Record|\x{{FFFD}}|[A-Za-z]{{2,}}$') THEN 'title.polluted' END,
 CASE WHEN doc_id % 3 = 0 THEN 'card.short_tail' END, CASE WHEN doc_id % 3 = 0 THEN 'table.row_too_long' END, CASE WHEN doc_id % 3 = 1 THEN 'media.image_omitted' END, CASE WHEN kind = 'chapter' AND n < 3 THEN 'chapter.too_short' END, CASE WHEN kind = 'chapter' AND n > 700 THEN 'chapter.too_long' END,
 CASE WHEN kind = 'evidence_chunk' AND length(w) < 80 THEN 'chunk.too_short' END, CASE WHEN kind = 'evidence_chunk' AND length(w) > 1600 THEN 'chunk.too_long' END, CASE WHEN v2 AND kind = 'evidence_card' AND length(w) > 1400 AND doc_id % 3 > 0 THEN 'card.too_long' END], lambda c: c IS NOT NULL)) AS code FROM d""")
def q_card_issues(t: Tables) -> DataFrame:
    k, c = F.col("doc_id"), F.col("text")
    kinds = F.array(*[F.lit(x) for x in ("evidence_card", "chapter", "evidence_chunk", "evidence_card")])
    title = F.when(k % 6 == 0, "Evidence chunk 7").when(k % 6 == 1, F.substring(c, 1, 5)).when(k % 6 == 2, "").when(k % 6 == 3, "A Record 1").otherwise(F.concat(F.lit("1 "), "lang"))
    flags = F.when(k % 3 == 0, F.array(F.lit("card.short_tail"), F.lit("table.row_too_long"))).when(k % 3 == 1, F.array(F.lit("other"), F.lit("media.image_omitted")))
    df = t.documents.select(
        "doc_id",
        F.when(k % 2 == 0, "material.v2").alias("schema_version"),
        F.get(kinds, (k % 4).cast("int")).alias("material_type"),
        F.when(k % 5 != 0, c).alias("summary"),
        F.when(k % 7 != 0, c).alias("extract"),
        title.alias("clean_title"),
        F.lit(None).cast("string").alias("raw_title"),
        flags.alias("quality_flags"),
        F.size(F.split(c, "\n")).alias("span_lines"),
        c.alias("source_text"),
    )
    return full.audit_card_records(df, "doc_id")


def sampled(t: Tables) -> DataFrame:
    """Events as sampled runs, with checks by number."""
    k = F.col("event_id")
    pick = lambda n, *xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % n).cast("int"))
    made = {"convert_full_md_exists": k % 5 > 0, "convert_markdown_too_short": k % 7 == 0, "parse_structure_exists": k % 3 > 0, "parse_outline_exists": k % 11 > 0, "parse_no_body_nodes": k % 4 == 0, "parse_outline_matches_structure": k % 8 > 0, "summary_artifacts_complete": k % 9 > 0, "summary_root_count_match": k % 10 > 0, "summary_tree_exists": k % 2 == 0, "slow_processing": k % 13 == 0}
    checks = F.create_map(*[x for name, c in made.items() for x in (F.lit(name), c)])
    return t.events.select(
        "event_id",
        pick(6, "convert", "parse", "summarize", None, None, None).alias("failure_stage"),
        F.when(k % 2 == 0, "failed").otherwise("parsed").alias("stage_reached"),
        pick(4, "Timeout x", "No headings found", None, "other").alias("exception"),
        checks.alias("checks"),
        pick(5, "xs", "s", "m", "l", "xl").alias("bucket"),
        F.when(F.col("user_id") % 2 == 0, "thesis_like").otherwise("unknown").alias("category"),
        F.col("user_id").alias("duplicate_key"),
    )


@query("""WITH e AS (SELECT event_id, event_id AS k, CASE event_id % 6 WHEN 0 THEN 'convert' WHEN 1 THEN 'parse' WHEN 2 THEN 'summarize' ELSE '' END AS f FROM events)
SELECT event_id, unnest(list_filter([CASE WHEN f = 'convert' THEN CASE WHEN k % 4 = 0 THEN 'convert_timeout' ELSE 'convert_failed' END END, CASE WHEN f = 'parse' THEN CASE WHEN k % 4 = 1 THEN 'parse_no_headings' ELSE 'parse_failed' END END, CASE WHEN f = 'summarize' THEN 'summary_failed' END, CASE WHEN k % 5 = 0 THEN 'convert_missing_full_md' END, CASE WHEN k % 7 = 0 THEN 'convert_markdown_short' END,
 CASE WHEN k % 3 = 0 AND f <> 'parse' THEN 'parse_structure_missing' END, CASE WHEN k % 11 = 0 AND f <> 'parse' THEN 'parse_outline_missing' END, CASE WHEN k % 4 = 0 THEN 'parse_no_body_nodes' END, CASE WHEN k % 8 = 0 AND k % 3 > 0 THEN 'parse_outline_mismatch' END, CASE WHEN k % 9 = 0 AND f <> 'summarize' AND k % 2 = 0 THEN 'summary_artifacts_missing' END,
 CASE WHEN k % 10 = 0 AND k % 2 = 0 THEN 'summary_root_mismatch' END, CASE WHEN k % 13 = 0 THEN 'slow_processing' END], lambda c: c IS NOT NULL)) AS code FROM e""")
def q_sample_issues(t: Tables) -> DataFrame:
    return full.sample_issues(sampled(t), "event_id")


@query("""WITH e AS (SELECT event_id AS k, user_id AS u FROM events), m AS (SELECT k, unnest(list_filter([CASE WHEN k % 6 = 0 AND k % 5 >= 3 THEN 'large_convert' END, CASE WHEN u % 2 = 0 AND k % 4 = 0 THEN 'thesis_without_body' END, CASE WHEN k % 5 >= 3 AND (k % 6 = 2 OR k % 10 = 0) THEN 'long_summary' END, CASE WHEN k % 5 = 0 AND k % 7 = 0 THEN 'tiny_markdown' END], lambda c: c IS NOT NULL)) AS pattern FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY k) AS i FROM m) SELECT pattern, count(*) AS n, string_agg(CASE WHEN i <= 3 THEN k END, ',' ORDER BY k) AS first_ids FROM r GROUP BY 1 UNION ALL SELECT 'duplicate_files', count(*), '' FROM (SELECT u FROM e WHERE u IS NOT NULL GROUP BY u HAVING count(*) > 1) HAVING count(*) > 0""")
def q_sample_patterns(t: Tables) -> DataFrame:
    return full.sample_patterns(sampled(t), "event_id").withColumn("first_ids", F.array_join(F.col("first_ids").cast("array<string>"), ","))


@query("""WITH p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'failed' ELSE 'completed' END AS st, CASE WHEN c_custkey % 7 > 0 THEN 'g' || (c_custkey % 2) END AS g FROM customer),
c AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN '' WHEN o_orderkey % 9 = 0 THEN 'same' ELSE CAST(o_orderkey AS VARCHAR) END AS id, CASE WHEN o_orderkey % 30 = 0 THEN 'old' ELSE 'g' || (o_custkey % 2) END AS g, CASE WHEN o_orderkey % 40 = 3 THEN '' ELSE 'f' END AS f FROM orders),
i AS (SELECT k, count(*) AS n, count(*) FILTER (id = '') AS e, count(*) FILTER (id <> '') - count(DISTINCT CASE WHEN id <> '' THEN id END) AS d, min(g) AS lo, max(g) AS hi, count(*) FILTER (f = '') AS b FROM c GROUP BY 1)
SELECT p.k AS paper, unnest(list_filter([CASE WHEN p.k % 10 = 0 THEN 'not_one_paper' END, CASE WHEN p.k % 10 > 0 AND st <> 'completed' THEN 'not_completed' END, CASE WHEN p.k % 10 > 0 AND p.g IS NULL THEN 'no_generation' END, CASE WHEN n IS NULL THEN 'no_cards' END, CASE WHEN e > 0 THEN 'empty_id' END, CASE WHEN d > 0 THEN 'repeated_id' END,
 CASE WHEN n > 0 AND (lo IS DISTINCT FROM p.g OR hi IS DISTINCT FROM p.g) THEN 'generation_mismatch' END, CASE WHEN b > 0 THEN 'fingerprint_missing' END], lambda x: x IS NOT NULL)) AS code FROM p LEFT JOIN i ON p.k = i.k""")
def q_snapshot_issues(t: Tables) -> DataFrame:
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    own = lambda c: F.concat(F.lit("g"), (F.col(c) % 2).cast("string"))
    papers = t.customer.select(k.alias("paper"), F.when(k % 3 == 0, "failed").otherwise("completed").alias("status"), F.when(k % 7 > 0, own("c_custkey")).alias("generation"))
    ids = F.when(o % 50 == 0, "").when(o % 9 == 0, "same").otherwise(o.cast("string"))
    cards = t.orders.select(F.col("o_custkey").alias("paper"), ids.alias("card"), F.when(o % 30 == 0, "old").otherwise(own("o_custkey")).alias("generation"), F.when(o % 40 != 3, "f").alias("print"))
    return full.snapshot_violations(papers, papers.unionByName(papers.filter("paper % 10 = 0")), cards, "paper", "card", "generation", "print")


@query("""WITH v AS (SELECT DISTINCT l_orderkey AS k, unnest(list_filter([CASE WHEN l_quantity > 45 THEN 'too_many' END, CASE WHEN l_discount > 0.08 THEN 'too_cheap' END], lambda c: c IS NOT NULL)) AS code FROM lineitem)
SELECT code, count(*) AS n_batches, count(*) FILTER (code IS NOT NULL AND o_orderstatus = 'F') AS newly_failed FROM orders LEFT JOIN v ON o_orderkey = k GROUP BY 1""")
def q_replay_contract(t: Tables) -> DataFrame:
    batches = t.orders.select(F.col("o_orderkey").alias("batch"), (F.col("o_orderstatus") == "F").alias("passed"))
    rules = [("too_many", F.col("l_quantity") <= 45), ("too_cheap", F.col("l_discount") <= 0.08)]
    return full.replay_contract(batches, t.lineitem.withColumnRenamed("l_orderkey", "batch"), "batch", "passed", rules)


def part_tables(t: Tables) -> DataFrame:
    """Each part as a small table, some without a column of percent, some without a number in it."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    head = F.when(k % 3 == 0, "| item | share | rate |").otherwise("| item | share (%) | rate % |")
    first, second = F.when(k % 3 == 1, "n/a").otherwise(size), F.when(k % 5 == 0, size).otherwise("-")
    row = F.concat(F.lit("| "), "p_name", F.lit(" | "), first, F.lit(" | "), second, F.lit(" |"))
    return t.part.select("p_partkey", "p_name", size.alias("size"), F.concat_ws("\n", head, F.lit("|---|---|---|"), row).alias("text"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'no_percent' WHEN p_partkey % 3 = 2 OR p_partkey % 5 = 0 THEN 'recognised' ELSE 'rejected' END AS status FROM part""")
def q_percent_tables(t: Tables) -> DataFrame:
    return full.audit_tables(part_tables(t), "p_partkey", "text")


@query("""WITH x AS (SELECT p_partkey AS k, p_size || '%' AS fact, p_partkey % 3 = 2 AS share, p_partkey % 3 > 0 AND p_partkey % 5 = 0 AS rate, p_partkey % 4 AS how, p_name AS row_label FROM part)
SELECT k, fact, CASE WHEN how = 0 AND rate THEN 'rate' ELSE 'share' END AS column_label, row_label FROM x WHERE (how = 0 AND (share OR rate)) OR (how = 1 AND share)""")
def q_percent_claims(t: Tables) -> DataFrame:
    """Claims name both columns, the first one only, the fact twice, or no row."""
    cards = part_tables(t)
    fact, how = F.concat("size", F.lit("%")), F.col("p_partkey") % 4
    say = lambda *x: F.concat(*[F.lit(y) if y.startswith(" ") or y.endswith(" ") else F.col(y) for y in x])
    cards = cards.withColumn("fact", fact)
    claim = F.when(how == 0, say("The share and the Rate of ", "p_name", " was ", "fact")).when(how == 1, say("Its share for ", "p_name", " was ", "fact")).when(how == 2, say("Its share for ", "p_name", " was ", "fact", " or ", "fact")).otherwise(say("Its share was ", "fact"))
    cells = full.percent_cells(cards, "p_partkey", "text")
    compact = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    claims = cards.select("p_partkey", F.col("p_partkey").alias("k"), claim.alias("claim"))
    return full.match_percent_claims(claims, cells, "p_partkey", "k", "claim", compact)


@query(r"""WITH c AS (SELECT conv_id, turn, role, conv_id || ':' || turn AS unit, lower(regexp_replace(text, '\s+', '', 'g')) AS x, text FROM conversations WHERE text IS NOT NULL), g AS (SELECT *, list_distinct(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) AS b FROM c),
p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c),
m AS (SELECT b.unit AS blocked, s.unit AS candidate, len(list_intersect(b.b, s.b)) / nullif(len(list_distinct(list_concat(b.b, s.b))), 0) AS similarity FROM g b JOIN p pb ON b.conv_id = pb.conv_id AND b.turn = pb.turn JOIN g s ON b.conv_id = s.conv_id JOIN p ps ON s.conv_id = ps.conv_id AND s.turn = ps.turn
 WHERE b.role = 'user' AND s.role <> 'user' AND abs(pb.p - ps.p) <= 1 AND (s.turn % 4 <> 1 OR EXISTS (SELECT 1 FROM p q WHERE q.conv_id = s.conv_id AND q.turn = s.turn + 1 AND abs(q.p - pb.p) <= 1)) AND list_contains(regexp_extract_all(s.text || ' ' || s.turn || ' 0', '[0-9]+'), CAST(CASE WHEN b.turn % 4 = 0 THEN b.turn + 1 ELSE 0 END AS VARCHAR)))
SELECT blocked, candidate, round(similarity, 4) AS similarity FROM m WHERE similarity >= 0.2""")
def q_supported_replacements(t: Tables) -> DataFrame:
    c = t.conversations.filter("text IS NOT NULL").withColumn("unit", F.concat_ws(":", "conv_id", "turn"))
    needed = F.array(F.when(F.col("turn") % 4 == 0, F.col("turn") + 1).otherwise(F.lit(0)).cast("string"))
    blocked = c.filter("role = 'user'").select("conv_id", "unit", "text", F.array("turn").alias("cards"), needed.alias("needed"))
    cites = F.when(F.col("turn") % 4 == 1, F.array("turn", F.col("turn") + 1)).otherwise(F.array("turn"))
    supported = c.filter("role <> 'user'").select("conv_id", "unit", "text", cites.alias("cards"), F.concat_ws(" ", "text", "turn", F.lit("0")).alias("support"))
    cards = c.select("conv_id", F.col("turn").alias("card"), "turn")
    return full.supported_replacements(blocked, supported, cards, "conv_id", "unit", "text", "turn", numeric.digit_facts, 0.2)


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS s FROM lineitem WHERE l_quantity > 45) SELECT 'unassigned' AS kind, p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT k FROM a) UNION ALL SELECT 'multi_theme', k FROM a GROUP BY k HAVING count(*) > 1 UNION ALL SELECT 'unused', s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s FROM a)""")
def q_theme_members(t: Tables) -> DataFrame:
    assigned = t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("unit"), F.col("l_suppkey").alias("theme"))
    return full.theme_members(assigned, t.part.select(F.col("p_partkey").alias("unit")), t.supplier.select(F.col("s_suppkey").alias("theme")), "unit", "theme")


@query(r"""WITH d AS (SELECT *, lower(trim(regexp_replace(title, '[\s　]+', ' ', 'g'))) AS x FROM (SELECT doc_id, text, lang || ' & ' || source || ' / ' || doc_id AS title FROM documents))
SELECT doc_id, trim(regexp_replace(x, '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug, CAST(doc_id % 20 + 1 AS INT) AS circled, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(text || ' ' || doc_id, '[0-9]+')), lambda f: NOT list_contains(regexp_extract_all(text, '[0-9]+'), f))), ',') AS unsupported, 'Part (' || doc_id || '). x' AS heading, 'é & ' || doc_id AS unescaped, 'A1' || doc_id AS compact FROM d""")
def q_more_text(t: Tables) -> DataFrame:
    k, c = F.col("doc_id").cast("string"), F.col("text")
    circled = F.substring(F.lit(numeric.CIRCLED_DIGITS), (F.col("doc_id") % 20 + 1).cast("int"), F.lit(1))
    missing = numeric.unsupported_numbers(numeric.digit_facts(F.concat_ws(" ", c, k)), numeric.digit_facts(c))
    return t.documents.select(
        "doc_id",
        text.slugify(F.concat("lang", F.lit(" & "), "source", F.lit(" / "), k)).alias("slug"),
        numeric.circled_digit(circled).alias("circled"),
        F.array_join(missing, ",").alias("unsupported"),
        numeric.normalize_heading(F.concat(F.lit(" Part  （"), k, F.lit("）． x ...... 12"))).alias("heading"),
        text.unescape_html(F.concat(F.lit("&eacute; &amp; "), k)).alias("unescaped"),
        text.compact_nfkc(F.concat(F.lit("Ａ 1　"), k)).alias("compact"),
    )


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') || '-' || left(sha256(CAST(event_id AS VARCHAR)), 6) AS generation FROM events")
def q_generation_ids(t: Tables) -> DataFrame:
    return t.events.select("event_id", numeric.generation_id(F.col("ts"), F.col("event_id")).alias("generation"))


@query()
def q_family_hierarchy(t: Tables) -> DataFrame:
    """Turns as headings of different families; parents depend on all before, a test compares them with plain Python."""
    families = F.array(*[F.lit(x) for x in ("arabic_main", "decimal_path", "cn_paren", "plain", "decimal_path", "circled")])
    i = F.col("turn") % 6
    heads = t.conversations.filter("turn IS NOT NULL").dropDuplicates(["conv_id", "turn"]).select("conv_id", "turn", F.get(families, ((F.col("turn") + F.col("conv_id")) % 6).cast("int")).alias("family"), F.when(i < 3, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(1), F.lit(2))).alias("path"), (i % 3 + 1).cast("int").alias("depth"))
    profiles = st.numbering_profile(heads, "conv_id", "turn", "family", 0.15)
    return st.family_hierarchy(heads, profiles, "conv_id", "turn").select("conv_id", "turn", "family", "profile", "parent", "level", "fallback")
