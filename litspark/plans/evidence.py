"""Queries of evidence contracts, gates, revisions and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.functions.arrays import pipe_cells
from litspark.functions.text import extractive_summary, lead_excerpt, ordered_clause_support, qualifier_dropped
from litspark.operators import evidence as ev
from litspark.operators.cards import project_cards  # noqa: F401
from litspark.plans.query import Tables, query


@query("""SELECT item_id, left(sha256(a || chr(31) || text), 24) AS unit_hash FROM (SELECT item_id, text, 'anchor_' || left(sha256('g1' || chr(31) || 'finding' || chr(31) || 'q' || (item_id % 3) || chr(30) || 'r' || (item_id % 2)), 24) AS a FROM benchmark)""")
def q_evidence_ids(t: Tables) -> DataFrame:
    cites = F.array(F.concat(F.lit("r"), (F.col("item_id") % 2).cast("string")), F.concat(F.lit("q"), (F.col("item_id") % 3).cast("string")))
    df = t.benchmark.select("item_id", "text", F.lit("g1").alias("g"), F.lit("finding").alias("kind"), cites.alias("cites"))
    return ev.evidence_ids(df, "g", "kind", "cites", "text").select("item_id", F.substring("unit_id", 6, 24).alias("unit_hash"))


GATE = """f AS (SELECT doc_id, CASE WHEN quality = 1 AND doc_id % 3 = 0 THEN 'directly_supported' WHEN doc_id % 3 = 1 THEN 'partial' ELSE 'unsupported' END AS verdict FROM labels),
d AS (SELECT doc_id, verdict, c, CASE WHEN verdict = 'directly_supported' THEN 'passed_first_pass' WHEN doc_id % 11 = 0 THEN 'passed_quote_containment' WHEN doc_id % 13 = 0 THEN 'accepted_human_override' WHEN c IS NULL THEN 'confirmation_missing' WHEN c = 'directly_supported' THEN 'gate_disagreement' ELSE 'confirmed_blocker' END AS decision
 FROM (SELECT *, CASE WHEN doc_id % 4 > 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'directly_supported' ELSE 'unsupported' END END AS c FROM f))"""


def first_reviews(t: Tables) -> DataFrame:
    m = F.col("doc_id") % 3
    return t.labels.select("doc_id", F.when((F.col("quality") == 1) & (m == 0), "directly_supported").when(m == 1, "partial").otherwise("unsupported").alias("verdict"))


def decided(t: Tables) -> DataFrame:
    confirm = t.labels.filter("doc_id % 4 > 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "directly_supported").otherwise("unsupported").alias("verdict"))
    return ev.gate_decisions(first_reviews(t), confirm, t.labels.filter("doc_id % 13 = 0"), t.labels.filter("doc_id % 11 = 0"), "doc_id")


@query(f"WITH {GATE} SELECT doc_id, decision, CASE decision WHEN 'confirmed_blocker' THEN c WHEN 'passed_quote_containment' THEN 'directly_supported' ELSE verdict END AS effective FROM d")
def q_gate_decisions(t: Tables) -> DataFrame:
    return decided(t)


@query(f"WITH {GATE} SELECT CASE WHEN count(*) FILTER (decision = 'gate_disagreement') > 0 THEN 'disagreement' WHEN count(*) FILTER (decision = 'confirmed_blocker') > 0 THEN 'confirmed' WHEN count(*) FILTER (decision = 'confirmation_missing') > 0 THEN 'missing' ELSE 'none' END AS failure, count(*) FILTER (decision = 'gate_disagreement') AS n_disagreement, count(*) FILTER (decision = 'confirmed_blocker') AS n_blocker, count(*) FILTER (decision = 'confirmation_missing') AS n_missing FROM d")
def q_failure_class(t: Tables) -> DataFrame:
    return ev.failure_class(decided(t))


@query(f"WITH {GATE} SELECT doc_id FROM f WHERE verdict <> 'directly_supported' AND doc_id % 11 > 0 AND doc_id % 13 > 0")
def q_confirm_queue(t: Tables) -> DataFrame:
    return ev.confirmation_queue(first_reviews(t), t.labels.filter("doc_id % 11 = 0"), t.labels.filter("doc_id % 13 = 0"), "doc_id").select("doc_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'not_reviewed' WHEN doc_id % 3 = 1 THEN 'not_supported' ELSE 'must_be_direct' END AS why FROM labels WHERE doc_id % 10 = 0 OR doc_id % 3 = 1 OR (doc_id % 3 = 2 AND quality = 1)""")
def q_statement_gate(t: Tables) -> DataFrame:
    s = t.labels.select("doc_id", F.when(F.col("quality") == 1, "direct").otherwise("any").alias("required"))
    r = t.labels.filter("doc_id % 10 > 0").select("doc_id", F.when(F.col("doc_id") % 3 == 1, "partial").when(F.col("doc_id") % 3 == 2, "inferred").otherwise("directly_supported").alias("verdict"))
    return ev.gate_statements(s, r, "doc_id")


@query("""WITH l AS (SELECT doc_id % 40 AS statement, doc_id AS unit FROM labels), b AS (SELECT DISTINCT unit FROM l WHERE unit % 3 = 0), s AS (SELECT DISTINCT statement FROM l WHERE statement % 4 = 0)
SELECT 'unit' AS kind, b.unit AS id, count(DISTINCT statement) AS n_related FROM b LEFT JOIN l USING (unit) GROUP BY b.unit UNION ALL SELECT 'statement', s.statement, count(DISTINCT unit) FROM s LEFT JOIN l USING (statement) GROUP BY s.statement""")
def q_semantic_issues(t: Tables) -> DataFrame:
    links = t.labels.select((F.col("doc_id") % 40).alias("statement"), F.col("doc_id").alias("unit"))
    return ev.semantic_issues(links.select("unit").distinct().filter("unit % 3 = 0"), links.select("statement").distinct().filter("statement % 4 = 0"), links)


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority || ' revised' WHEN 6 THEN CASE WHEN o_orderkey % 16 = 6 THEN o_orderpriority || '可能' END END AS claim,
CASE o_orderkey % 8 WHEN 2 THEN 'new_numbers' WHEN 3 THEN 'too_long' WHEN 5 THEN 'low_overlap' WHEN 6 THEN CASE WHEN o_orderkey % 16 <> 6 THEN 'hedge_not_quoted' END WHEN 7 THEN 'missing' END AS code FROM orders WHERE o_orderkey % 8 <> 4""")
def q_apply_correction(t: Tables) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    units = t.orders.select(k.alias("k"), p.alias("claim"), F.when(k % 16 == 6, "可能如此").otherwise("如此").alias("quote"))
    m = k % 8
    fixed = F.when(m == 1, F.concat(p, F.lit(" revised"))).when(m == 2, "77 new").when(m == 3, F.repeat(F.lit("long "), F.lit(20))).when(m == 5, "####").when(m == 6, F.concat(p, F.lit("可能")))
    corrections = t.orders.filter(m < 7).select(k.alias("k"), F.when(m == 0, "keep").when(m == 4, "delete").otherwise("replace").alias("action"), fixed.alias("replacement"))
    kept, bad = ev.apply_correction(units, corrections, ["k"])
    return kept.withColumn("code", F.lit(None).cast("string")).unionByName(bad.withColumn("claim", F.lit(None).cast("string")))


FACTS = """f AS (SELECT l_orderkey AS unit, 'h' || l_partkey % 50 AS header, 'r' || l_suppkey % 10 AS row_id, l_linenumber % 3 AS col, CAST(CAST(l_quantity AS INT) % 5 AS VARCHAR) AS fact, 'row ' || l_suppkey % 10 AS label FROM lineitem),
u AS (SELECT o_orderkey AS unit, 'row ' || o_custkey % 10 || CASE WHEN o_orderkey % 3 = 0 THEN ' 最高' ELSE '' END AS claim FROM orders),
n AS (SELECT unit, count(*) AS n FROM f GROUP BY unit),
m AS (SELECT f.*, CAST(regexp_matches(claim, '最高') AS INT) AS ranks, CAST(NOT contains(replace(claim, ' ', ''), replace(label, ' ', '')) AS INT) AS unnamed, n FROM f JOIN u USING (unit) JOIN n USING (unit)),
o AS (SELECT header, row_id, col, fact, arg_min(unit, (ranks, unnamed, n, unit)) AS owner, count(DISTINCT unit) AS n_units FROM m GROUP BY ALL HAVING count(DISTINCT unit) > 1)"""


def stated_facts(t: Tables) -> tuple[DataFrame, DataFrame]:
    s = F.col("l_suppkey") % 10
    facts = t.lineitem.select(F.col("l_orderkey").alias("unit"), F.concat(F.lit("h"), F.col("l_partkey") % 50).alias("header"), F.concat(F.lit("r"), s).alias("row"), (F.col("l_linenumber") % 3).alias("column"), (F.col("l_quantity").cast("int") % 5).cast("string").alias("fact"), F.concat(F.lit("row "), s).alias("row_label"))
    claim = F.concat(F.lit("row "), F.col("o_custkey") % 10, F.when(F.col("o_orderkey") % 3 == 0, " 最高").otherwise(""))
    return facts, t.orders.select(F.col("o_orderkey").alias("unit"), claim.alias("claim"))


@query(f"WITH {FACTS} SELECT header, row_id, col, fact, owner, n_units FROM o")
def q_fact_owner(t: Tables) -> DataFrame:
    owners, _ = ev.fact_owner(*stated_facts(t))
    return owners.withColumnsRenamed({"row": "row_id", "column": "col"})


@query(f"WITH {FACTS} SELECT owner, count(*) AS n_delegated FROM (SELECT DISTINCT m.unit, header, row_id, col, fact, owner FROM m JOIN o USING (header, row_id, col, fact) WHERE m.unit <> owner) GROUP BY owner")
def q_delegated_facts(t: Tables) -> DataFrame:
    return ev.fact_owner(*stated_facts(t))[1].groupBy("owner").agg(F.count(F.lit(1)).alias("n_delegated"))


@query()
def q_label_match(t: Tables) -> DataFrame:
    rows = t.v_line.filter(F.contains("text", F.lit("|")))
    labels = rows.select("doc_id", F.explode(pipe_cells(F.col("text"))).alias("label")).filter(F.length("label") > 2).distinct()
    claims = t.documents.select("doc_id", F.col("text").alias("claim"))
    return ev.match_labels(claims, labels, "doc_id", "claim", "label").select("doc_id", "label")


@query("SELECT l_orderkey, l_linenumber, l_partkey, floor((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1) / 3) AS batch FROM lineitem")
def q_fixed_batches(t: Tables) -> DataFrame:
    return ev.fixed_batches(t.lineitem, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], 3).select("l_orderkey", "l_linenumber", "l_partkey", "batch")


@query()
def q_replacements(t: Tables) -> DataFrame:
    c = t.conversations
    return ev.replacement_candidates(c.filter("role = 'user'").withColumn("unit", F.concat_ws(":", "conv_id", "turn")), c.filter("role <> 'user'").withColumn("unit", F.concat_ws(":", "conv_id", "turn")), "conv_id", "unit", "text", "turn", 0.2)


@query("""WITH x AS (SELECT DISTINCT l_suppkey AS s, l_suppkey % 3 AS f, l_orderkey AS e FROM lineitem WHERE l_quantity > 45) SELECT a.s AS a, b.s AS b, count(*) AS n_shared, min(a.e) AS first_shared FROM x a JOIN x b ON a.e = b.e AND a.s < b.s AND a.f <> b.f GROUP BY 1, 2""")
def q_canonical(t: Tables) -> DataFrame:
    df = t.lineitem.filter("l_quantity > 45").select(F.col("l_suppkey").alias("s"), (F.col("l_suppkey") % 3).alias("f"), F.col("l_orderkey").alias("e"))
    return ev.canonical_candidates(df, "s", "f", "e")


SIGNS = "[，,；;。！？!?]"


@query(rf"""WITH w AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t, list_filter(list_transform(string_split_regex(text, '\s+'), lambda x: regexp_replace(x, '{SIGNS}', '', 'g')), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, position(w[2] IN t) > 0 AND position(w[1] IN substr(t, position(w[2] IN t) + length(w[2]))) > 0 AS supported FROM w WHERE len(w) >= 2""")
def q_clause_support(t: Tables) -> DataFrame:
    """The claim has the first two words of a text as clauses in reverse order: supported where the first comes again."""
    words = F.filter(F.transform(F.split("text", r"\s+"), lambda x: F.regexp_replace(x, SIGNS, "")), lambda x: x != "")
    df = t.documents.select("doc_id", "text", words.alias("w")).filter(F.size("w") >= 2)
    return df.select("doc_id", ordered_clause_support(F.concat(F.get("w", F.lit(1)), F.lit("，"), F.get("w", F.lit(0))), F.col("text")).alias("supported"))


@query(rf"""WITH q AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t, replace(list_filter(list_transform(string_split_regex(text, '{SIGNS}|[.]'), lambda x: regexp_replace(x, '\s+', '', 'g')), lambda x: x <> '')[1], 'the', '') AS c FROM documents),
d AS (SELECT doc_id, CASE WHEN contains(t, c) THEN NULL WHEN NOT contains(c, 'the') AND contains(t, 'the') AND contains(replace(t, 'the', ''), c) THEN 'the' WHEN NOT contains(c, 'und') AND contains(t, 'und') AND contains(replace(t, 'und', ''), c) THEN 'und' END AS dropped FROM q WHERE c <> '')
SELECT * FROM d WHERE dropped IS NOT NULL""")
def q_qualifier_dropped(t: Tables) -> DataFrame:
    """The claim is the first clause of a text without the word that stands for a qualifier."""
    parts = F.filter(F.transform(F.split("text", SIGNS + "|[.]"), lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: x != "")
    df = t.documents.select("doc_id", qualifier_dropped(F.replace(F.get(parts, F.lit(0)), F.lit("the"), F.lit("")), F.col("text"), ["the", "und"]).alias("dropped"))
    return df.filter("dropped IS NOT NULL")


@query()
def q_excerpts(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", lead_excerpt(c).alias("excerpt"), F.length(extractive_summary(c, 300)).alias("summary_chars"))
