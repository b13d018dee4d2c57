"""Queries of briefs, themes and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.operators import audits as au
from litspark.operators import synthesis as sy
from litspark.operators.relations import find_quotes
from litspark.plans.joins import TREE, tree
from litspark.plans.query import Tables, query


@query("""WITH f AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), p AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE left(text, 50) END AS point FROM benchmark)
SELECT p.item_id, CASE WHEN x.item_id IS NULL THEN 'unknown_evidence' ELSE 'not_the_claim' END AS code FROM p LEFT JOIN (SELECT DISTINCT item_id FROM f) x ON p.item_id = x.item_id JOIN benchmark b ON p.item_id = b.item_id WHERE x.item_id IS NULL OR b.text <> point""")
def q_brief_rules(t: Tables) -> DataFrame:
    found = find_quotes(t.benchmark.select("item_id", F.col("text").alias("claim")), t.documents.select("doc_id", "text"), "claim", "text")
    points = t.benchmark.select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.substring("text", 1, 50)).alias("point"))
    return au.brief_violations(points, found.select("item_id", "claim").distinct(), "item_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND source IN (SELECT source FROM documents WHERE n_chars > 15000)")
def q_revisit(t: Tables) -> DataFrame:
    return au.revisit_candidates(t.documents, t.labels.filter("quality = 1"), t.documents.filter("n_chars > 15000"), "doc_id", "source").select("doc_id")


PARTS = """units AS (SELECT p_partkey AS unit, CASE p_partkey % 5 WHEN 0 THEN 'corpus_gap' WHEN 1 THEN 'single_source_context' ELSE 'consensus' END AS kind FROM part),
unit_themes AS (SELECT p_partkey AS unit, p_size AS theme FROM part WHERE p_size <= 45),
unit_evidence AS (SELECT DISTINCT l_partkey AS unit, l_suppkey * 10 + l_linenumber % 3 AS evidence FROM lineitem WHERE l_linenumber <= 2 AND l_partkey % 10 <> 0 AND l_quantity > 35),
unit_gaps AS (SELECT p_partkey AS unit, 'gap ' || p_size AS gap FROM part WHERE p_partkey % 15 IN (0, 7) OR p_partkey % 20 = 10),
papers AS (SELECT DISTINCT l_suppkey * 10 + l_linenumber % 3 AS evidence, l_suppkey AS paper FROM lineitem),
themes AS (SELECT DISTINCT p_size AS theme FROM part),
placed AS (SELECT l_orderkey % 40 AS section, l_orderkey AS paragraph, CASE WHEN l_orderkey % 97 = 3 THEN -l_partkey ELSE l_partkey END AS unit FROM lineitem WHERE l_quantity > 49)"""


def synthesis_tables(t: Tables) -> dict[str, DataFrame]:
    """Parts as units of a synthesis, with themes, evidence, gaps, and orders as paragraphs."""
    k, part = F.col("p_partkey"), F.col("l_partkey")
    evidence = (F.col("l_suppkey") * 10 + F.col("l_linenumber") % 3).alias("evidence")
    return {
        "units": t.part.select(k.alias("unit"), F.when(k % 5 == 0, "corpus_gap").when(k % 5 == 1, "single_source_context").otherwise("consensus").alias("kind")),
        "unit_themes": t.part.filter("p_size <= 45").select(k.alias("unit"), F.col("p_size").alias("theme")),
        "unit_evidence": t.lineitem.filter("l_linenumber <= 2 AND l_partkey % 10 <> 0 AND l_quantity > 35").select(part.alias("unit"), evidence).distinct(),
        "unit_gaps": t.part.filter((k % 15).isin(0, 7) | (k % 20 == 10)).select(k.alias("unit"), F.concat(F.lit("gap "), F.col("p_size")).alias("gap")),
        "papers": t.lineitem.select(evidence, F.col("l_suppkey").alias("paper")).distinct(),
        "placed": t.lineitem.filter("l_quantity > 49").select((F.col("l_orderkey") % 40).alias("section"), F.col("l_orderkey").alias("paragraph"), F.when(F.col("l_orderkey") % 97 == 3, -part).otherwise(part).alias("unit")),
    }


@query(f"""WITH {PARTS}, allowed AS (SELECT DISTINCT a.unit, b.evidence FROM unit_themes a JOIN unit_themes c ON c.theme = a.theme JOIN unit_evidence b ON b.unit = c.unit WHERE c.unit % 3 > 0),
n AS (SELECT u.unit, kind, count(DISTINCT e.evidence) AS n_evidence, count(DISTINCT paper) AS n_papers, (SELECT count(*) FROM unit_gaps g WHERE g.unit = u.unit) AS n_gaps FROM units u LEFT JOIN unit_evidence e ON e.unit = u.unit LEFT JOIN papers USING (evidence) GROUP BY u.unit, kind)
SELECT unnest(list_filter([CASE WHEN kind = 'corpus_gap' AND n_evidence > 0 THEN 'gap_has_evidence' END, CASE WHEN kind = 'corpus_gap' AND n_gaps = 0 THEN 'gap_without_gaps' END, CASE WHEN kind <> 'corpus_gap' AND n_evidence = 0 THEN 'evidence_missing' END,
  CASE WHEN kind <> 'corpus_gap' AND n_gaps > 0 THEN 'gaps_of_no_gap' END, CASE WHEN kind = 'single_source_context' AND n_papers > 1 THEN 'several_papers' END], lambda x: x IS NOT NULL)) AS code, CAST(unit AS VARCHAR) AS item FROM n
UNION ALL SELECT DISTINCT 'evidence_outside_themes', CAST(unit AS VARCHAR) FROM unit_evidence ANTI JOIN allowed USING (unit, evidence)
UNION ALL SELECT DISTINCT 'unknown_unit', CAST(unit AS VARCHAR) FROM placed ANTI JOIN units USING (unit)
UNION ALL SELECT 'theme_without_unit', CAST(theme AS VARCHAR) FROM themes ANTI JOIN unit_themes USING (theme)
UNION ALL SELECT 'theme_without_section', CAST(theme AS VARCHAR) FROM themes WHERE theme NOT IN (SELECT theme FROM placed JOIN unit_themes USING (unit))""")
def q_outline_violations(t: Tables) -> DataFrame:
    x = synthesis_tables(t)
    theme_evidence = x["unit_themes"].filter("unit % 3 > 0").join(x["unit_evidence"], "unit").select("theme", "evidence").distinct()
    return sy.outline_violations(x["units"], x["unit_themes"], x["unit_evidence"], x["unit_gaps"], theme_evidence, x["papers"], t.part.select(F.col("p_size").alias("theme")).distinct(), x["placed"])


@query(f"""WITH {PARTS}, m AS (SELECT DISTINCT section, paragraph, unit, kind FROM placed JOIN units USING (unit)),
r AS (SELECT section, paragraph, count(*) AS n_units, CASE WHEN bool_and(kind = 'corpus_gap') THEN 'research_gap' WHEN bool_or(kind = 'corpus_gap') THEN 'evidence_gap_synthesis' ELSE 'evidence_synthesis' END AS role FROM m GROUP BY ALL),
e AS (SELECT section, paragraph, count(DISTINCT evidence) AS n_evidence, count(DISTINCT paper) AS n_papers FROM m JOIN unit_evidence USING (unit) LEFT JOIN papers USING (evidence) GROUP BY ALL),
g AS (SELECT section, paragraph, count(DISTINCT gap) AS n_gaps FROM m JOIN unit_gaps USING (unit) GROUP BY ALL)
SELECT section, paragraph, role, n_units, CASE WHEN role = 'research_gap' THEN 0 ELSE coalesce(n_evidence, 0) END AS n_evidence, CASE WHEN role = 'research_gap' THEN 0 ELSE coalesce(n_papers, 0) END AS n_papers, CASE WHEN role = 'evidence_synthesis' THEN 0 ELSE coalesce(n_gaps, 0) END AS n_gaps FROM r LEFT JOIN e USING (section, paragraph) LEFT JOIN g USING (section, paragraph)""")
def q_outline_derive(t: Tables) -> DataFrame:
    return outline_of(t)["paragraphs"]


def outline_of(t: Tables) -> dict[str, DataFrame]:
    x = synthesis_tables(t)
    gaps = t.part.select(F.concat(F.lit("gap "), F.col("p_size")).alias("gap"))
    return sy.outline_derive(x["units"], x["unit_themes"], x["unit_evidence"], x["unit_gaps"], x["papers"], gaps, x["unit_gaps"].filter("unit % 2 = 0").select("gap"), x["placed"])


@query(f"""WITH {PARTS}
SELECT 'theme' AS kind, CAST(section AS VARCHAR) AS id, CAST(theme AS VARCHAR) AS value FROM (SELECT DISTINCT section, theme FROM placed JOIN units USING (unit) JOIN unit_themes USING (unit))
UNION ALL SELECT 'unplaced', CAST(unit AS VARCHAR), NULL FROM units ANTI JOIN placed USING (unit)
UNION ALL SELECT DISTINCT 'unprioritized', 'gap ' || theme, NULL FROM themes WHERE 'gap ' || theme NOT IN (SELECT gap FROM unit_gaps WHERE unit % 2 = 0)""")
def q_outline_rest(t: Tables) -> DataFrame:
    """Themes of sections, units of no paragraph, and gaps that no direction takes up."""
    out, none = outline_of(t), F.lit(None).cast("string").alias("value")
    themes = out["sections"].select(F.lit("theme").alias("kind"), F.col("section").cast("string").alias("id"), F.col("theme").cast("string").alias("value"))
    unplaced = out["unplaced"].select(F.lit("unplaced").alias("kind"), F.col("unit").cast("string").alias("id"), none)
    return themes.unionByName(unplaced).unionByName(out["unprioritized"].select(F.lit("unprioritized").alias("kind"), F.col("gap").alias("id"), none))


@query("SELECT o_orderkey, o_custkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS is_key_point FROM orders")
def q_synth_projection(t: Tables) -> DataFrame:
    key = t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return au.project_synthesis(t.orders.select("o_orderkey", "o_custkey"), key, "o_custkey")


@query(f"""WITH {TREE}, l AS (SELECT node, parent, CASE WHEN node = 'root' THEN 0 WHEN node LIKE 'r%' THEN 1 ELSE 2 END AS level FROM tree), e AS (SELECT 'n' || (n_nationkey * 2) AS node, n_nationkey % 4 AS new_level FROM nation)
SELECT e.node, new_level, CASE WHEN l.node IS NULL THEN 'unknown_node' WHEN new_level <= p.level THEN 'not_below_parent' WHEN new_level >= (SELECT min(level) FROM l c WHERE c.parent = e.node) THEN 'not_above_children' END AS reason FROM e LEFT JOIN l ON e.node = l.node LEFT JOIN l p ON l.parent = p.node""")
def q_merge_edits(t: Tables) -> DataFrame:
    level = F.when(F.col("node") == "root", 0).when(F.col("node").startswith("r"), 1).otherwise(2)
    edits = t.nation.select(F.concat(F.lit("n"), (F.col("n_nationkey") * 2).cast("string")).alias("node"), (F.col("n_nationkey") % 4).alias("new_level"))
    return au.merge_edits(tree(t).withColumn("level", level), edits, "node", "parent", "level")
