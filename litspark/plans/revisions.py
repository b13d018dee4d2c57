"""Queries of revisions and automatic resolutions, over orders and parts and over labelled documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspark.operators import revisions as rv
from litspark.operators.trees import written
from litspark.plans.query import Tables, query


@query("""WITH u AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS unit FROM lineitem WHERE l_quantity > 48),
g AS (SELECT CAST(o_orderkey AS VARCHAR) AS unit, CASE WHEN o_custkey % 3 = 0 THEN 'redundant' WHEN o_custkey % 3 = 1 THEN 'excluded' ELSE 'used' END AS d, CASE WHEN o_custkey % 2 = 0 THEN 'duplicate_support' WHEN o_custkey % 3 = 2 THEN 'supports_claim' ELSE 'off_topic' END AS r, unnest(CASE WHEN o_orderkey % 9 = 5 THEN [1, 2] ELSE [1] END) AS copy FROM orders WHERE o_orderkey % 4 > 0),
x AS (SELECT CAST(o.o_orderkey AS VARCHAR) AS item, any_value(u.unit) IS NOT NULL AS used, count(g.unit) AS n, any_value(d) AS d, any_value(r) AS r FROM orders o LEFT JOIN u ON CAST(o.o_orderkey AS VARCHAR) = u.unit LEFT JOIN g ON CAST(o.o_orderkey AS VARCHAR) = g.unit GROUP BY o.o_orderkey)
SELECT item, CASE WHEN used AND n > 0 THEN 'classified_though_used' WHEN NOT used AND n = 0 THEN 'missing' WHEN NOT used AND n > 1 THEN 'repeated' WHEN NOT used AND n = 1 AND NOT ((d = 'redundant' AND r = 'duplicate_support') OR (d = 'excluded' AND r = 'off_topic') OR (d = 'used' AND r = 'supports_claim')) THEN 'reason_not_allowed' WHEN NOT used AND n = 1 AND d = 'used' THEN 'used_but_not_cited' END AS code FROM x WHERE code IS NOT NULL""")
def q_dispositions(t: Tables) -> DataFrame:
    unit, c = F.col("o_orderkey").cast("string").alias("unit"), F.col("o_custkey")
    disposition = F.when(c % 3 == 0, "redundant").when(c % 3 == 1, "excluded").otherwise("used")
    reason = F.when(c % 2 == 0, "duplicate_support").when(c % 3 == 2, "supports_claim").otherwise("off_topic")
    copies = F.explode(F.when(F.col("o_orderkey") % 9 == 5, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    given = t.orders.filter("o_orderkey % 4 > 0").select(unit, disposition.alias("disposition"), reason.alias("reason"), copies.alias("copy"))
    refs = t.lineitem.filter("l_quantity > 48").select(F.col("l_orderkey").cast("string").alias("unit"))
    return rv.finalize_dispositions(refs, t.orders.select(unit), given.drop("copy"))[1]


@query("""WITH st AS (SELECT l_orderkey AS k, l_orderkey % 50 = 0 AS single, list_sort(list_distinct(list(l_partkey || '.' || l_orderkey % 40))) AS units FROM lineitem GROUP BY l_orderkey),
rev AS (SELECT k FROM st WHERE k % 3 = 0 AND k % 7 <> 0 UNION ALL SELECT k FROM st WHERE k % 101 = 1),
n AS (SELECT st.*, k % 3 = 0 AS blocked, (SELECT count(*) FROM rev WHERE rev.k = st.k) AS n, CASE WHEN k % 4 = 3 THEN 'delete' ELSE 'replace' END AS action FROM st),
judged AS (SELECT *, list_filter([CASE WHEN single AND action = 'delete' THEN 'single_deleted' END, CASE WHEN action = 'replace' AND k % 11 <> 6 AND k % 5 = 2 THEN 'new_evidence' END, CASE WHEN action = 'replace' AND k % 11 = 6 THEN 'unchanged' END], lambda x: x IS NOT NULL) AS codes FROM n),
applied AS (SELECT *, blocked AND n = 1 AND len(codes) = 0 AS ok FROM judged),
before AS (SELECT DISTINCT unnest(units) AS unit FROM st),
after AS (SELECT DISTINCT unnest(CASE WHEN NOT ok THEN units WHEN action = 'replace' THEN units[1:1] ELSE [] END) AS unit FROM applied),
freed AS (SELECT unit FROM before EXCEPT SELECT unit FROM after),
released AS (SELECT DISTINCT l_partkey || '.' || l_orderkey % 40 AS unit, l_partkey % 8 = 0 AS fits FROM lineitem WHERE l_partkey % 3 <> 0 AND l_partkey % 4 = 0),
parts AS (SELECT p_partkey || '.x' AS unit, p_partkey AS p FROM part)
SELECT CASE WHEN n = 0 THEN 'missing' WHEN NOT blocked THEN 'unknown' ELSE 'repeated' END AS code, CAST(k AS VARCHAR) AS item FROM applied WHERE (blocked AND n <> 1) OR (NOT blocked AND n > 0)
UNION ALL SELECT unnest(codes), CAST(k AS VARCHAR) FROM applied WHERE blocked AND n = 1
UNION ALL SELECT 'released_missing', unit FROM freed ANTI JOIN released USING (unit)
UNION ALL SELECT 'released_unknown', unit FROM released ANTI JOIN freed USING (unit)
UNION ALL SELECT 'reason_not_allowed', unit FROM freed JOIN released USING (unit) WHERE NOT fits
UNION ALL SELECT 'missing', unit FROM parts WHERE p % 2 = 1""")
def q_apply_revision(t: Tables) -> DataFrame:
    k, part = F.col("k"), F.col("p_partkey")
    cites = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.concat_ws(".", "l_partkey", F.col("l_orderkey") % 40).alias("unit"))
    st = cites.groupBy("k").agg(F.array_sort(F.collect_set("unit")).alias("units"))
    name, place = k.cast("string"), F.floor(k / 10)
    st = st.select("k", name.alias("statement_id"), (k % 10).cast("string").alias("field"), place.alias("pos"), (k % 50 == 0).alias("single"), F.concat(F.lit("s"), name).alias("statement"), "units")
    st = written(st, "statements")  # else each use would group all lines again
    units = F.when(k % 11 == 6, F.col("units")).when(k % 5 == 2, F.array(F.get("units", F.lit(0)), F.lit("-1"))).otherwise(F.slice("units", 1, 1))
    text = F.concat(F.when(k % 11 == 6, "s").otherwise("new"), name)
    items = F.when(k % 4 != 3, F.array(F.struct(text.alias("statement"), units.alias("units"))))
    made = st.select("k", "statement_id", F.when(k % 4 == 3, "delete").otherwise("replace").alias("action"), items.alias("items"))
    revisions = made.filter("k % 3 = 0 AND k % 7 <> 0").unionByName(made.filter("k % 101 = 1")).drop("k")
    fits = F.col("p") % 8 == 0
    released = cites.filter("p % 3 <> 0 AND p % 4 = 0").select("unit", F.when(fits, "peripheral").otherwise("excluded").alias("disposition"), F.when(fits, "background_only").otherwise("duplicate_support").alias("reason")).distinct()
    cited = written(rv.references(st), "cited")
    uncited = t.part.select(F.concat(part.cast("string"), F.lit(".x")).alias("unit"), part)
    old = uncited.filter("p_partkey % 2 = 0").select("unit", F.lit("excluded").alias("disposition"), F.lit("off_topic").alias("reason"))
    old = old.unionByName(cited.select("unit", F.lit("used").alias("disposition"), F.lit("supports_claim").alias("reason")))
    parts = uncited.select("unit").unionByName(cited)
    return rv.apply_revision(st.drop("k"), st.filter("k % 3 = 0"), revisions, parts, old, released)[2]


@query("""WITH RECURSIVE l AS (SELECT doc_id AS d, row_number() OVER (ORDER BY doc_id) AS rn, max(doc_id) OVER () AS last FROM (SELECT DISTINCT doc_id FROM labels)),
e AS (SELECT d, rn, 'u' || rn AS unit, 'claim ' || rn AS claim, CASE WHEN rn % 6 = 0 THEN 'human_required' WHEN rn % 6 = 1 THEN 'keep_gate_override' WHEN rn % 6 IN (2, 3) THEN 'replace_with_supported_evidence' WHEN rn % 6 = 4 THEN 'repair_citations' END AS action,
  CASE WHEN rn % 6 IN (2, 3) THEN 'u' || (CASE WHEN rn % 60 = 3 THEN rn - 1 ELSE rn + 1 END) END AS replacement,
  'unit_' || left(sha256('anchor_' || left(sha256('g' || chr(31) || 'finding' || chr(31) || 'new' || rn), 24) || chr(31) || 'claim ' || rn), 24) AS repaired FROM l),
j AS (SELECT e.*, CASE action WHEN 'keep_gate_override' THEN rn % 4 = 1 WHEN 'replace_with_supported_evidence' THEN EXISTS (SELECT 1 FROM e x WHERE x.unit = e.replacement) ELSE action IS NOT NULL END AS good, CASE WHEN action = 'repair_citations' THEN repaired WHEN action = 'replace_with_supported_evidence' AND EXISTS (SELECT 1 FROM e x WHERE x.unit = e.replacement) THEN replacement END AS link FROM e),
walk AS (SELECT unit, link AS pos, 1 AS hops FROM j WHERE link IS NOT NULL UNION ALL SELECT w.unit, j.link, w.hops + 1 FROM walk w JOIN j ON j.unit = w.pos WHERE j.link IS NOT NULL AND w.hops < 8),
ends AS (SELECT unit, arg_max(pos, hops) AS result FROM walk GROUP BY unit HAVING max(hops) < 8),
loops AS (SELECT unit FROM walk GROUP BY unit HAVING max(hops) >= 8),
done AS (SELECT j.*, ends.result, good AND action <> 'human_required' AND j.unit NOT IN (SELECT unit FROM loops) AS applied FROM j LEFT JOIN ends ON ends.unit = j.unit WHERE action IS NOT NULL),
s AS (SELECT rn // 4 AS s, rn, unit FROM e),
dropped AS (SELECT DISTINCT s FROM s WHERE s % 5 = 0 AND s + 1 IN (SELECT s FROM s)),
mapped AS (SELECT s, coalesce(result, s.unit) AS id, min(rn) AS first FROM s LEFT JOIN ends ON ends.unit = s.unit WHERE s NOT IN (SELECT s FROM dropped) GROUP BY ALL),
units AS (SELECT CASE WHEN d.applied AND d.action = 'repair_citations' THEN d.link ELSE e.unit END AS unit, e.rn FROM e LEFT JOIN done d ON d.unit = e.unit WHERE NOT (coalesce(d.applied, false) AND coalesce(d.action, '') = 'replace_with_supported_evidence'))
SELECT 'evidence' AS kind, unit AS id, action || ':' || applied || ':' || CASE WHEN applied THEN coalesce(result, link, '') ELSE '' END AS value FROM done
UNION ALL SELECT 'statement', CAST(s AS VARCHAR), 'delete_misplaced:' || (s IN (SELECT s FROM dropped)) || ':' || CASE WHEN s IN (SELECT s FROM dropped) THEN CAST(s + 1 AS VARCHAR) ELSE '' END FROM (SELECT DISTINCT s FROM s WHERE s % 5 = 0)
UNION ALL SELECT 'units', CAST(s AS VARCHAR), string_agg(id, ',' ORDER BY first, id) FROM mapped GROUP BY s
UNION ALL SELECT 'disposition', unit, CASE WHEN unit IN (SELECT id FROM mapped) THEN 'used:supports_claim' WHEN rn % 7 = 0 THEN 'excluded:off_topic' ELSE 'redundant:duplicate_support' END FROM units
UNION ALL SELECT 'violation', unit, 'override_not_allowed' FROM done WHERE action = 'keep_gate_override' AND NOT good
UNION ALL SELECT 'violation', unit, 'replacement_missing' FROM done WHERE action = 'replace_with_supported_evidence' AND NOT good
UNION ALL SELECT 'violation', unit, 'mapping_cycle' FROM loops
UNION ALL SELECT 'violation', CAST(s AS VARCHAR), 'canonical_invalid' FROM (SELECT DISTINCT s FROM s WHERE s % 5 = 0) WHERE s NOT IN (SELECT s FROM dropped)""")
def q_auto_resolve(t: Tables) -> DataFrame:
    """Chains of two replacements and a repair, cycles of two, gates that may be overridden or not, and statements that are copies."""
    rn = F.col("rn")
    # labelled documents numbered in order; the table is small against documents, its ids are one column
    e = t.labels.select("doc_id").distinct().withColumn("rn", F.row_number().over(Window.orderBy("doc_id")))
    unit = F.concat(F.lit("u"), rn.cast("string"))
    e = e.select("rn", unit.alias("unit"), F.concat(F.lit("claim "), rn.cast("string")).alias("claim"), F.lit("g").alias("generation"), F.lit("finding").alias("kind"), F.lit("").alias("anchor_id"), F.array(F.lit("old")).alias("citations"))
    issues = e.filter("rn % 6 < 5").select("unit", F.lit("partially_supported").alias("verdict"), F.array(F.when(rn % 4 == 1, "wording").otherwise("增长 5%")).alias("fragments"))
    action = F.when(rn % 6 == 0, "human_required").when(rn % 6 == 1, "keep_gate_override").when(rn % 6 < 4, "replace_with_supported_evidence").otherwise("repair_citations")
    other = F.concat(F.lit("u"), F.when(rn % 60 == 3, rn - 1).otherwise(rn + 1).cast("string"))
    new = F.concat(F.lit("new"), rn.cast("string"))
    actions = e.filter("rn % 6 < 5").select("unit", action.alias("action"), F.when((rn % 6).isin(2, 3), other).alias("replacement"), F.array(new).alias("selected"))
    quotes = e.select("unit", new.alias("quote_id"))
    s = F.floor(rn / 4)
    statements = e.groupBy(s.alias("s")).agg(F.array_sort(F.collect_list(F.struct("rn", "unit"))).alias("x"))
    statements = statements.select(F.col("s").cast("string").alias("statement_id"), F.lit("results").alias("field"), F.col("s").alias("pos"), F.lit(False).alias("single"), F.lit("text").alias("statement"), F.transform("x", lambda x: x["unit"]).alias("units"), "s")
    wanted = statements.filter("s % 5 = 0").select("statement_id", F.lit("delete_misplaced").alias("action"), (F.col("s") + 1).cast("string").alias("canonical"))
    old = e.select("unit", F.when(rn % 7 == 0, "excluded").otherwise("used").alias("disposition"), F.when(rn % 7 == 0, "off_topic").otherwise("supports_claim").alias("reason"))
    out = rv.auto_resolve(e, issues, actions, quotes, statements.drop("s"), wanted, old)
    log = out["log"].select("kind", "id", F.concat_ws(":", "action", F.col("applied").cast("string"), F.coalesce("result", F.lit(""))).alias("value"))
    units = out["statements"].select(F.lit("units").alias("kind"), F.col("statement_id").alias("id"), F.array_join("units", ",").alias("value"))
    final = out["dispositions"].select(F.lit("disposition").alias("kind"), F.col("unit").alias("id"), F.concat_ws(":", "disposition", "reason").alias("value"))
    bad = out["violations"].select(F.lit("violation").alias("kind"), F.col("item").alias("id"), F.col("code").alias("value"))
    return reduce(DataFrame.unionByName, [log, units, final, bad])
