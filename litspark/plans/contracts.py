"""Queries of the evidence contract: conversations as tables of their turns, with claims and citations that break rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.operators import contracts
from litspark.plans.query import Tables, query

#: Lines of a conversation's table: a header, a row for each turn, and from turn 4 on a second table after a blank line.
LINES = """turns AS (SELECT conv_id AS k, turn, length(coalesce(text, '')) AS n FROM conversations),
rows0 AS (SELECT k, turn // 4 AS scope, -1 AS pos, 'turn | characters' AS t, true AS head, NULL::BIGINT AS n FROM turns GROUP BY k, turn // 4 UNION ALL SELECT k, turn // 4, turn, 'T' || turn || ' | ' || n, false, n FROM turns),
rows AS (SELECT *, k || ':' || scope || ':' || pos AS quote_id, (k + 2 * scope + pos) % 5 <> 3 AS cited FROM rows0),
units AS (SELECT k, CASE k % 4 WHEN 0 THEN 'T0 最高' WHEN 1 THEN 'has ' || CASE WHEN k % 3 = 0 THEN 999999 ELSE (SELECT min(n) FROM turns x WHERE x.k = t.k) END || ' characters' WHEN 2 THEN 'nothing to count' ELSE '最低 of ' || (SELECT max(n) FROM turns x WHERE x.k = t.k) END AS claim FROM (SELECT DISTINCT k FROM turns) t)"""


def evidence_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """results, units, citations, quotes and materials."""
    k, scope, turn = F.col("conv_id"), F.col("scope"), F.col("turn")
    turns = t.conversations.select("conv_id", "turn", F.floor(turn / 4).alias("scope"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    heads = turns.select("conv_id", "scope").distinct().select("conv_id", "scope", F.lit(-1).cast("long").alias("pos"), F.lit("turn | characters").alias("t"))
    rows = heads.unionByName(turns.select("conv_id", "scope", turn.alias("pos"), F.concat(F.lit("T"), turn.cast("string"), F.lit(" | "), F.col("n").cast("string")).alias("t")))
    rows = rows.withColumn("quote_id", F.concat_ws(":", "conv_id", "scope", "pos"))
    line = F.struct("scope", "pos", "t", "quote_id")
    cards = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("rows"))  # the turns of one conversation
    gap = F.transform("rows", lambda x, i: F.concat(F.when((i > 0) & (x["pos"] == -1), "\n\n").when(i > 0, "\n").otherwise(""), x["t"]))
    cards = cards.withColumns({"parts": gap, "extract": F.array_join(gap, "")})
    ends = F.transform("parts", lambda _, i: F.aggregate(F.slice("parts", 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)))
    spans = F.transform(F.arrays_zip("rows", ends.alias("ends")), lambda x: F.struct(x["rows"]["quote_id"].alias("quote_id"), (x["ends"] - F.length(x["rows"]["t"])).alias("start_char"), x["ends"].alias("end_char"), x["rows"]["t"].alias("text")))
    quotes = cards.select(F.col("conv_id").alias("material"), F.explode(spans).alias("q")).select("material", "q.*")
    materials = cards.select(F.col("conv_id").alias("material"), F.lit("table").alias("kind"), "extract")
    least = turns.groupBy("conv_id").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    number = F.when(k % 3 == 0, 999999).otherwise(F.col("least")).cast("string")
    claim = F.when(k % 4 == 0, "T0 最高").when(k % 4 == 1, F.concat(F.lit("has "), number, F.lit(" characters"))).when(k % 4 == 2, "nothing to count").otherwise(F.concat(F.lit("最低 of "), F.col("most").cast("string")))
    units = least.select(k.alias("unit"), k.alias("material"), claim.alias("claim"))
    citations = rows.filter((k + 2 * scope + F.col("pos")) % 5 != 3).select(k.alias("unit"), "quote_id")
    citations = citations.unionByName(least.filter(k % 17 == 5).select(k.alias("unit"), F.lit("nowhere").alias("quote_id"))).unionByName(least.filter(k % 19 == 4).select(k.alias("unit"), F.concat((k - 1).cast("string"), F.lit(":0:-1")).alias("quote_id")))
    results = least.filter(k % 13 != 6).select(k.alias("material"), F.when(k % 7 == 1, "context").otherwise("evidence").alias("disposition"), F.when(k % 5 == 1, "context_only").otherwise("direct_evidence").alias("reason"))
    results = results.unionByName(results.filter("material % 11 = 3"))
    return results, units, citations, quotes, materials


@query(f"""WITH {LINES},
s AS (SELECT r.k, scope, count(*) FILTER (head) AS heads, count(*) FILTER (NOT head) AS data, count(*) FILTER (head AND cited) AS c_heads, count(*) FILTER (NOT head AND cited) AS c_data FROM rows r GROUP BY r.k, scope),
touched AS (SELECT * FROM s WHERE c_heads + c_data > 0),
rank_units AS (SELECT u.k, count(x.k) AS n, sum(heads + data - c_heads - c_data) AS short FROM units u LEFT JOIN touched x ON x.k = u.k AND x.data >= 2 WHERE u.k % 4 IN (0, 3) GROUP BY u.k),
number_units AS (SELECT u.k, count(x.k) AS n, sum(heads - c_heads) AS short FROM units u LEFT JOIN touched x ON x.k = u.k WHERE u.k % 4 IN (1, 3) GROUP BY u.k),
results AS (SELECT k, CASE WHEN k % 7 = 1 THEN 'context' ELSE 'evidence' END AS d, CASE WHEN k % 5 = 1 THEN 'context_only' ELSE 'direct_evidence' END AS r, unnest(CASE WHEN k % 11 = 3 THEN [1, 2] ELSE [1] END) AS copy FROM units WHERE k % 13 <> 6)
SELECT 'ranking_scope_unprovable' AS code, CAST(k AS VARCHAR) AS item, CAST(n AS VARCHAR) AS detail FROM rank_units WHERE n <> 1
UNION ALL SELECT 'ranking_scope_incomplete', CAST(k AS VARCHAR), CAST(CAST(short AS BIGINT) AS VARCHAR) FROM rank_units WHERE n = 1 AND short > 0
UNION ALL SELECT 'number_scope_unprovable', CAST(k AS VARCHAR), CAST(n AS VARCHAR) FROM number_units WHERE n <> 1
UNION ALL SELECT 'number_header_missing', CAST(k AS VARCHAR), CAST(CAST(short AS BIGINT) AS VARCHAR) FROM number_units WHERE n = 1 AND short > 0
UNION ALL SELECT 'number_not_in_quotes', CAST(u.k AS VARCHAR), regexp_extract(u.claim, '[0-9]+$|[0-9]{{2,}}') FROM units u WHERE u.k % 4 IN (1, 3) AND NOT EXISTS (SELECT 1 FROM rows r WHERE r.k = u.k AND r.cited AND CAST(r.n AS VARCHAR) = regexp_extract(u.claim, '[0-9]+$|[0-9]{{2,}}'))
UNION ALL SELECT 'unknown_quote', CAST(k AS VARCHAR), 'nowhere' FROM units WHERE k % 17 = 5
UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM rows r WHERE r.quote_id = (u.k - 1) || ':0:-1') THEN 'quote_of_other_material' ELSE 'unknown_quote' END, CAST(k AS VARCHAR), (k - 1) || ':0:-1' FROM units u WHERE k % 19 = 4
UNION ALL SELECT 'result_missing', CAST(k AS VARCHAR), NULL FROM units WHERE k % 13 = 6
UNION ALL SELECT 'result_repeated', CAST(k AS VARCHAR), '2' FROM units WHERE k % 13 <> 6 AND k % 11 = 3
UNION ALL SELECT 'reason_not_allowed', CAST(k AS VARCHAR), d || ':' || r FROM results WHERE (d = 'context') <> (r = 'context_only')""")
def q_validate_evidence(t: Tables) -> DataFrame:
    return contracts.validate_evidence(*evidence_tables(t))


@query(f"WITH {LINES} SELECT k AS material, scope, CASE WHEN head THEN 'header' ELSE 'data' END AS role, quote_id FROM rows")
def q_table_scopes(t: Tables) -> DataFrame:
    _, _, _, quotes, materials = evidence_tables(t)
    return contracts.scope_rows(materials, quotes)
