"""Queries of request plans over conversations, whose turns stand for the cards of a paper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.operators import planning
from litspark.plans.query import Tables, query

BUDGET = planning.Budget(window=900, base=100, margin=50, answer_base=30, answer_per_card=20, answer_most=130, cards_most=4)
FAILS = "({n} > 4 OR 30 + 20 * {n} > 130 OR {t} + 100 + 30 + 20 * {n} + 50 > 900)"


def fails(n: str, t: str) -> str:
    return FAILS.format(n=n, t=t)


CARDS = """c AS (SELECT conv_id, turn, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS t, CASE WHEN conv_id % 3 = 0 THEN 'z' WHEN turn % 4 = 0 THEN 'a' || (turn // 4) WHEN turn % 4 = 3 THEN 'c' || (turn // 2) ELSE 'b' || (turn // 2) END AS s FROM conversations)"""


def cards(t: Tables) -> DataFrame:
    """Turns as cards: a third of the conversations in one section of level 0, all others in sections of three levels."""
    quarter, half = F.floor(F.col("turn") / 4), F.floor(F.col("turn") / 2)
    name = lambda letter, number: F.concat(F.lit(letter), number.cast("string"))
    section = F.when(F.col("conv_id") % 3 == 0, "z").when(F.col("turn") % 4 == 0, name("a", quarter)).when(F.col("turn") % 4 == 3, name("c", half)).otherwise(name("b", half))
    return t.conversations.select("conv_id", "turn", F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).cast("long").alias("tokens"), section.alias("section"))


def sections(t: Tables) -> DataFrame:
    quarter, half = F.floor(F.col("turn") / 4).cast("string"), F.floor(F.col("turn") / 2).cast("string")
    each = [("z", F.lit(""), None, 0), ("a", quarter, None, 1), ("b", half, F.concat(F.lit("a"), quarter), 2), ("c", half, F.concat(F.lit("b"), half), 3)]
    rows = F.array(*[F.struct(F.concat(F.lit(x), n).alias("section"), (F.lit(None).cast("string") if p is None else p).alias("parent"), F.lit(level).alias("level")) for x, n, p, level in each])
    return t.conversations.select("conv_id", F.explode(rows).alias("x")).select("conv_id", "x.*").distinct()


@query(f"""WITH RECURSIVE {CARDS},
x AS (SELECT conv_id, turn, t, s, s AS u, 0 AS lvl FROM c WHERE s = 'z' UNION ALL SELECT conv_id, turn, t, s, 'a' || (turn // 4), 1 FROM c WHERE s <> 'z' UNION ALL SELECT conv_id, turn, t, s, 'b' || (turn // 2), 2 FROM c WHERE s[1] IN ('b', 'c') UNION ALL SELECT conv_id, turn, t, s, s, 3 FROM c WHERE s[1] = 'c'),
sums AS (SELECT conv_id, u, lvl, count(*) AS n, sum(t) AS t FROM x GROUP BY ALL),
modes AS (SELECT conv_id, u, lvl, CASE WHEN NOT {fails("n", "t")} THEN 'whole' WHEN lvl IN (0, 3) THEN 'packed' END AS mode FROM sums),
stops AS (SELECT x.conv_id, x.turn, arg_min(m.u, m.lvl) AS unit, arg_min(m.mode, m.lvl) AS mode FROM x JOIN modes m ON m.conv_id = x.conv_id AND m.u = x.u WHERE m.mode IS NOT NULL GROUP BY ALL),
own AS (SELECT conv_id, s, CASE WHEN {fails("count(*)", "sum(t)")} THEN 'direct_packed' ELSE 'direct' END AS mode FROM c GROUP BY ALL),
papers AS (SELECT conv_id FROM c GROUP BY conv_id HAVING NOT {fails("count(*)", "sum(t)")}),
placed AS (SELECT c.conv_id, c.turn, c.t, CASE WHEN p.conv_id IS NOT NULL THEN NULL ELSE coalesce(stops.unit, c.s) END AS unit, CASE WHEN p.conv_id IS NOT NULL THEN 'paper' ELSE coalesce(stops.mode, own.mode) END AS mode
  FROM c JOIN own USING (conv_id, s) LEFT JOIN stops ON stops.conv_id = c.conv_id AND stops.turn = c.turn LEFT JOIN papers p ON p.conv_id = c.conv_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, unit, mode ORDER BY turn) AS rn FROM placed),
fold AS (SELECT conv_id, turn, unit, mode, rn, 0 AS part, 1 AS n, t AS held FROM numbered WHERE rn = 1
  UNION ALL SELECT y.conv_id, y.turn, y.unit, y.mode, y.rn, f.part + CASE WHEN y.mode IN ('packed', 'direct_packed') AND {fails("(f.n + 1)", "(f.held + y.t)")} THEN 1 ELSE 0 END, CASE WHEN {fails("(f.n + 1)", "(f.held + y.t)")} THEN 1 ELSE f.n + 1 END, CASE WHEN {fails("(f.n + 1)", "(f.held + y.t)")} THEN y.t ELSE f.held + y.t END
  FROM fold f JOIN numbered y ON y.conv_id = f.conv_id AND y.unit IS NOT DISTINCT FROM f.unit AND y.mode = f.mode AND y.rn = f.rn + 1),
firsts AS (SELECT conv_id, unit, mode, part, min(turn) AS first FROM fold GROUP BY ALL),
batches AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first) - 1 AS batch FROM firsts)
SELECT f.conv_id, f.turn, CAST(b.batch AS INTEGER) AS batch, f.unit AS section, f.mode FROM fold f JOIN batches b ON b.conv_id = f.conv_id AND b.unit IS NOT DISTINCT FROM f.unit AND b.mode = f.mode AND b.part = f.part""")
def q_plan_batches(t: Tables) -> DataFrame:
    plan, _ = planning.plan_batches(cards(t), sections(t), BUDGET, "conv_id", "turn", "section", "turn", "tokens")
    return plan


@query(f"""WITH {CARDS},
p AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 0 ELSE turn // 2 END AS batch FROM c WHERE turn % 7 <> 6 UNION ALL SELECT conv_id, turn, turn // 2 FROM c WHERE turn % 6 = 5 UNION ALL SELECT conv_id, 99, 50 FROM c WHERE turn = 0 AND conv_id % 4 = 0),
times AS (SELECT conv_id, turn, count(*) AS n FROM p GROUP BY ALL),
single AS (SELECT coalesce(c.conv_id, x.conv_id) AS conv_id, CAST(coalesce(c.turn, x.turn) AS VARCHAR) AS item, CASE WHEN c.turn IS NULL THEN 'unknown_card' WHEN x.n IS NULL THEN 'not_planned' WHEN x.n > 1 THEN 'planned_repeatedly' END AS code FROM c FULL JOIN times x ON x.conv_id = c.conv_id AND x.turn = c.turn),
b AS (SELECT p.conv_id, batch, count(*) AS n, sum(t) AS t, min(c.turn) AS first, max(c.turn) AS last FROM p JOIN c ON c.conv_id = p.conv_id AND c.turn = p.turn GROUP BY ALL),
w AS (SELECT *, max(last) OVER (PARTITION BY conv_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY batch) - 1 AS number FROM b)
SELECT conv_id, item, code FROM single WHERE code IS NOT NULL
UNION ALL SELECT conv_id, CAST(batch AS VARCHAR), 'over_budget' FROM w WHERE n > 1 AND {fails("n", "t")}
UNION ALL SELECT conv_id, CAST(batch AS VARCHAR), 'out_of_order' FROM w WHERE before >= first
UNION ALL SELECT conv_id, CAST(batch AS VARCHAR), 'number_gap' FROM w WHERE batch <> number""")
def q_plan_audit(t: Tables) -> DataFrame:
    """A plan with cards left out, repeated, unknown and out of order."""
    c, turn = cards(t), F.col("turn")
    plan = c.filter(turn % 7 != 6).select("conv_id", "turn", F.when(turn % 5 == 4, 0).otherwise(F.floor(turn / 2)).alias("batch"))
    plan = plan.unionByName(c.filter(turn % 6 == 5).select("conv_id", "turn", F.floor(turn / 2).alias("batch")))
    plan = plan.unionByName(c.filter((turn == 0) & (F.col("conv_id") % 4 == 0)).select("conv_id", F.lit(99).cast("long").alias("turn"), F.lit(50).cast("long").alias("batch")))
    return planning.audit_plan(plan, c, BUDGET, "conv_id", "turn", "turn", "tokens")[0]


@query(f"""WITH {CARDS}, b AS (SELECT conv_id, turn // 3 AS batch, count(*) AS n, sum(t) AS t FROM c GROUP BY ALL) SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_cards, count(*) AS n_batches, CAST(sum(t) AS BIGINT) AS tokens, CAST(max(t) AS BIGINT) AS most_tokens FROM b GROUP BY conv_id""")
def q_plan_totals(t: Tables) -> DataFrame:
    c = cards(t)
    return planning.audit_plan(c.withColumn("batch", F.floor(F.col("turn") / 3)), c, BUDGET, "conv_id", "turn", "turn", "tokens")[1]
