"""Queries of outlines: the turns of a conversation as sections, two roots and a tree of parts below them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.operators import outlines
from litspark.plans.query import Tables, query

TREE = """nodes AS (SELECT conv_id, turn AS node, CASE WHEN turn IN (0, 3) THEN NULL ELSE turn // 2 END AS parent, (turn * 5) % 7 AS pos, CASE WHEN turn = 3 THEN CASE WHEN conv_id % 2 = 1 THEN 'references' ELSE 'front_matter' END WHEN turn IN (6, 7) THEN 'supporting' ELSE 'body' END AS role,
  length(coalesce(text, '')) % 10 < 7 OR role = 'system' OR coalesce(length(text) % 3 = 0, false) AS low, length(coalesce(text, '')) % 10 < 7 AS under, length(coalesce(text, '')) % 3 = 0 AS jump FROM conversations),
walk AS (SELECT conv_id, node, node AS top, 1 AS depth, [{'p': pos, 'n': node}] AS path FROM nodes WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM nodes x WHERE x.conv_id = nodes.conv_id AND x.node = nodes.parent)
  UNION ALL SELECT n.conv_id, n.node, w.top, w.depth + 1, list_append(w.path, {'p': n.pos, 'n': n.node}) FROM walk w JOIN nodes n ON n.conv_id = w.conv_id AND n.parent = w.node),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY path) AS first FROM walk),
pairs AS (SELECT r.conv_id, unnest(r.path).n AS a, r.node, r.first FROM ranked r),
o AS (SELECT n.conv_id, n.node, n.parent, n.role, n.low, n.under, n.jump, r.depth, r.first, max(p.first) AS last, count(*) AS n_nodes, count(*) FILTER (x.low) AS n_low, (SELECT count(*) FROM nodes c WHERE c.conv_id = n.conv_id AND c.parent = n.node) AS child_count
  FROM nodes n JOIN ranked r USING (conv_id, node) JOIN pairs p ON p.conv_id = n.conv_id AND p.a = n.node JOIN nodes x ON x.conv_id = p.conv_id AND x.node = p.node GROUP BY ALL)"""


def outline(t: Tables) -> DataFrame:
    turn, n = F.col("turn"), F.length(F.coalesce("text", F.lit("")))
    role = F.when(turn == 3, F.when(F.col("conv_id") % 2 == 1, "references").otherwise("front_matter")).when(turn.isin(6, 7), "supporting").otherwise("body")
    marks = F.array_compact(F.array(F.when(F.col("role") == "system", "level_jump"), F.when(n % 3 == 0, "schema_conflict"), F.lit("harmless")))
    nodes = t.conversations.select("conv_id", turn.alias("node"), F.when(~turn.isin(0, 3), F.floor(turn / 2)).alias("parent"), (turn * 5 % 7).alias("at"), role.alias("role"), (turn % 4).alias("level"), (n % 10 / 10 + 0.05).alias("confidence"), marks.alias("markers"))
    return outlines.build_outline(nodes, "conv_id")


@query(f"""WITH RECURSIVE {TREE} SELECT conv_id, node, low, CAST(depth AS INTEGER) AS depth, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, child_count, n_nodes, n_low FROM o""")
def q_low_conf(t: Tables) -> DataFrame:
    return outline(t).select("conv_id", "node", "low", "depth", "first", "last", "child_count", "n_nodes", "n_low")


@query(f"""WITH RECURSIVE {TREE}, tops AS (SELECT *, CASE role WHEN 'body' THEN 'body_section' WHEN 'front_matter' THEN 'front_matter' WHEN 'references' THEN 'back_matter' END AS kind FROM o WHERE parent IS NULL)
SELECT conv_id, kind, row_number() OVER (PARTITION BY conv_id, kind ORDER BY first) AS place, node, NULL::BIGINT AS under FROM tops WHERE kind IS NOT NULL
UNION ALL SELECT * FROM (SELECT o.conv_id, 'subsection' AS kind, row_number() OVER (PARTITION BY o.conv_id, o.parent ORDER BY o.first) AS place, o.node, o.parent FROM o JOIN tops ON tops.conv_id = o.conv_id AND tops.node = o.parent WHERE tops.role = 'body') WHERE place <= 5
UNION ALL SELECT conv_id, 'watchlist', row_number() OVER (PARTITION BY conv_id ORDER BY first), node, NULL FROM o WHERE low""")
def q_overview(t: Tables) -> DataFrame:
    return outlines.review_notes(outline(t), "conv_id")


@query("""SELECT conv_id, count(*) AS n_nodes, count(*) FILTER (turn NOT IN (3, 6, 7)) AS n_body, coalesce(max(turn % 4) FILTER (turn NOT IN (3, 6, 7)), 1) AS max_depth, count(*) FILTER (turn IN (6, 7)) AS n_supporting FROM conversations GROUP BY conv_id""")
def q_outline_stats(t: Tables) -> DataFrame:
    stats = outlines.outline_stats(outline(t), "conv_id")
    return stats.select("conv_id", "n_nodes", "n_body", "max_depth", F.coalesce(F.try_element_at("role_counts", F.lit("supporting")), F.lit(0)).alias("n_supporting"))
