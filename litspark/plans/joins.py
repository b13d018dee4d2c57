"""Queries of the joins and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspark.operators import relations as rel
from litspark.plans.query import V_MD, Tables, query

SECTIONS = f"""WITH {V_MD}, hd AS (SELECT conv_id, line_number AS start_line, row_number() OVER (PARTITION BY conv_id ORDER BY line_number) AS section_id,
 coalesce(lead(line_number) OVER (PARTITION BY conv_id ORDER BY line_number) - 1, (SELECT max(line_number) FROM v_md x WHERE x.conv_id = v_md.conv_id)) AS end_line FROM v_md WHERE is_heading)"""


def sections(t: Tables) -> DataFrame:
    from litspark.operators.structure import close_spans

    md = t.v_md
    ends = md.groupBy("conv_id").agg(F.max("line_number").alias("doc_end"))
    heads = md.filter("is_heading").select("conv_id", F.col("line_number").alias("start_line")).join(ends, "conv_id")
    return close_spans(heads, "conv_id", "start_line", "doc_end").withColumn("section_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("start_line")))


@query("""WITH r AS (SELECT o_orderkey AS paper, o_orderkey % 2 AS gen FROM orders), c AS (SELECT l_orderkey AS paper, l_linenumber AS line, CASE WHEN l_quantity < 2 THEN 1 - l_orderkey % 2 ELSE l_orderkey % 2 END AS gen FROM lineitem),
stale AS (SELECT DISTINCT paper FROM c JOIN r USING (paper) WHERE c.gen IS DISTINCT FROM r.gen) SELECT c.paper, line, c.gen FROM c JOIN r USING (paper) WHERE paper NOT IN (SELECT paper FROM stale)""")
def q_rebuild_corpus(t: Tables) -> DataFrame:
    runs = t.orders.select(F.col("o_orderkey").alias("paper"), (F.col("o_orderkey") % 2).alias("gen"))
    own = F.col("l_orderkey") % 2
    cards = t.lineitem.select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("line"), F.when(F.col("l_quantity") < 2, 1 - own).otherwise(own).alias("gen"))
    return rel.rebuild_corpus(runs, cards, "paper", "gen")[0].select("paper", "line", "gen")


@query(f"{SECTIONS} SELECT v_md.conv_id, line_number, count(start_line) AS assignment_count FROM v_md LEFT JOIN hd ON v_md.conv_id = hd.conv_id AND line_number BETWEEN start_line + 1 AND end_line WHERE trim(text) <> '' GROUP BY v_md.conv_id, line_number")
def q_line_ledger(t: Tables) -> DataFrame:
    regions = sections(t).withColumn("start_line", F.col("start_line") + 1)
    return rel.cover_lines(t.v_md.filter(F.trim("text") != ""), regions, "conv_id", "line_number")


@query(f"""{SECTIONS}, cards AS (SELECT conv_id, line_number AS card, line_number AS s, line_number + 1 AS e FROM v_md WHERE NOT is_heading)
SELECT conv_id, card, CASE WHEN count(section_id) = 1 THEN min(section_id) END AS section_id FROM (SELECT c.conv_id, card, section_id FROM cards c LEFT JOIN hd ON c.conv_id = hd.conv_id AND s >= start_line AND e <= end_line) GROUP BY conv_id, card""")
def q_assign_sections(t: Tables) -> DataFrame:
    cards = t.v_md.filter("NOT is_heading").select("conv_id", F.col("line_number").alias("card"), F.col("line_number").alias("start_line"), (F.col("line_number") + 1).alias("end_line"))
    return rel.assign_sections(cards, sections(t), "conv_id", "card")


@query("""SELECT DISTINCT a.conv_id, a.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.role = 'assistant' AND a.turn <= b.turn + 1 AND a.turn + 1 >= b.turn""")
def q_span_overlap(t: Tables) -> DataFrame:
    spans = t.conversations.select("conv_id", "turn", "role", F.col("turn").alias("start_line"), (F.col("turn") + 1).alias("end_line"))
    return rel.overlapping(spans, spans.filter("role = 'assistant'"), "conv_id").select("conv_id", "turn").distinct()


@query("""WITH e AS (SELECT doc_id, count(*) n FROM documents GROUP BY 1), o AS (SELECT CASE WHEN doc_id % 10 = 0 THEN doc_id + 1000000 ELSE doc_id - doc_id % 7 END AS doc_id, count(*) n FROM labels GROUP BY 1)
SELECT * FROM (SELECT coalesce(e.doc_id, o.doc_id) AS doc_id, CASE WHEN o.n IS NULL THEN 'missing' WHEN e.n IS NULL THEN 'unknown' WHEN o.n > 1 THEN 'repeated' END AS code FROM e FULL JOIN o ON e.doc_id = o.doc_id) WHERE code IS NOT NULL""")
def q_coverage(t: Tables) -> DataFrame:
    seen = t.labels.select(F.when(F.col("doc_id") % 10 == 0, F.col("doc_id") + 1000000).otherwise(F.col("doc_id") - F.col("doc_id") % 7).alias("doc_id"))
    return rel.verify_coverage(t.documents.select("doc_id"), seen, "doc_id")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'unknown_quote' WHEN p_size % 5 <> l_linenumber % 5 THEN 'foreign_quote' ELSE 'ok' END AS status
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON l_partkey = p_partkey""")
def q_resolve_citations(t: Tables) -> DataFrame:
    quotes = t.part.filter("p_size > 5").select(F.col("p_partkey").alias("quote"), (F.col("p_size") % 5).alias("card"))
    citations = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("quote"), (F.col("l_linenumber") % 5).alias("card"))
    return rel.resolve_citations(citations, quotes, "quote", "card").select("l_orderkey", "l_linenumber", "status")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def q_verify_quotes(t: Tables) -> DataFrame:
    return rel.find_quotes(t.benchmark.select("item_id", F.col("text").alias("quote")), t.documents.select("doc_id", "text"), "quote", "text").select("item_id", "doc_id")


@query("""SELECT o_orderkey, coalesce(contains(c_name, right(CAST(o_custkey AS VARCHAR), 2)), false) AS verbatim FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def q_verbatim_by_key(t: Tables) -> DataFrame:
    evidence = t.orders.select("o_orderkey", F.col("o_custkey").alias("card"), F.right(F.col("o_custkey").cast("string"), F.lit(2)).alias("quote"))
    return rel.verify_quotes(evidence, t.customer.select(F.col("c_custkey").alias("card"), "c_name"), "card", "quote", "c_name").select("o_orderkey", "verbatim")


@query("""WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS b1, c_nationkey AS b2 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 7 <> 3),
r AS (SELECT k, b1, b2, CASE WHEN k % 11 = 4 THEN 2 ELSE 1 END AS n FROM f)
SELECT o_orderkey AS k, unnest(list_filter([CASE WHEN n IS NULL THEN {'code': 'not_frozen', 'field': NULL} END, CASE WHEN n > 1 THEN {'code': 'repeated', 'field': NULL} END, CASE WHEN n = 1 AND o_orderstatus IS DISTINCT FROM b1 THEN {'code': 'differs', 'field': 'status'} END,
 CASE WHEN n = 1 AND o_custkey % 25 IS DISTINCT FROM b2 THEN {'code': 'differs', 'field': 'nation'} END], lambda x: x IS NOT NULL), recursive := true) FROM orders LEFT JOIN r ON o_orderkey = k""")
def q_frozen_fields(t: Tables) -> DataFrame:
    stored = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 25).cast("int").alias("nation"))
    frozen = t.orders.filter("o_custkey % 7 <> 3").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("k"), F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("O").alias("status"), F.col("c_nationkey").alias("nation"))
    return rel.frozen_differences(stored, frozen.unionByName(frozen.filter("k % 11 = 4")), "k", ["status", "nation"])


@query("""WITH p AS (SELECT conv_id, turn, length(text) % 4 = 0 AS cited FROM conversations), q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM p)
SELECT a.conv_id, a.turn, bool_or(a.pos = b.pos) AS is_cited FROM q a JOIN q b ON a.conv_id = b.conv_id AND b.cited AND abs(a.pos - b.pos) <= 1 GROUP BY a.conv_id, a.turn""")
def q_neighbor_context(t: Tables) -> DataFrame:
    cards = t.conversations.select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("card"), (F.length("text") % 4 == 0).alias("cited"))
    return rel.neighbor_context(cards, cards.filter("cited"), "conv_id", "turn", "card").select("conv_id", "turn", "is_cited")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def q_dangling_refs(t: Tables) -> DataFrame:
    targets = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return rel.dangling_refs(t.orders.select("o_orderkey", "o_custkey"), targets, "o_custkey")


@query("""WITH p AS (SELECT DISTINCT doc_id + 500 AS doc_id FROM labels), k AS (SELECT count(*) AS n_pack, count(*) FILTER (doc_id IN (SELECT doc_id FROM documents)) AS n_hit FROM p)
SELECT n_pack, n_hit, n_pack - n_hit AS n_missing, n_hit / (SELECT count(*) FROM documents) AS hit_ratio FROM k""")
def q_pack_integrity(t: Tables) -> DataFrame:
    return rel.pack_integrity(t.labels.select((F.col("doc_id") + 500).alias("doc_id")), t.documents, "doc_id")


@query("""WITH r AS (SELECT o_orderkey AS run, o_custkey AS paper FROM orders WHERE o_orderpriority = '1-URGENT'), e AS (SELECT l_orderkey AS run, l_partkey AS unit FROM lineitem JOIN r ON l_orderkey = run)
SELECT 'repeated_evidence' AS code, CAST(unit AS VARCHAR) AS value FROM e GROUP BY unit HAVING count(*) > 1 UNION ALL SELECT 'two_runs', CAST(paper AS VARCHAR) FROM r GROUP BY paper HAVING count(*) > 1""")
def q_evidence_catalog(t: Tables) -> DataFrame:
    runs = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("paper"))
    return rel.evidence_catalog(runs, t.lineitem.select(F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("unit")), "run", "paper", "unit")[1]


@query("""WITH y AS (SELECT o_custkey AS c, year(o_orderdate) AS y, count(*) AS n, max(o_orderpriority) AS p FROM orders GROUP BY 1, 2), a AS (SELECT * FROM y WHERE y = 1995), b AS (SELECT * FROM y WHERE y = 1996)
SELECT c, unnest(list_filter([CASE WHEN an IS NULL THEN 'added' END, CASE WHEN bn IS NULL THEN 'removed' END, CASE WHEN an IS NOT NULL AND bn IS NOT NULL AND an <> bn THEN 'n' END, CASE WHEN an IS NOT NULL AND bn IS NOT NULL AND ap IS DISTINCT FROM bp THEN 'p' END], lambda x: x IS NOT NULL)) AS change
FROM (SELECT coalesce(a.c, b.c) AS c, a.n AS an, b.n AS bn, a.p AS ap, b.p AS bp FROM a FULL JOIN b ON a.c = b.c)""")
def q_compare_runs(t: Tables) -> DataFrame:
    by_year = t.orders.groupBy(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderpriority").alias("p"))
    return rel.compare_runs(by_year.filter("y = 1995"), by_year.filter("y = 1996"), "c", ["n", "p"])


@query("""WITH p AS (SELECT doc_id AS unit, doc_id % 50 AS anchor, CASE WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS decision FROM labels),
c AS (SELECT doc_id AS unit, CASE WHEN doc_id % 11 = 0 THEN doc_id % 50 + 1 ELSE doc_id % 50 END AS anchor FROM documents)
SELECT unit, outcome, CASE WHEN outcome = 'carried' THEN decision END AS decision FROM (SELECT c.unit, p.decision, CASE WHEN p.anchor IS NOT NULL AND p.anchor <> c.anchor THEN 'conflict' WHEN p.anchor IS NOT NULL THEN 'carried' WHEN c.anchor IN (SELECT anchor FROM p) THEN 'pending' ELSE 'new' END AS outcome
 FROM c LEFT JOIN p ON c.unit = p.unit)""")
def q_migrate_decisions(t: Tables) -> DataFrame:
    previous = t.labels.select(F.col("doc_id").alias("unit"), (F.col("doc_id") % 50).alias("anchor"), F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("decision"))
    anchor = F.col("doc_id") % 50
    current = t.documents.select(F.col("doc_id").alias("unit"), F.when(F.col("doc_id") % 11 == 0, anchor + 1).otherwise(anchor).alias("anchor"))
    return rel.migrate_decisions(previous, current, "unit", "anchor", "decision").select("unit", "outcome", "decision")


TREE = """tree AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'root', NULL)"""


def tree(t: Tables) -> DataFrame:
    n = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    r = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit("root").alias("parent"))
    root = t.region.agg(F.lit("root").alias("node"), F.max(F.lit(None).cast("string")).alias("parent"))
    return n.unionByName(r).unionByName(root)


@query(f"""WITH RECURSIVE {TREE}, cl AS (SELECT node, node AS anc, 0 AS d FROM tree UNION ALL SELECT cl.node, tree.parent, d + 1 FROM cl JOIN tree ON cl.anc = tree.node WHERE tree.parent IS NOT NULL),
u AS (SELECT DISTINCT s_suppkey % 20 AS unit, 'n' || s_nationkey AS node FROM supplier WHERE s_acctbal > 5000), k AS (SELECT unit, count(*) AS n FROM u GROUP BY unit),
m AS (SELECT unit, anc, count(*) AS c, sum(d) AS sd FROM u JOIN cl USING (node) GROUP BY unit, anc)
SELECT m.unit, arg_min(anc, sd * 1000 + CASE anc WHEN 'root' THEN 999 ELSE CAST(substr(anc, 2) AS INT) END) AS lca FROM m JOIN k ON m.unit = k.unit AND c = n GROUP BY m.unit""")
def q_section_lca(t: Tables) -> DataFrame:
    units = t.supplier.filter("s_acctbal > 5000").select((F.col("s_suppkey") % 20).alias("unit"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("node"))
    return rel.lowest_common(units, rel.ancestors(tree(t), "node", "parent", 2), "unit", "node")


@query("""WITH l AS (SELECT doc_id, i AS n, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)), p AS (SELECT *, len(string_split(line, '|')) AS width, row_number() OVER (PARTITION BY doc_id, len(string_split(line, '|')) ORDER BY n) AS k FROM l WHERE contains(line, '|'))
SELECT doc_id, n, width, last_value(CASE WHEN k % 2 = 1 THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id, width ORDER BY n ROWS UNBOUNDED PRECEDING) AS header FROM p""")
def q_table_asof(t: Tables) -> DataFrame:
    rows = t.v_line.filter(F.contains("text", F.lit("|"))).select("doc_id", F.col("line_number").alias("n"), F.size(F.split("text", r"\|")).alias("width"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "width").orderBy("n")))
    return rel.nearest_before(rows, ["doc_id", "width"], "n", F.col("k") % 2 == 1, F.col("n"), "header").select("doc_id", "n", "width", "header")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25) SELECT l_orderkey, l_linenumber FROM c WHERE EXISTS (SELECT 1 FROM c x WHERE x.l_orderkey = c.l_orderkey AND abs(x.l_linenumber - c.l_linenumber) = 1)""")
def q_ordinal_support(t: Tables) -> DataFrame:
    return rel.supported_ordinals(t.lineitem.filter("l_quantity > 25").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' WHEN a.k IS NULL THEN 'right' ELSE 'both' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 2000) b ON a.k = b.k""")
def q_set_ops(t: Tables) -> DataFrame:
    return rel.set_changes(t.orders.select(F.col("o_custkey").alias("k")), t.customer.filter("c_acctbal > 2000").select(F.col("c_custkey").alias("k")), "k")


@query("""WITH m AS (SELECT p_partkey AS ref, p_size AS new_id FROM part WHERE p_size < 10), x AS (SELECT l_orderkey AS owner, coalesce(new_id, l_partkey) AS id, min(l_linenumber) AS pos FROM lineitem LEFT JOIN m ON l_partkey = ref GROUP BY 1, 2)
SELECT owner, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos, id) AS ids FROM x GROUP BY owner""")
def q_remap_ids(t: Tables) -> DataFrame:
    refs = t.lineitem.select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("ref"), F.col("l_linenumber").alias("at"))
    mapping = t.part.filter("p_size < 10").select(F.col("p_partkey").alias("ref"), F.col("p_size").cast("bigint").alias("new_id"))
    return rel.remap_ids(refs, mapping, "owner", "ref", "at").select("owner", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
