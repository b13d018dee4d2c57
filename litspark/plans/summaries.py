"""Queries of the aggregates and top-k selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.operators import audits as au
from litspark.plans.query import Tables, query


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def q_count_by(t: Tables) -> DataFrame:
    return au.count_by(t.documents, "lang", "source")


FLAGS = "list_filter([CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN length(text) > 1600 THEN 'long' END, CASE WHEN contains(text, '@') THEN 'mail' END], lambda x: x IS NOT NULL)"


@query(f"SELECT flag, count(*) AS n FROM (SELECT unnest({FLAGS}) AS flag FROM documents) GROUP BY flag")
def q_flag_counts(t: Tables) -> DataFrame:
    has = lambda c: F.contains("text", F.lit(c))
    return au.flag_counts(t.documents, F.array_compact(F.array(F.when(has("|"), "table"), F.when(F.length("text") > 1600, "long"), F.when(has("@"), "mail"))))


@query("""WITH e AS (SELECT o_custkey AS k, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT c_custkey AS paper, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_cards, string_agg(s || '=' || n, ',' ORDER BY s) AS kinds FROM customer LEFT JOIN e ON c_custkey = k GROUP BY c_custkey""")
def q_paper_reports(t: Tables) -> DataFrame:
    papers = t.customer.select(F.col("c_custkey").alias("paper"))
    df = au.paper_reports(t.orders.select(F.col("o_custkey").alias("paper"), "o_orderstatus"), papers, "paper", "o_orderstatus")
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return df.select("paper", "n_cards", kinds.alias("kinds"))


@query("SELECT count(*) AS total, count(*) FILTER (o_custkey % 7 > 0) AS with_issues, count(*) FILTER (o_custkey % 7 = 0 AND o_orderstatus = 'F') AS publishable, count(*) FILTER (o_orderstatus <> 'F') AS failed FROM orders")
def q_corpus_summary(t: Tables) -> DataFrame:
    return au.corpus_summary(t.orders.withColumn("issues", F.col("o_custkey") % 7), "o_orderstatus", "issues", "F")


@query("""WITH e AS (SELECT user_id % 5 AS phase, event_type AS stage, value AS convert, CASE WHEN user_id % 5 <> 2 THEN event_id % 100 END AS parse FROM events),
f AS (SELECT phase, string_agg(name || '=' || n, ',' ORDER BY name) AS failures FROM (SELECT phase, CASE WHEN stage = 'purchase' THEN 'none' ELSE stage END AS name, count(*) AS n FROM e GROUP BY ALL) GROUP BY phase)
SELECT phase, count(*) AS executed, count(*) FILTER (stage = 'purchase') AS succeeded, round(count(*) FILTER (stage = 'purchase') / count(*), 3) AS success_rate, any_value(failures) AS failures, round(avg(convert), 3) AS convert_mean, round(avg(parse), 3) AS parse_mean FROM e JOIN f USING (phase) GROUP BY phase""")
def q_sample_stats(t: Tables) -> DataFrame:
    phase = F.col("user_id") % 5
    records = t.events.select(phase.alias("phase"), "event_type", F.col("value").alias("convert"), F.when(phase != 2, (F.col("event_id") % 100).cast("double")).alias("parse"))
    out = au.sample_stats(records, "phase", "event_type", ["convert", "parse"], "purchase")
    listed = F.array_join(F.transform(F.map_entries("failures"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return out.select("phase", "executed", "succeeded", "success_rate", listed.alias("failures"), F.try_element_at("mean_durations", F.lit("convert")).alias("convert_mean"), F.try_element_at("mean_durations", F.lit("parse")).alias("parse_mean"))


@query("""WITH r AS (SELECT event_type AS code, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events)
SELECT code, count(*) AS n, count(DISTINCT user_id) AS n_papers, string_agg(CASE WHEN k <= 3 THEN event_id || ':' || user_id END, ',' ORDER BY event_id) AS evidence, CASE code WHEN 'error' THEN 'high' WHEN 'view' THEN 'low' ELSE 'info' END AS severity FROM r GROUP BY code""")
def q_findings(t: Tables) -> DataFrame:
    rows = F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["event_id"], x["user_id"])), ",")
    return findings(t)[0].select("code", "n", "n_papers", rows.alias("evidence"), "severity")


def findings(t: Tables) -> tuple[DataFrame, DataFrame]:
    return au.build_findings(t.events.withColumnRenamed("event_type", "code"), "code", "user_id", "event_id", ["event_id", "user_id"], {"error": "high", "view": "low"})


@query("SELECT DISTINCT event_type AS code, user_id FROM events")
def q_finding_papers(t: Tables) -> DataFrame:
    return findings(t)[1]


@query("""SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_quantity > 45 THEN 'too_long' END, CASE WHEN l_discount > 0.08 THEN 'low_confidence' END, CASE WHEN l_returnflag = 'R' THEN 'withdrawn' END], lambda x: x IS NOT NULL)) AS code FROM lineitem) GROUP BY code""")
def q_derive_issues(t: Tables) -> DataFrame:
    checks = [("too_long", F.col("l_quantity") > 45), ("low_confidence", F.col("l_discount") > 0.08), ("withdrawn", F.col("l_returnflag") == "R")]
    return au.count_by(au.derive_issues(t.lineitem, "l_orderkey", checks), "code")


@query("""SELECT code, count(*) AS n, min(o_orderkey) AS first_id FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice > 200000 THEN 'expensive' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END, CASE WHEN o_custkey % 3 = 0 THEN 'third' END], lambda x: x IS NOT NULL)) AS code FROM orders) GROUP BY code""")
def q_patterns(t: Tables) -> DataFrame:
    return au.frequent_patterns(t.orders, "o_orderkey", [("expensive", F.col("o_totalprice") > 200000), ("open", F.col("o_orderstatus") == "O"), ("third", F.col("o_custkey") % 3 == 0)])


@query("""WITH e AS (SELECT user_id % 6 AS p, *, CASE WHEN user_id % 6 IN (1, 2, 3, 4) AND event_id % 5 > 0 OR user_id % 6 IN (0, 4) AND user_id % 12 < 6 AND user_id < 60 THEN 'summarized' ELSE event_type END AS stage, CASE WHEN user_id % 6 = 2 THEN event_id % 900 ELSE user_id % 3 END AS kind FROM events WHERE user_id % 6 < 5),
x AS (SELECT *, CASE p WHEN 0 THEN 'preflight' WHEN 4 THEN 'preflight' ELSE 'pilot ' || p END AS phase FROM e),
f AS (SELECT phase, 'repeated_failure:' || stage || ':' || kind AS r, count(*) AS n, min(event_id) AS first, stage, kind FROM x WHERE stage <> 'summarized' GROUP BY phase, stage, kind HAVING count(*) >= 40),
g AS (SELECT phase, arg_min(r, (first, stage, kind)) AS r FROM f GROUP BY phase),
c AS (SELECT phase, count(*) AS n, count(*) FILTER (stage = 'summarized') AS ok, count(*) FILTER (value > 1e9) AS c0, count(*) FILTER (value > 50) AS c1 FROM x GROUP BY phase)
SELECT c.phase, CASE WHEN c.phase = 'preflight' THEN CASE WHEN ok < n THEN 'preflight_failed' END WHEN ok / n < 0.75 THEN 'success_rate_below_threshold:' || printf('%.2f', ok / n) WHEN g.r IS NOT NULL THEN g.r WHEN c0 >= 40 THEN 'blocking_check:huge' WHEN c1 >= 40 THEN 'blocking_check:large' END AS reason FROM c LEFT JOIN g ON g.phase = c.phase""")
def q_stop_reason(t: Tables) -> DataFrame:
    u, p = F.col("user_id"), F.col("user_id") % 6
    good = (p.isin(1, 2, 3, 4) & (F.col("event_id") % 5 > 0)) | (p.isin(0, 4) & (u % 12 < 6) & (u < 60))
    phase = F.when(p.isin(0, 4), "preflight").otherwise(F.concat(F.lit("pilot "), p.cast("string")))
    records = t.events.filter(p < 5).select("event_id", "value", phase.alias("phase"), F.when(good, "summarized").otherwise(F.col("event_type")).alias("stage"), F.when(p == 2, F.col("event_id") % 900).otherwise(u % 3).alias("kind"))
    return au.stop_reason(records, "phase", "event_id", "stage", "kind", "summarized", [("huge", F.col("value") > 1e9), ("large", F.col("value") > 50)], repeats=40)


@query("""WITH k AS (SELECT p_partkey, lower(trim(regexp_replace(trim(p_name || '_' || (p_partkey % 3)), '_[0-9]+$', ''))) AS duplicate_key FROM part) SELECT p_partkey, duplicate_key, count(*) OVER (PARTITION BY duplicate_key) AS n_same, count(*) OVER (PARTITION BY duplicate_key) > 1 AS is_duplicate FROM k""")
def q_dup_names(t: Tables) -> DataFrame:
    name = F.concat_ws("_", "p_name", (F.col("p_partkey") % 3).cast("string"))
    return au.duplicate_names(t.part, name).select("p_partkey", "duplicate_key", "n_same", "is_duplicate")


@query("""SELECT doc_id, CASE WHEN n_chars * 1000 < 204800 THEN 'xs' WHEN n_chars * 1000 < 1048576 THEN 's' WHEN n_chars * 1000 < 5242880 THEN 'm' WHEN n_chars * 1000 < 15728640 THEN 'l' ELSE 'xl' END AS bucket,
 CASE WHEN regexp_matches(lower(text), 'there|schen') THEN 'thesis_like' WHEN regexp_matches(lower(text), 'eau|ment') THEN 'news_like' WHEN regexp_matches(lower(text), 'tion|und') THEN 'journal_like' WHEN n_chars * 1000 >= 15728640 THEN 'thesis_like' ELSE 'unknown' END AS category FROM documents""")
def q_inventory(t: Tables) -> DataFrame:
    size = F.col("n_chars") * 1000
    return t.documents.select("doc_id", au.bucket_size(size).alias("bucket"), au.guess_category(F.col("text"), size, ["there", "schen"], ["eau", "ment"], ["tion", "und"]).alias("category"))


@query("""WITH p AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY 1) SELECT count(n) AS assigned, count(*) FILTER (n IS NULL) AS unassigned, count(*) FILTER (n > 1) AS multi_theme, max(n) AS most_themes FROM part LEFT JOIN p ON p_partkey = l_partkey""")
def q_synthesis_coverage(t: Tables) -> DataFrame:
    assigned = t.lineitem.filter("l_quantity > 30").select(F.col("l_partkey").alias("unit"), "l_suppkey")
    return au.synthesis_coverage(assigned, t.part.select(F.col("p_partkey").alias("unit")), "unit", "l_suppkey")


@query("""SELECT l_partkey AS theme, count(DISTINCT l_suppkey) AS n_papers, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN 'single_source' ELSE min(CASE WHEN l_returnflag = 'A' THEN 'single_source' ELSE 'tension' END) END AS relation, count(DISTINCT l_suppkey) > 1 AND min(CASE WHEN l_returnflag = 'A' THEN 'single_source' ELSE 'tension' END) = 'single_source' AS violation FROM lineitem GROUP BY 1""")
def q_derive_relation(t: Tables) -> DataFrame:
    df = t.lineitem.select(F.col("l_partkey").alias("theme"), "l_suppkey", F.when(F.col("l_returnflag") == "A", "single_source").otherwise("tension").alias("label"))
    return au.derive_relation(df, "theme", "l_suppkey", "label")


@query("""WITH p AS (SELECT l_partkey AS unit, l_suppkey % 10 AS theme, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2), u AS (SELECT DISTINCT l_partkey AS unit FROM lineitem WHERE l_quantity < 3)
SELECT unit, 'too_many_themes' AS code FROM p GROUP BY unit HAVING count(*) > 4 UNION ALL SELECT DISTINCT unit, 'repeated_in_theme' FROM p WHERE n > 1 UNION ALL SELECT DISTINCT unit, 'assigned_and_unassigned' FROM p WHERE unit IN (SELECT unit FROM u) UNION ALL SELECT p_partkey, 'uncovered' FROM part WHERE p_partkey NOT IN (SELECT unit FROM p) AND p_partkey NOT IN (SELECT unit FROM u)""")
def q_theme_limits(t: Tables) -> DataFrame:
    unit = F.col("l_partkey").alias("unit")
    assigned = t.lineitem.filter("l_quantity > 40").select(unit, (F.col("l_suppkey") % 10).alias("theme"))
    return au.theme_limits(assigned, t.lineitem.filter("l_quantity < 3").select(unit), "unit", "theme", 4, t.part.select(F.col("p_partkey").alias("unit")))


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 0 ELSE event_id END) AS BIGINT) AS requests, CAST(sum(length(event_type)) AS BIGINT) AS tokens FROM events GROUP BY user_id")
def q_usage(t: Tables) -> DataFrame:
    df = t.events.select("user_id", F.when(F.col("event_type") != "click", F.col("event_id")).alias("requests"), F.length("event_type").alias("tokens"))
    return au.sum_usage(df, ["user_id"], ["requests", "tokens"])


@query("""WITH m AS (SELECT year(o_orderdate) AS y, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1), w AS (SELECT max(CASE WHEN y = 1995 THEN orders END) AS ol, max(CASE WHEN y = 1996 THEN orders END) AS r1, max(CASE WHEN y = 1995 THEN customers END) AS cl, max(CASE WHEN y = 1996 THEN customers END) AS r2 FROM m)
SELECT 'orders' AS metric, CAST(ol AS DOUBLE) AS "left", CAST(r1 AS DOUBLE) AS "right", CAST(r1 - ol AS DOUBLE) AS delta FROM w UNION ALL SELECT 'customers', cl, r2, r2 - cl FROM w""")
def q_metric_deltas(t: Tables) -> DataFrame:
    m = t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("o_custkey").alias("customers"))
    return au.metric_deltas(m, "y", 1995, 1996, ["orders", "customers"])


@query("SELECT CASE WHEN doc_id % 9 = 0 THEN 'unknown_unit' WHEN toxic = 1 THEN 'invalid' ELSE CASE WHEN quality = 1 THEN 'accept' ELSE 'reject' END END AS decision, count(*) AS n FROM labels GROUP BY 1")
def q_decision_counts(t: Tables) -> DataFrame:
    d = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "maybe").when(F.col("quality") == 1, "accept").otherwise("reject").alias("decision"))
    return au.decision_counts(d, t.labels.filter("doc_id % 9 <> 0"), "doc_id", ["accept", "reject"])


@query("""WITH x AS (SELECT doc_id, contains(text, '|') AS tab, regexp_matches(text, '[0-9]+ ?%') AS pct FROM documents) SELECT count(*) FILTER (tab) AS tables, count(*) FILTER (tab AND pct) AS with_percent, count(*) FILTER (tab AND NOT pct) AS rejected FROM x""")
def q_table_audit(t: Tables) -> DataFrame:
    tab, pct = F.contains("text", F.lit("|")), F.col("text").rlike("[0-9]+ ?%")
    return t.documents.agg(F.count_if(tab).alias("tables"), F.count_if(tab & pct).alias("with_percent"), F.count_if(tab & ~pct).alias("rejected"))


@query("""SELECT o_orderpriority AS code, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus <> 'F') AS failed, count(*) FILTER (o_orderstatus <> 'F' AND o_custkey % 2 = 0) AS newly_failed FROM orders GROUP BY 1""")
def q_replay_status(t: Tables) -> DataFrame:
    now, before = F.col("o_orderstatus") == "F", F.col("o_custkey") % 2 == 0
    return t.orders.groupBy(F.col("o_orderpriority").alias("code")).agg(F.count_if(now).alias("passed"), F.count_if(~now).alias("failed"), F.count_if(~now & before).alias("newly_failed"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 5")
def q_top_issues(t: Tables) -> DataFrame:
    return au.count_by(t.events, "event_type").orderBy(F.desc("n"), "event_type").limit(5)


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS w FROM part), r AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey) AS round FROM o WHERE w = 1)
SELECT p_partkey, p_brand, p_type, round FROM r ORDER BY round, p_brand, p_type LIMIT 40""")
def q_stratified(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", "p_brand", "p_type", "p_name", "p_size")
    return au.stratified_fill(df, ["p_brand", "p_type"], "p_name", "p_size", "p_partkey", 40).select("p_partkey", "p_brand", "p_type", "round")


@query()
def q_sample_rules(t: Tables) -> DataFrame:
    """One part for each rule in turn; the choice among a few ranked candidates is greedy."""
    rules = [("largest", F.lit(True), [F.desc("p_size")]), ("smallest", F.lit(True), [F.asc("p_size")]), ("first_brand", F.col("p_brand").endswith("1"), [F.desc("p_retailprice")])]
    chosen = au.sample_by_rules(t.part, rules, "p_partkey", 3)
    rule = F.lit(None).cast("string")
    for name, item in chosen:
        rule = F.when(F.col("p_partkey") == item, name).otherwise(rule)
    return t.part.withColumn("rule", rule).filter("rule IS NOT NULL").select("rule", "p_partkey")


@query("""WITH f AS (SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS k FROM orders GROUP BY 1) SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderkey IN (SELECT k FROM f) THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey LIMIT 20""")
def q_review_queue(t: Tables) -> DataFrame:
    return au.review_queue(t.orders, ["o_orderpriority"], "o_totalprice", "o_orderkey", 20).select("o_orderkey")


@query("""SELECT o_orderkey, place, place <= CASE o_orderpriority WHEN '1-URGENT' THEN 6 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 2 ELSE 0 END AS within FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS place FROM orders)""")
def q_class_caps(t: Tables) -> DataFrame:
    return au.cap_by_class(t.orders, "o_custkey", "o_orderpriority", "o_orderkey", {"1-URGENT": 6, "2-HIGH": 4, "3-MEDIUM": 2}).select("o_orderkey", "place", "within")


@query("""SELECT conv_id, turn, file, "order" FROM (SELECT conv_id, turn, 'paper-' || conv_id || '.csv' AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS "order" FROM conversations)""")
def q_review_export(t: Tables) -> DataFrame:
    from litspark.operators.structure import number_rows

    df = number_rows(t.conversations, "conv_id", ["turn"], "order")
    return df.select("conv_id", "turn", F.concat(F.lit("paper-"), F.col("conv_id").cast("string"), F.lit(".csv")).alias("file"), "order")
