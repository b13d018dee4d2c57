"""Queries of the run ledger and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.operators import audits as au
from litspark.operators import evidence as ev
from litspark.plans.query import V_RUN, Tables, query
from litspark.streaming import corpus, jobs

LEGAL = {"view": ["click", "view"], "click": ["purchase", "click", "view"], "purchase": ["view"]}
LEGAL_SQL = "(before = 'view' AND stage IN ('click', 'view')) OR (before = 'click' AND stage IN ('purchase', 'click', 'view')) OR (before = 'purchase' AND stage = 'view')"


@query(f"""WITH {V_RUN} SELECT run_id, CASE WHEN stage NOT IN ('purchase', 'click') THEN 'closed' WHEN stage = 'click' AND floor(cost) % 2 = 0 THEN 'inconsistent' ELSE 'open' END AS gate FROM v_run""")
def q_gate_status(t: Tables) -> DataFrame:
    runs = t.v_run.select("run_id", F.when(F.col("stage") == "click", "partial").otherwise(F.col("stage")).alias("status"), (F.floor("cost") % 2).alias("failures"))
    return au.gate_sources(runs, "status", ["purchase", "partial"], "failures").select("run_id", "gate")


@query(f"""WITH {V_RUN}, l AS (SELECT *, lag(stage) OVER (PARTITION BY paper_id ORDER BY run_id) AS before FROM v_run) SELECT run_id, before, stage FROM l WHERE before IS NOT NULL AND NOT ({LEGAL_SQL})""")
def q_job_transitions(t: Tables) -> DataFrame:
    return au.illegal_transitions(t.v_run, "paper_id", "run_id", "stage", LEGAL).select("run_id", "before", "stage")


@query(f"""WITH {V_RUN}, p AS (SELECT paper_id, CASE WHEN max(cost) < 20 THEN 'failed' ELSE 'included' END AS status FROM v_run GROUP BY 1), n AS (SELECT count(*) FILTER (status = 'included') AS included, count(*) FILTER (status = 'failed') AS failed FROM p)
SELECT *, CASE WHEN failed > 0 THEN 'stopped' WHEN included < 2 THEN 'too_few' ELSE 'go' END AS outcome FROM n""")
def q_pipeline_gate(t: Tables) -> DataFrame:
    papers = t.v_run.groupBy("paper_id").agg(F.when(F.max("cost") < 20, "failed").otherwise("included").alias("status"))
    return au.pipeline_gate(papers, "status")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'""")
def q_stream_corpus(t: Tables) -> DataFrame:
    """The latest run of each paper, kept up by a stream of event files; a paper whose last run is an error is withdrawn."""
    table, order = corpus.shared_path(t.spark, "corpus"), ["ts", "event_id"]
    corpus.update_corpus(t.spark, f"{t.sf_dir}/events.parquet", table, "user_id", order, compact_every=1)
    return corpus.read_corpus(t.spark, table, t.events.schema, F.col("event_type") == "error", "user_id", order).select("user_id", "event_id", "event_type")


@query("""WITH e AS (SELECT event_id // 8 AS job, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS s, CASE WHEN event_type = 'view' THEN event_id % 3 END AS paper FROM events),
q AS (SELECT *, min(seq) FILTER (s = 'queued') OVER w AS q FROM e WINDOW w AS (PARTITION BY job)),
r AS (SELECT *, min(seq) FILTER (s = 'running' AND seq > q) OVER w AS r0, min(seq) FILTER (s = 'failed' AND seq > q) OVER w AS f FROM q WINDOW w AS (PARTITION BY job)),
c AS (SELECT *, CASE WHEN f IS NULL OR r0 < f THEN r0 END AS r FROM r),
z AS (SELECT *, min(seq) FILTER (s = 'completed' AND seq > r) OVER (PARTITION BY job) AS c FROM c),
n AS (SELECT *, CASE WHEN seq >= least(c, f) THEN CASE WHEN least(c, f) = c THEN 'completed' ELSE 'failed' END WHEN seq >= r THEN 'running' WHEN seq >= q THEN 'queued' END AS state, coalesce(seq = q, false) OR coalesce(seq = r, false) OR coalesce(seq = least(c, f), false) AS legal FROM z),
p AS (SELECT *, min(seq) FILTER (state = 'running' AND paper IS NOT NULL) OVER (PARTITION BY job, paper) AS first FROM n)
SELECT job, seq, state, CASE WHEN paper IS NULL THEN CASE WHEN NOT legal THEN 'illegal' END WHEN state IS DISTINCT FROM 'running' THEN 'not_running' WHEN seq > first THEN 'duplicate_result' END AS problem FROM p
UNION ALL SELECT job, NULL, 'failed', 'interrupted' FROM (SELECT job, max(ts) AS at_, arg_max(coalesce(state, ''), seq) AS state FROM n GROUP BY job) WHERE state IN ('queued', 'running') AND at_ + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)""")
def q_job_ledger(t: Tables) -> DataFrame:
    """Events as changes and results of jobs of eight events, taken in by three starts of a stateful stream."""
    kind, i = F.col("event_type"), F.col("event_id")
    state = F.when(kind == "signup", "queued").when(kind == "click", "running").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("result")
    events = t.events.select(F.floor(i / 8).alias("job"), i.alias("seq"), F.col("ts").cast("timestamp").alias("at"), state.alias("state"), F.when(kind == "view", (i % 3).cast("string")).alias("paper"))
    schema = "job long, seq long, at timestamp, state string, paper string"
    path, table = corpus.shared_path(t.spark, "jobs"), corpus.shared_path(t.spark, "ledger")
    most = events.agg(F.max("seq")).first()[0] or 0
    for k in range(3):  # files come by time, as the watermark wants it
        events.filter((F.col("seq") * 3 >= most * k) & ((F.col("seq") * 3 < most * (k + 1)) | F.lit(k == 2))).write.mode("append").parquet(path)
        jobs.take_in(t.spark, path, table, schema, "1 day")
    return jobs.read_ledger(t.spark, table)


@query("""WITH RECURSIVE runs AS (SELECT r AS run, CASE WHEN r % 4 > 0 THEN r - 1 END AS parent FROM range(0, 10) t(r)),
up AS (SELECT run, run AS source, 0 AS distance FROM runs UNION ALL SELECT up.run, parent, distance + 1 FROM up JOIN runs ON runs.run = up.source WHERE parent IS NOT NULL),
q AS (SELECT doc_id, doc_id % 10 AS run, lang, sha256(text) AS hash FROM documents),
c AS (SELECT doc_id, run - doc_id // 10 % 3 AS source, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE hash END AS hash FROM q WHERE doc_id % 6 <> 5
  UNION ALL SELECT doc_id, run, lang, 'older' FROM q WHERE doc_id % 9 = 0),
m AS (SELECT q.doc_id, up.source, up.distance, list_filter([CASE WHEN c.lang IS DISTINCT FROM q.lang THEN 'lang' END, CASE WHEN c.hash IS DISTINCT FROM q.hash THEN 'hash' END], lambda x: x IS NOT NULL) AS stale FROM q JOIN up ON up.run = q.run JOIN c ON c.doc_id = q.doc_id AND c.source = up.source),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(stale) > 0, distance, source, stale) AS n FROM m)
SELECT q.doc_id, CASE WHEN b.doc_id IS NULL THEN 'miss' WHEN len(stale) > 0 THEN 'stale' ELSE 'hit' END AS status, source, CAST(distance AS INTEGER) AS distance, array_to_string(stale, ',') AS stale FROM q LEFT JOIN b ON b.doc_id = q.doc_id AND b.n = 1""")
def q_cache_split(t: Tables) -> DataFrame:
    """Requests of ten runs in chains; entries lie in the run itself, its parent or grandparent, some of which it doesn't descend from."""
    d = F.col("doc_id")
    q = t.documents.select("doc_id", d.alias("key"), (d % 10).alias("run"), "lang", F.sha2("text", 256).alias("hash"))
    runs = q.select("run").distinct().withColumn("parent", F.when(F.col("run") % 4 > 0, F.col("run") - 1))
    kept = q.filter(d % 6 != 5).select("key", (F.col("run") - F.floor(d / 10) % 3).alias("run"), F.when(d % 7 == 0, "xx").otherwise(F.col("lang")).alias("lang"), F.when(d % 4 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    cache = kept.unionByName(q.filter(d % 9 == 0).select("key", "run", "lang", F.lit("older").alias("hash")))
    return ev.split_cached(q, cache, runs, ["lang", "hash"]).select("doc_id", "status", "source", "distance", "stale")


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey - 1 END AS src, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'completed' END AS status FROM orders), f AS (SELECT src, count(*) AS n, bool_or(status = 'completed') AS ok FROM r WHERE src IS NOT NULL GROUP BY src)
SELECT id, coalesce(n, 0) AS n_corrections, coalesce(ok, false) AS resolved FROM r LEFT JOIN f ON r.id = f.src WHERE status = 'failed'""")
def q_correction_ledger(t: Tables) -> DataFrame:
    r = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 1, F.col("o_orderkey") - 1).alias("src"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"))
    return ev.correction_ledger(r, "id", "src", "status")


@query("""WITH w AS (SELECT o_orderkey + o_orderkey % 2 * 1000000 AS id FROM orders WHERE o_custkey % 5 = 0) SELECT w.id, CASE WHEN o_orderkey IS NULL THEN 'unknown' WHEN o_orderstatus = 'F' OR o_custkey % 2 = 0 THEN 'replay' ELSE 'skip' END AS status FROM w LEFT JOIN orders ON w.id = o_orderkey""")
def q_select_replay(t: Tables) -> DataFrame:
    wanted = t.orders.filter("o_custkey % 5 = 0").select((F.col("o_orderkey") + F.col("o_orderkey") % 2 * 1000000).alias("id"))
    batches = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("failed_now"), (F.col("o_custkey") % 2 == 0).alias("failed_before"))
    return ev.select_replay(batches, wanted, "id")


@query("""WITH c AS (SELECT o_custkey AS paper, sha256(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) || chr(31) || o_orderkey || chr(31) || o_orderstatus) AS h FROM orders)
SELECT paper, count(*) AS n_cards, sha256(string_agg(h, '' ORDER BY h)) AS snapshot FROM c GROUP BY paper""")
def q_snapshot(t: Tables) -> DataFrame:
    return au.snapshot(t.orders.withColumnRenamed("o_custkey", "paper"), "paper", "o_orderkey", ["o_orderkey", "o_orderstatus"])
