"""Streams against their batch twins, over restarts."""

import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from litspark.streaming import corpus, jobs

EVENTS = "user_id long, ts timestamp, event_id long, event_type string, value double"
ORDER = ["ts", "event_id"]


def part(spark, low, high):
    return spark.range(low, high).selectExpr("id % 7 AS user_id", "timestamp_seconds(id * 31 % 50) AS ts", "id AS event_id", "if(id % 5 = 0, 'error', 'view') AS event_type", "1.0D AS value")


def test_corpus_over_restarts_and_compactions(spark, tmp_path):
    failed, path, table = F.col("event_type") == "error", str(tmp_path / "events.parquet"), str(tmp_path / "corpus")
    schema = part(spark, 0, 1).schema
    ids = lambda df: sorted(tuple(x) for x in df.select("user_id", "event_id").collect())
    assert corpus.read_corpus(spark, table, schema, failed, "user_id", ORDER).count() == 0
    for k in range(4):
        part(spark, 40 * k, 40 * k + 40).repartition(2).write.mode("append").parquet(path)
        for _ in range(1 + (k == 2)):  # a second start finds nothing new
            corpus.update_corpus(spark, path, table, "user_id", ORDER, compact_every=2)
        want = ids(corpus.published(part(spark, 0, 40 * k + 40), failed, "user_id", ORDER))
        assert ids(corpus.read_corpus(spark, table, schema, failed, "user_id", ORDER)) == want
    assert sorted(p.name for p in (tmp_path / "corpus/base").iterdir()) == ["version=1", "version=3"]
    plan = corpus.merged(spark, table, schema, "user_id", ORDER)._jdf.queryExecution().executedPlan().toString()
    assert "version#" in plan and "(epoch#" in plan  # folders are cut off by their numbers
    read = {f.split("/corpus/")[1].split("/part-")[0] for f in corpus.merged(spark, table, schema, "user_id", ORDER).inputFiles()}
    assert "base/version=3" in read


def test_failed_rerun_withdraws_a_paper(spark):
    df = spark.createDataFrame([(1, 1, 1, "view"), (1, 2, 2, "error"), (2, 1, 3, "error"), (2, 2, 4, "view")], "paper long, t long, run long, kind string")
    got = corpus.published(df, F.col("kind") == "error", "paper", ["t", "run"])
    assert [(x.paper, x.run) for x in got.collect()] == [(2, 4)]


def ledger(rows, idle, end):
    """The ledger by reading all rows of each job in order."""
    out, by = [], {}
    for job, seq, at, state, paper in rows:
        by.setdefault(job, []).append((seq, at, state, paper))
    for job, mine in by.items():
        last, papers = None, set()
        for seq, at, state, paper in sorted(mine):
            problem = None
            if paper is not None:
                problem = "not_running" if last != "running" else "duplicate_result" if paper in papers else None
                papers |= {paper} if problem is None else set()
            elif state == "queued" if last is None else state in jobs.LEGAL.get(last, []):
                last = state
            else:
                problem = "illegal"
            out.append((job, seq, last, problem))
        if last in ("queued", "running") and max(m[1] for m in mine) + idle <= end:
            out.append((job, None, "failed", "interrupted"))
    return sorted(out, key=str)


def test_jobs_over_three_starts(spark, tmp_path):
    r = random.Random(8)
    rows = []
    for seq in range(600):
        kind = r.choice(["queued", "running", "running", "completed", "failed", "result", "result"])
        rows.append((r.randrange(seq // 10, seq // 10 + 3), seq, 60 * seq + 1000, kind, r.choice("ab") if kind == "result" else None))
    schema = "job long, seq long, at timestamp, state string, paper string"
    frame = lambda part: spark.createDataFrame(part, schema.replace("timestamp", "long")).withColumn("at", F.timestamp_seconds("at"))
    path, table = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        frame(rows[200 * k : 200 * k + 200]).repartition(2).write.mode("append").parquet(path)
        jobs.take_in(spark, path, table, schema, "3 hours")
    want = ledger(rows, 3 * 3600, rows[-1][2])
    assert sorted(map(tuple, jobs.read_ledger(spark, table).collect()), key=str) == want
    assert sorted(map(tuple, jobs.job_history(frame(rows), "3 hours").collect()), key=str) == want
    assert {x[3] for x in want} == {None, "illegal", "not_running", "duplicate_result", "interrupted"}


def test_session_keeps_its_state_store(spark):
    before = spark.conf.get(jobs.PROVIDER)
    with jobs.rocksdb(spark):
        assert "RocksDB" in spark.conf.get(jobs.PROVIDER)
    assert spark.conf.get(jobs.PROVIDER) == before


class Cells:
    """A state variable that counts its calls, as each leaves Python."""

    def __init__(self, calls):
        self.calls, self.held = calls, []

    def get(self):
        self.calls.append("get")
        return self.held if isinstance(self.held, tuple) else iter(self.held)

    def put(self, values):
        self.calls.append("put")
        self.held = values

    def appendList(self, values):
        self.put([*self.held, *values])

    update = put

    def clear(self):
        self.put(type(self.held)())

    updateValue = exists = containsKey = None  # were called for each job and paper


class Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def getListState(self, *_):
        return Cells(self.calls)

    def getValueState(self, *_):
        cell = Cells(self.calls)
        cell.held = ()
        return cell

    getMapState = getListState

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("timer")
        self.timers.remove(at)


def test_calls_of_state_do_not_grow_with_jobs():
    """Each job had a dozen calls for each batch; a shard has as many, whatever number of jobs it has."""
    values = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    for n in (5, 500):
        ledger, handle = jobs.JobLedger(1000), Handle()
        ledger.init(handle)
        rows = [(j, 3 * j + k, pd.Timestamp(j + 10, unit="s"), s, p) for j in range(n) for k, (s, p) in enumerate([("queued", None), ("running", None), ("result", "a")])]
        frame = pd.DataFrame(rows, columns=["job", "seq", "at", "state", "paper"])
        out = pd.concat(ledger.handleInputRows((0,), iter([frame[:7], frame[7:]]), values))
        assert len(out) == 3 * n and out["problem"].isna().all() and handle.timers == {11000}
        fired = SimpleNamespace(getExpiryTimeInMs=lambda: 13000)
        handle.timers.clear()
        gone = pd.concat(ledger.handleExpiredTimer((0,), values, fired))
        assert gone["job"].tolist() == [0, 1, 2] and handle.timers == {14000} and len(handle.calls) < 20
        assert {p[0] for p in ledger.papers.held} == set(range(3, n))
