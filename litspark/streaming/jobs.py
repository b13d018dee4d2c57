"""The ledger of jobs: which changes of state were legal, which results counted, and which jobs went silent."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The states that may follow a state; a job begins as queued.
LEGAL = {"queued": ["running", "failed"], "running": ["completed", "failed"]}
LEDGER = "job long, seq long, state string, problem string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"


class JobLedger(StatefulProcessor):
    """State of a shard of jobs: of each its last state and when it falls due, of running ones their papers, and one timer.

    State and timer are fetched and put once for a shard and batch, since each call leaves Python. A job falls due anew
    with each batch that has rows of it. When the timer fires, open jobs that are due are marked as interrupted, and the
    state of any job that is due is given up; the timer is then set for the next one.
    """

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "job long, state string, due long")
        self.papers = handle.getListState("papers", "job long, paper string")
        self.timer = handle.getValueState("timer", "at long")

    def keep(self, held: dict[int, tuple[str | None, int]], watermark: int) -> None:
        """Puts the states held, and the timer for the first of them that falls due."""
        self.last.put([(job, *x) for job, x in held.items()]) if held else self.last.clear()
        set_for = self.timer.get()
        due = max(min(x[1] for x in held.values()), watermark + 1) if held else None
        if set_for and set_for[0] != due:
            self.handle.deleteTimer(set_for[0])
        if due is None:
            self.timer.clear()
        elif not set_for or set_for[0] != due:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {job: (state, due) for job, state, due in self.last.get()}
        papers = set(self.papers.get())
        df = pd.concat(list(rows)).sort_values(["job", "seq"])
        watermark, known = timerValues.getCurrentWatermarkInMs(), set(papers)
        out, ended = [], set()
        for job, seq, new, paper in zip(*(df[c].tolist() for c in ("job", "seq", "state", "paper")), strict=True):
            state, due = held.get(job, (None, None))
            problem = None
            if isinstance(paper, str):
                problem = "not_running" if state != "running" else "duplicate_result" if (job, paper) in papers else None
                if problem is None:
                    papers.add((job, paper))
            elif new == "queued" if state is None else new in LEGAL.get(state, []):
                state = new
                if state not in LEGAL:
                    ended.add(job)  # a closed job takes no more results
            else:
                problem = "illegal"
            held[job] = (state, due)
            out.append((job, seq, state, problem))
        for job, at in df.groupby("job")["at"].max().items():
            held[int(job)] = (held[job][0], max(int(at.timestamp() * 1000) + self.wait, watermark + 1))
        self.keep(held, watermark)
        if any(p[0] in ended for p in known):
            self.papers.put(left) if (left := [p for p in papers if p[0] not in ended]) else self.papers.clear()
        elif more := [p for p in papers - known if p[0] not in ended]:
            self.papers.appendList(more)
        yield pd.DataFrame(out, columns=["job", "seq", "state", "problem"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = {job: (state, due) for job, state, due in self.last.get()}
        silent = {job: state for job, (state, due) in held.items() if due <= watermark}
        self.timer.clear()  # it has fired
        self.keep({job: x for job, x in held.items() if job not in silent}, watermark)
        before = list(self.papers.get())
        if len(left := [p for p in before if p[0] not in silent]) < len(before):
            self.papers.put(left) if left else self.papers.clear()
        open_ = [job for job, state in silent.items() if state in LEGAL]
        if open_:
            yield pd.DataFrame({"job": open_, "seq": None, "state": "failed", "problem": "interrupted"})

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB, which list states and timers need.

    Each partition opens a store and starts Python in each batch, so there are at most two for each core. A stream
    keeps the number of its first start.
    """
    before = {name: spark.conf.get(name) for name in (PROVIDER, PARTITIONS)}
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(PARTITIONS, min(int(before[PARTITIONS]), 2 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def job_states(events: DataFrame, idle: str = "1 hour", shards: int = 2048) -> DataFrame:
    """Streaming ledger of jobs: (job, seq, state, problem) for each event, keyed by ``shards`` groups of jobs.

    events: job, seq, at, state and paper. A row with a paper is the result of that paper. problem is null, ``illegal``
    for a change that isn't allowed, ``not_running`` or ``duplicate_result`` for a paper's result, or ``interrupted`` for
    an open job that stays silent for ``idle`` of event time, which fails it. Rows of a job in one batch are put in order
    of seq first. Start it inside of ``rocksdb``.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    timed = events.withWatermark("at", "0 seconds").withColumn("shard", F.pmod(F.xxhash64("job"), F.lit(shards)))
    return timed.groupBy("shard").transformWithStateInPandas(statefulProcessor=JobLedger(wait), outputStructType=LEDGER, outputMode="Append", timeMode="EventTime")


def take_in(spark: SparkSession, path: str, table: str, schema: str, idle: str = "1 hour") -> None:
    """Run the ledger over the files of ``path`` that it hasn't seen; a new start goes on from the state of the last one."""
    with rocksdb(spark):
        stream = job_states(spark.readStream.schema(schema).parquet(path), idle)
        made = stream.writeStream.format("parquet").outputMode("append").option("path", f"{table}/rows").option("checkpointLocation", f"{table}/log")
        made.trigger(availableNow=True).start().awaitTermination()


def read_ledger(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(f"{table}/rows")


def job_history(events: DataFrame, idle: str = "1 hour") -> DataFrame:
    """Batch twin of the ledger for jobs that nothing interrupts between their events.

    The first queued row queues a job, the first running row after it starts it, and the first failed row after the
    start of its wait, or completed row after it runs, closes it; all other changes are illegal.
    """
    change = F.col("paper").isNull()
    at = lambda state, after=None: F.min(F.when(change & (F.col("state") == state) & (F.lit(True) if after is None else F.col("seq") > F.col(after)), F.col("seq")))
    queued = events.join(events.groupBy("job").agg(at("queued").alias("q")), "job")
    marks = queued.groupBy("job", "q").agg(at("running", "q").alias("r0"), at("failed", "q").alias("f"))
    marks = marks.withColumn("r", F.when(F.col("f").isNull() | (F.col("r0") < F.col("f")), F.col("r0")))
    df = events.join(marks.select("job", "q", "r", "f"), "job")
    done = df.groupBy("job").agg(at("completed", "r").alias("c"))
    df = df.join(done, "job").withColumn("z", F.least("c", "f"))
    seq = F.col("seq")
    upto = lambda mark: F.coalesce(F.col(mark) <= seq, F.lit(False))
    state = F.when(upto("z"), F.when(F.col("z") == F.col("c"), "completed").otherwise("failed")).when(upto("r"), "running").when(upto("q"), "queued")
    legal = seq.eqNullSafe(F.col("q")) | seq.eqNullSafe(F.col("r")) | seq.eqNullSafe(F.col("z"))
    df = df.withColumns({"now": state, "legal": legal})
    firsts = df.filter(~change & (F.col("now") == "running")).groupBy("job", "paper").agg(F.min("seq").alias("first"))
    df = df.join(firsts, ["job", "paper"], "left")
    problem = F.when(change, F.when(~F.col("legal"), "illegal")).when(~F.coalesce(F.col("now") == "running", F.lit(False)), "not_running").when(seq > F.col("first"), "duplicate_result")
    rows = df.select("job", "seq", F.col("now").alias("state"), problem.alias("problem"))
    end = events.agg(F.max("at").alias("end"))
    last = df.groupBy("job").agg(F.max("at").alias("at"), F.max_by("now", "seq").alias("now")).crossJoin(F.broadcast(end))  # end is one row
    silent = last.filter(F.col("now").isin("queued", "running") & (F.col("at") + F.expr(f"INTERVAL {idle}") <= F.col("end")))
    return rows.unionByName(silent.select("job", F.lit(None).cast("long").alias("seq"), F.lit("failed").alias("state"), F.lit("interrupted").alias("problem")))
