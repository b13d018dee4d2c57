"""Registration of queries, and the views that stand in for documents, lines, Markdown and runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


class Tables:
    """Tables of a folder by name: t.documents, t["part"]."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def v_line(self) -> DataFrame:
        """doc_id, line_number from 1, text."""
        return self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("line_number"), "text")

    @property
    def v_md(self) -> DataFrame:
        """Conversations as Markdown: conv_id, line_number, turn, is_heading, text."""
        lines = self.conversations.select("conv_id", "turn", F.posexplode(F.concat(F.array(F.concat_ws("", F.lit("## "), (F.col("turn") + 1).cast("string"), F.lit(". "), "role")), F.split(F.coalesce("text", F.lit("")), "\n"))).alias("p", "text"))
        number = F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn, p)")
        return lines.select("conv_id", "turn", number.alias("line_number"), (F.col("p") == 0).alias("is_heading"), "text")

    @property
    def v_run(self) -> DataFrame:
        """Events as a run ledger: run_id, paper_id, stage, cost, at."""
        return self.events.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("paper_id"), F.col("event_type").alias("stage"), F.col("value").alias("cost"), F.col("ts").alias("at"))


V_LINE = "v_line AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_number, unnest(string_split(text, chr(10))) AS text FROM documents)"
V_MD = """v_md0 AS (SELECT conv_id, turn, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS p, unnest(list_concat(['## ' || (turn + 1) || '. ' || role], string_split(coalesce(text, ''), chr(10)))) AS text FROM conversations),
v_md AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p) AS line_number, p = 0 AS is_heading, text FROM v_md0)"""
V_RUN = "v_run AS (SELECT event_id AS run_id, user_id AS paper_id, event_type AS stage, value AS cost, ts AS at FROM events)"


def query(sql: str | None = None):
    """Register a function of Tables under its name, with its SQL."""

    def put(f: Callable[[Tables], DataFrame]):
        FOUND[f.__name__] = (lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql)
        return f

    return put
