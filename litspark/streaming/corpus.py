"""Incremental corpora: the latest run of each paper, kept by a stream of run files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.operators.structure import latest_by


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a temporary one where none is set, as in local tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="litspark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


BUCKETS = 64


def latest_runs(runs: DataFrame, paper: str, order: list[str]) -> DataFrame:
    """Of each paper the last run by ``order``, whether it failed or not."""
    return latest_by(runs, paper, order)


def published(runs: DataFrame, failed: Column, paper: str, order: list[str]) -> DataFrame:
    """Batch twin of the stream: the last run of each paper; a last run that failed withdraws the paper."""
    return latest_runs(runs, paper, order).filter(~F.coalesce(failed, F.lit(False)))


def parts(spark: SparkSession, path: str, number: str, schema: T.StructType) -> DataFrame | None:
    """A table of the folders ``number``=n below path; None while there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop) or not any(f.getPath().getName().startswith(f"{number}=") for f in files.listStatus(hadoop)):
        return None
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(number, T.LongType())])).parquet(path)


def merged(spark: SparkSession, table: str, schema: T.StructType, paper: str, order: list[str], upto: int | None = None) -> DataFrame:
    """The last run of each paper from the newest base and the epochs after it, up to an epoch; older parts aren't read."""
    found, base, since = [], parts(spark, f"{table}/base", "version", schema), -1
    if base is not None:
        versions = base.select("version").distinct()  # by folder, no file is read
        since = (versions if upto is None else versions.filter(F.col("version") < upto)).agg(F.max("version")).first()[0]
        since = -1 if since is None else since
        found.append(base.filter(F.col("version") == since).drop("version"))
    if (epochs := parts(spark, f"{table}/runs", "epoch", schema)) is not None:
        new = epochs.filter(F.col("epoch") > since)
        found.append((new if upto is None else new.filter(F.col("epoch") <= upto)).drop("epoch"))
    if not found:
        return spark.createDataFrame([], schema)
    return latest_runs(found[0].unionByName(found[-1]) if len(found) > 1 else found[0], paper, order)


def update_corpus(spark: SparkSession, path: str, table: str, paper: str, order: list[str], compact_every: int = 10) -> None:
    """Take in the files of ``path`` that aren't in ``table`` yet.

    Every batch writes the latest run of each of its papers under its number, so a batch costs as much as it holds, one
    that is repeated after a failure overwrites what it wrote, and a new start goes on where the last one ended. Each
    ``compact_every`` batches the base and the epochs since are merged to a new base, dealt and sorted by paper, so that a read
    has at most as many epochs to merge; what an older read may still use is left alone.
    """
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream reads files of a folder or a pattern, not a single file's path
    stream = spark.readStream.schema(schema).parquet(pattern)

    def write(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        latest_runs(batch, paper, order).write.mode("overwrite").parquet(f"{table}/runs/epoch={epoch}")
        if epoch % compact_every == compact_every - 1:
            base = merged(session, table, schema, paper, order, epoch)
            base.repartition(BUCKETS, paper).sortWithinPartitions(paper).write.mode("overwrite").parquet(f"{table}/base/version={epoch}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{table}/log").trigger(availableNow=True).start()
    query.awaitTermination()


def read_corpus(spark: SparkSession, table: str, schema: T.StructType, failed: Column, paper: str, order: list[str]) -> DataFrame:
    """What is published: the latest runs, without papers whose last run failed; nothing before the first batch."""
    return merged(spark, table, schema, paper, order).filter(~F.coalesce(failed, F.lit(False)))
