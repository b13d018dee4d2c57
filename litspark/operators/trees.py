"""Forests and chains of references, followed by pointer doubling: as many joins as the height has binary digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspark.streaming.corpus import shared_path


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a written table of the shared folder, so that later steps neither repeat it nor carry its plan along."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tree_paths(nodes: DataFrame, by: list[str], node: str, parent: str) -> DataFrame:
    """(by, node, path, cyclic): path holds the nodes from the root to the node itself.

    A parent that isn't there makes a root. Nodes on a cycle, or below one, are cyclic and have a null path.
    """
    ids = nodes.select(*by, F.col(node).alias("far"), F.lit(True).alias("there"))
    df = nodes.select(*by, F.col(node).alias("node"), F.col(parent).alias("far")).join(ids, [*by, "far"], "left")
    df = df.select(*by, "node", F.array("node").alias("path"), F.when(F.col("there"), F.col("far")).alias("far"), F.lit(False).alias("cyclic"))
    df = written(df, "paths")
    while not df.filter("far IS NOT NULL").isEmpty():
        up = df.select(*by, F.col("node").alias("far"), F.col("path").alias("above"), F.col("far").alias("next"), F.col("cyclic").alias("lost"))
        df = df.join(up, [*by, "far"], "left").select(*by, "node", F.concat(F.coalesce("above", F.slice("path", 1, 0)), "path").alias("path"), "next", (F.col("cyclic") | F.coalesce("lost", F.lit(False))).alias("cyclic"))
        df = df.withColumn("cyclic", F.col("cyclic") | (F.size(F.array_distinct("path")) < F.size("path")) | F.coalesce(F.array_contains("path", F.col("next")), F.lit(False)))
        df = written(df.select(*by, "node", F.when(~F.col("cyclic"), F.col("path")).otherwise(F.array("node")).alias("path"), F.when(~F.col("cyclic"), F.col("next")).alias("far"), "cyclic"), "paths")
    return df.select(*by, F.col("node").alias(node), F.when(~F.col("cyclic"), F.col("path")).alias("path"), "cyclic")


def descendants(paths: DataFrame, by: list[str], node: str) -> DataFrame:
    """(by, ancestor, node, distance) of all pairs on the paths, a node being its own ancestor at distance 0."""
    pairs = paths.filter("path IS NOT NULL").select(*by, node, F.posexplode("path").alias("__at", "ancestor"), F.size("path").alias("__size"))
    return pairs.select(*by, "ancestor", node, (F.col("__size") - 1 - F.col("__at")).alias("distance"))


def chain_ends(links: DataFrame, start: str, to: str) -> DataFrame:
    """(start, end, hops) of a table that maps ids to others: where each chain ends, null on a cycle or before one.

    ``start`` is unique. Each round doubles the links that are followed, and a chain has at most as many as the table.
    """
    df = links.select(F.col(start).alias("start"), F.col(to).alias("end"), F.lit(1).cast("long").alias("hops"))
    df = written(df.withColumn("open", F.lit(True)), "chains")
    most, reach = df.count(), 1
    while reach <= 2 * most and not df.filter("open").isEmpty():
        on = df.select(F.col("start").alias("end"), F.col("end").alias("next"), F.col("hops").alias("more"), F.col("open").alias("still"))
        df = df.join(on, "end", "left").select("start", F.coalesce("next", "end").alias("end"), (F.col("hops") + F.coalesce("more", F.lit(0).cast("long"))).alias("hops"), (F.col("open") & F.coalesce("still", F.lit(False))).alias("open"))
        df, reach = written(df, "chains"), 2 * reach
    return df.select(F.col("start").alias(start), F.when(~F.col("open"), F.col("end")).alias("end"), F.when(~F.col("open"), F.col("hops")).alias("hops"))


def numbered_groups(df: DataFrame, by: list[str], keys: list[str], order: str, to: str) -> DataFrame:
    """(by, keys, to): groups numbered from 0 by their least ``order``; one row a group."""
    first = df.groupBy(*by, *keys).agg(F.min(order).alias("__first"))
    return first.withColumn(to, F.row_number().over(Window.partitionBy(*by).orderBy("__first", *keys)) - 1).drop("__first")
