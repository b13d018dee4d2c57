"""Outlines of documents: doubtful sections, sums over all sections below one, and the notes a reviewer gets.

Nodes of a document are a forest: columns by, node, parent, at (place among siblings), role, level, title, confidence and
markers. Paths from the roots come from pointer doubling; sorted by the places on them they give the depth-first order,
in which a section and all below it are one interval, so that sums over it are differences of running sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.operators.trees import tree_paths, written

#: The confidence below which a section is doubtful, markers that make it so, and roles at the end.
DOUBTFUL, RISKS = 0.7, ["schema_conflict", "level_jump"]
BACK = ["references", "appendix", "acknowledgements"]


def flag_low_confidence(nodes: DataFrame, confidence: str = "confidence", markers: str = "markers", least: float = DOUBTFUL, risks: list[str] = RISKS) -> DataFrame:
    """nodes with ``low`` and ``evidence``: the markers, and low_confidence_threshold where the confidence is below ``least``."""
    given = F.coalesce(markers, F.array().cast("array<string>"))
    under = F.coalesce(F.col(confidence) < least, F.lit(False))
    risky = F.exists(given, lambda m: m.isin(risks))
    evidence = F.array_distinct(F.concat(given, F.when(under, F.array(F.lit("low_confidence_threshold"))).otherwise(F.array().cast("array<string>"))))
    return nodes.withColumns({"low": under | risky, "evidence": evidence})


def depth_first(nodes: DataFrame, by: str, sums: dict[str, Column]) -> DataFrame:
    """nodes with first and last, the interval of each node and all below it in depth-first order from 1, child_count,
    depth from 1, and for each of ``sums`` the sum of a number over that interval.

    Siblings go by ``at`` and node. Nodes on a cycle or below one have nulls.
    """
    up = nodes.select(by, F.col("node").alias("parent"), F.struct("at", F.col("node").alias("id")).alias("__up"))
    keyed = nodes.join(up, [by, "parent"], "left").withColumn("__me", F.struct("at", F.col("node").alias("id")))
    paths = tree_paths(keyed.select(by, "__me", "__up"), [by], "__me", "__up")
    paths = written(paths.select(by, F.col("__me.id").alias("node"), "path"), "ordered_paths")
    placed = nodes.join(paths, [by, "node"]).withColumn("__ok", F.col("path").isNotNull())
    order = Window.partitionBy(by, "__ok").orderBy("path")
    placed = placed.withColumn("first", F.when(F.col("__ok"), F.row_number().over(order)))
    running = Window.partitionBy(by).orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    numbers = {f"__s{i}": F.sum(F.when(F.col("__ok"), value.cast("long"))).over(running) for i, value in enumerate(sums.values())}
    placed = written(placed.withColumns({"depth": F.size("path")} | numbers), "placed")
    below = placed.filter("__ok").select(by, F.col("first").alias("__at"), F.posexplode("path").alias("__d", "a")).select(by, F.col("a.id").alias("node"), "__at")
    ends = below.groupBy(by, "node").agg(F.max("__at").alias("last"))
    children = nodes.filter("parent IS NOT NULL").groupBy(by, F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("child_count"))
    at_end = placed.select(by, F.col("first").alias("last"), *[F.col(f"__s{i}").alias(f"__e{i}") for i in range(len(sums))])
    out = placed.join(ends, [by, "node"], "left").join(at_end, [by, "last"], "left").join(children, [by, "node"], "left")
    values = [F.when(F.col("__ok"), F.col(f"__e{i}") - F.col(f"__s{i}") + value.cast("long")).alias(name) for i, (name, value) in enumerate(sums.items())]
    return out.select(*nodes.columns, "depth", "first", "last", F.coalesce("child_count", F.lit(0).cast("long")).alias("child_count"), *values)


def build_outline(nodes: DataFrame, by: str) -> DataFrame:
    """nodes in depth-first order with doubt, evidence, children, and the numbers of nodes and doubtful ones below each, itself included."""
    low = F.coalesce(F.col("low").cast("int"), F.lit(0))
    return depth_first(flag_low_confidence(nodes), by, {"n_nodes": F.lit(1), "n_low": low})


def outline_stats(outline: DataFrame, by: str) -> DataFrame:
    """Per document the numbers of nodes, body and doubtful nodes, the greatest level of the body, and nodes by role."""
    roles = outline.groupBy(by, "role").agg(F.count(F.lit(1)).alias("n"))
    counts = roles.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("role", F.lit("")).alias("role"), "n")))).alias("role_counts"))  # one entry a role
    body = F.col("role") == "body"
    out = outline.groupBy(by).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(body).alias("n_body"), F.count_if("low").alias("n_low"), F.coalesce(F.max(F.when(body, F.col("level"))), F.lit(1)).alias("max_depth"))
    return out.join(counts, by)


def review_notes(outline: DataFrame, by: str, most: int = 5) -> DataFrame:
    """(by, kind, place, node, under): what a reviewer of a document reads.

    body_section are the roots of role body, each with its first ``most`` children as subsection; front_matter and
    back_matter are the other roots by role; watchlist are all doubtful nodes. Places count from 1 in each list.
    """
    tops = outline.filter("parent IS NULL")
    kind = F.when(F.col("role") == "body", "body_section").when(F.col("role") == "front_matter", "front_matter").when(F.col("role").isin(BACK), "back_matter")
    none = F.lit(None).cast(outline.schema["node"].dataType)

    def listed(df: DataFrame, name: Column, keys: list[str], under: Column) -> DataFrame:
        df = df.withColumn("kind", name).filter("kind IS NOT NULL")
        place = F.row_number().over(Window.partitionBy(by, "kind", *keys).orderBy("first", "node"))
        return df.select(by, "kind", place.alias("place"), "node", under.alias("under"))

    sections = tops.filter("role = 'body'").select(by, F.col("node").alias("parent"))
    parts = [
        listed(tops, kind, [], none),
        listed(outline.join(sections, [by, "parent"], "left_semi"), F.lit("subsection"), ["parent"], F.col("parent")).filter(F.col("place") <= most),
        listed(outline.filter("low"), F.lit("watchlist"), [], none),
    ]
    return reduce(DataFrame.unionByName, parts)
