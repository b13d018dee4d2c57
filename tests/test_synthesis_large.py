"""Outlines of syntheses whose units share few themes."""

import time

from pyspark.sql import functions as F

from litspark.operators import synthesis


def test_evidence_of_units_that_share_a_theme(spark):
    """Units times the evidence of their theme would be 900 million rows."""
    n = 30_000
    ids = spark.range(n).select(F.col("id").alias("unit"))
    evidence = ids.select("unit", (F.col("unit") * 2).alias("evidence"))
    none = spark.createDataFrame([], "unit long, gap string")
    extra = spark.createDataFrame([(7, -1), (8, 20)], "unit long, evidence long")
    units = ids.withColumn("kind", F.lit("consensus"))
    theme_evidence = evidence.select(F.lit(1).alias("theme"), "evidence")
    papers = evidence.select("evidence", F.col("unit").alias("paper"))
    themes = spark.createDataFrame([(1,), (2,)], "theme int")
    placed = spark.createDataFrame([(0, 0, 5)], "section int, paragraph int, unit long")
    began = time.time()
    got = synthesis.outline_violations(units, ids.withColumn("theme", F.lit(1)), evidence.unionByName(extra), none, theme_evidence, papers, themes, placed).collect()
    assert sorted(map(tuple, got)) == [("evidence_outside_themes", "7"), ("theme_without_section", "2"), ("theme_without_unit", "2")]
    assert time.time() - began < 45
