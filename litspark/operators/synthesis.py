"""Outlines of syntheses, derived from their units: types, roles of paragraphs, themes of sections, and what is left over.

All tables are long: units (unit, kind), unit_themes (unit, theme), unit_evidence (unit, evidence), unit_gaps (unit, gap),
theme_evidence (theme, evidence), papers (evidence, paper), themes (theme), gaps (gap), directions (gap), the gaps that a
direction of search takes up, and placed (section, paragraph, unit), the units of each paragraph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.operators.revisions import faults

GAP, SINGLE = "corpus_gap", "single_source_context"


def unit_types(units: DataFrame, unit_evidence: DataFrame, unit_gaps: DataFrame, papers: DataFrame) -> DataFrame:
    """(unit, kind, derived, n_evidence, n_papers, n_gaps): units on one paper are single_source_context, whatever was said."""
    met = unit_evidence.distinct().join(papers, "evidence", "left").groupBy("unit").agg(F.countDistinct("evidence").alias("n_evidence"), F.countDistinct("paper").alias("n_papers"))
    gaps = unit_gaps.groupBy("unit").agg(F.countDistinct("gap").alias("n_gaps"))
    df = units.join(met, "unit", "left").join(gaps, "unit", "left")
    df = df.select("unit", "kind", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_evidence", "n_papers", "n_gaps")])
    derived = F.when(F.col("kind") == GAP, GAP).when(F.col("n_papers") == 1, SINGLE).otherwise(F.col("kind"))
    return df.select("unit", "kind", derived.alias("derived"), "n_evidence", "n_papers", "n_gaps")


def outline_violations(units: DataFrame, unit_themes: DataFrame, unit_evidence: DataFrame, unit_gaps: DataFrame, theme_evidence: DataFrame, papers: DataFrame, themes: DataFrame, placed: DataFrame) -> DataFrame:
    """(code, item): units against their kind, evidence from outside of the unit's themes, unknown units, and themes that no unit or no section has."""
    types = unit_types(units, unit_evidence, unit_gaps, papers)
    gap = F.col("kind") == GAP
    by_kind = faults(types, "unit", [
        ("gap_has_evidence", gap & (F.col("n_evidence") > 0)), ("gap_without_gaps", gap & (F.col("n_gaps") == 0)), ("evidence_missing", ~gap & (F.col("n_evidence") == 0)),
        ("gaps_of_no_gap", ~gap & (F.col("n_gaps") > 0)), ("several_papers", (F.col("kind") == SINGLE) & (F.col("n_papers") > 1)),
    ])
    # a unit's own evidence is looked up by theme; what its themes allow is never listed, as it grows with units times evidence
    own = unit_evidence.distinct()
    allowed = own.join(unit_themes, "unit").join(theme_evidence.distinct(), ["theme", "evidence"], "left_semi").select("unit", "evidence").distinct()
    outside = own.join(allowed, ["unit", "evidence"], "left_anti").select("unit").distinct()
    unknown = placed.join(units.select("unit"), "unit", "left_anti").select("unit").distinct()
    no_unit = themes.join(unit_themes.join(units.select("unit"), "unit", "left_semi").select("theme").distinct(), "theme", "left_anti")
    no_section = themes.join(placed.join(unit_themes, "unit").select("theme").distinct(), "theme", "left_anti")
    each = [faults(df, key, [(code, F.lit(True))]) for df, key, code in ((outside, "unit", "evidence_outside_themes"), (unknown, "unit", "unknown_unit"), (no_unit, "theme", "theme_without_unit"), (no_section, "theme", "theme_without_section"))]
    return reduce(DataFrame.unionByName, [by_kind, *each])


def outline_derive(units: DataFrame, unit_themes: DataFrame, unit_evidence: DataFrame, unit_gaps: DataFrame, papers: DataFrame, gaps: DataFrame, directions: DataFrame, placed: DataFrame) -> dict[str, DataFrame]:
    """paragraphs, sections, unplaced and unprioritized.

    A paragraph all of whose units are gaps is a research_gap and has no evidence; one with some is an
    evidence_gap_synthesis, one with none an evidence_synthesis without gaps. Its evidence and gaps are the unions of
    those of its units, the themes of a section the union of those of all its paragraphs' units. Units of no paragraph and
    gaps that no direction takes up are left over, and kept.
    """
    met = placed.select("section", "paragraph", "unit").distinct().join(units.select("unit", "kind"), "unit")
    gap = F.col("kind") == GAP
    role = F.when(F.bool_and(gap), "research_gap").when(F.bool_or(gap), "evidence_gap_synthesis").otherwise("evidence_synthesis")
    roles = met.groupBy("section", "paragraph").agg(F.count(F.lit(1)).alias("n_units"), role.alias("role"))
    evidence = met.join(unit_evidence.distinct(), "unit").join(papers, "evidence", "left").groupBy("section", "paragraph")
    evidence = evidence.agg(F.countDistinct("evidence").alias("n_evidence"), F.countDistinct("paper").alias("n_papers"))
    open_gaps = met.join(unit_gaps.distinct(), "unit").groupBy("section", "paragraph").agg(F.countDistinct("gap").alias("n_gaps"))
    df = roles.join(evidence, ["section", "paragraph"], "left").join(open_gaps, ["section", "paragraph"], "left")
    count = lambda c, none: F.when(F.col("role") == none, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    paragraphs = df.select("section", "paragraph", "role", "n_units", count("n_evidence", "research_gap"), count("n_papers", "research_gap"), count("n_gaps", "evidence_synthesis"))
    return {
        "paragraphs": paragraphs,
        "sections": met.join(unit_themes, "unit").select("section", "theme").distinct(),
        "unplaced": units.select("unit").join(placed, "unit", "left_anti"),
        "unprioritized": gaps.select("gap").distinct().join(directions, "gap", "left_anti"),
    }
