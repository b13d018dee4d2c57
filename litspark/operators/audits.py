"""Aggregates, audits of runs and samples, themes and outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the size buckets.
BUCKETS = [("xs", 200 * 1024), ("s", 1024**2), ("m", 5 * 1024**2), ("l", 15 * 1024**2)]


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def flag_counts(df: DataFrame, flags: Column) -> DataFrame:
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def paper_reports(cards: DataFrame, papers: DataFrame, key: str, kind: str) -> DataFrame:
    """Per paper its number of cards and their kinds with counts, papers without cards included."""
    each = cards.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"))
    held = each.groupBy(key).agg(F.sum("n").alias("n_cards"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("kinds"))
    return papers.select(key).join(held, key, "full_outer").withColumn("n_cards", F.coalesce("n_cards", F.lit(0)))


def corpus_summary(runs: DataFrame, status: str, issues: str, keep: str) -> DataFrame:
    """One row: totals by condition."""
    return runs.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(issues) > 0).alias("with_issues"), F.count_if((F.col(issues) == 0) & (F.col(status) == keep)).alias("publishable"), F.count_if(F.col(status) != keep).alias("failed"))


def sample_stats(records: DataFrame, phase: str, stage: str, durations: list[str], good: str) -> DataFrame:
    """Per phase: executed, succeeded, success rate, and as maps the failures by stage and the mean of each duration that has one; 3 digits."""
    ok = F.count_if(F.col(stage) == good)
    base = records.groupBy(phase).agg(F.count(F.lit(1)).alias("executed"), ok.alias("succeeded"), F.round(ok / F.count(F.lit(1)), 3).alias("success_rate"), *[F.round(F.avg(c), 3).alias(f"__{c}") for c in durations])
    means = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in durations]), F.array(*[F.col(f"__{c}") for c in durations])), lambda _, v: v.isNotNull())
    name = F.when(F.col(stage) == good, "none").otherwise(F.coalesce(F.col(stage), F.lit("unknown")))
    each = records.groupBy(phase, name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    failures = each.groupBy(phase).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("failures"))  # one entry a stage
    return base.withColumn("mean_durations", means).join(failures, phase).select(phase, "executed", "succeeded", "success_rate", "failures", "mean_durations")


def build_findings(issues: DataFrame, code: str, paper: str, order: str, evidence: list[str], severity: dict[str, str], n: int = 3, salts: int = 16) -> tuple[DataFrame, DataFrame]:
    """(findings, papers): per code its count, severity and first ``n`` rows as evidence; and the papers of each code, one row each.

    Evidence is picked in salted parts first, so no task gets all rows of a code; rows without a paper count too.
    """
    top = lambda d, *keys: d.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("__k") <= n)
    few = issues.select(code, order, F.struct(*evidence).alias("__row")).withColumn("__s", F.pmod(F.xxhash64(order), F.lit(salts)))
    few = top(top(few, code, "__s").drop("__k", "__s"), code)
    rows = few.groupBy(code).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "__row"))), lambda x: x["__row"]).alias("evidence"))  # n a code
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in severity.items() for x in p]), F.col(code)), F.lit("info"))
    counts = issues.groupBy(code).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(paper).alias("n_papers"))
    return counts.join(rows, code).withColumn("severity", level), issues.filter(F.col(paper).isNotNull()).select(code, paper).distinct()


def derive_issues(df: DataFrame, key: str, checks: list[tuple[str, Column]]) -> DataFrame:
    """(key, code) of each check whose condition holds."""
    return df.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in checks]))).alias("code"))


def frequent_patterns(df: DataFrame, key: str, patterns: list[tuple[str, Column]], n: int = 3) -> DataFrame:
    """Per pattern the number of rows and the first ids. Each row counts for a pattern once, by partial sums."""
    long = derive_issues(df, key, patterns)
    return long.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"))


def stop_reason(records: DataFrame, phase: str, order: str, stage: str, kind: str, good: str, checks: list[tuple[str, Column]], preflight: str = "preflight", least_rate: float = 0.75, repeats: int = 3) -> DataFrame:
    """(phase, reason): why a phase stops, null if it goes on.

    A preflight stops at any record that isn't good. Another phase stops if too few are good; else at the failure (stage
    and kind) that repeats and was seen first; else at the first of ``checks`` (code, whether a record blocks by it) that
    blocks as often.
    """
    bad = ~F.coalesce(F.col(stage) == good, F.lit(False))
    counts = records.groupBy(phase).agg(F.count(F.lit(1)).alias("__n"), F.count_if(~bad).alias("__ok"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"__c{i}") for i, (_, c) in enumerate(checks)])
    failures = records.filter(bad & F.col(kind).isNotNull()).groupBy(phase, stage, kind).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).filter(F.col("n") >= repeats)
    first = failures.groupBy(phase).agg(F.min_by(F.concat_ws(":", F.lit("repeated_failure"), stage, kind), F.struct("first", stage, kind)).alias("__repeated"))
    rate = F.col("__ok") / F.col("__n")
    blocking = F.coalesce(*[F.when(F.col(f"__c{i}") >= repeats, F.lit(f"blocking_check:{code}")) for i, (code, _) in enumerate(checks)], F.lit(None).cast("string"))
    low = F.when(rate < least_rate, F.concat(F.lit("success_rate_below_threshold:"), F.format_number(rate, 2)))
    reason = F.when(F.col(phase) == preflight, F.when(F.col("__ok") < F.col("__n"), "preflight_failed")).otherwise(F.coalesce(low, F.col("__repeated"), blocking))
    return counts.join(first, phase, "left").select(phase, reason.alias("reason"))


def bucket_size(size: Column) -> Column:
    out = F.lit("xl")
    for name, most in reversed(BUCKETS):
        out = F.when(size < most, F.lit(name)).otherwise(out)
    return out


def guess_category(name: Column, size: Column, thesis: list[str], news: list[str], journal: list[str]) -> Column:
    any_of = lambda terms: F.lower(name).rlike("|".join(terms))
    return F.when(any_of(thesis), "thesis_like").when(any_of(news), "news_like").when(any_of(journal), "journal_like").when(size >= 15 * 1024**2, "thesis_like").otherwise("unknown")


def duplicate_names(df: DataFrame, name: Column) -> DataFrame:
    """df with duplicate_key, the name without a copy suffix, and whether others share it."""
    key = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), r"_[0-9]+$", ""), r"(\([0-9]+\)|（[0-9]+）)$", "")))
    keyed = df.withColumn("duplicate_key", key)
    counts = keyed.groupBy("duplicate_key").agg(F.count(F.lit(1)).alias("n_same"))
    return keyed.join(counts, "duplicate_key").withColumn("is_duplicate", F.col("n_same") > 1)


def synthesis_coverage(assigned: DataFrame, items: DataFrame, key: str, theme: str) -> DataFrame:
    """One row: assigned, unassigned, in several themes, most themes of one."""
    per = assigned.groupBy(key).agg(F.countDistinct(theme).alias("n"))
    met = items.select(key).distinct().join(per, key, "left")
    return met.agg(F.count("n").alias("assigned"), F.count_if(F.col("n").isNull()).alias("unassigned"), F.count_if(F.col("n") > 1).alias("multi_theme"), F.max("n").alias("most_themes"))


def derive_relation(themes: DataFrame, theme: str, paper: str, label: str) -> DataFrame:
    """Per theme its relation: single_source with one paper, which several may not claim; else the given one."""
    df = themes.groupBy(theme).agg(F.countDistinct(paper).alias("n_papers"), F.min(label).alias("given"))
    relation = F.when(F.col("n_papers") == 1, "single_source").otherwise(F.col("given"))
    return df.select(theme, "n_papers", relation.alias("relation"), ((F.col("n_papers") > 1) & (F.col("given") == "single_source")).alias("violation"))


def theme_limits(assigned: DataFrame, unassigned: DataFrame, key: str, theme: str, most: int, items: DataFrame | None = None) -> DataFrame:
    """(key, code): in too many themes, twice in one, both assigned and unassigned, or of ``items`` and neither."""
    pairs = assigned.groupBy(key, theme).agg(F.count(F.lit(1)).alias("n"))
    many = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("t")).filter(F.col("t") > most).select(key, F.lit("too_many_themes").alias("code"))
    twice = pairs.filter("n > 1").select(key).distinct().withColumn("code", F.lit("repeated_in_theme"))
    both = assigned.select(key).distinct().join(unassigned.select(key).distinct(), key, "left_semi").withColumn("code", F.lit("assigned_and_unassigned"))
    out = many.unionByName(twice).unionByName(both)
    if items is None:
        return out
    seen = assigned.select(key).unionByName(unassigned.select(key)).distinct()
    return out.unionByName(items.select(key).distinct().join(seen, key, "left_anti").withColumn("code", F.lit("uncovered")))


def sum_usage(runs: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return runs.groupBy(*by).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in columns])


def metric_deltas(metrics: DataFrame, run: str, left, right, names: list[str]) -> DataFrame:
    """(metric, left, right, delta) of two runs."""
    value = lambda r, c: F.max(F.when(F.col(run) == r, F.col(c)))
    one = metrics.agg(*[value(r, c).alias(f"{c}_{s}") for c in names for r, s in ((left, "l"), (right, "r"))])
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"{c}_l").cast("double").alias("left"), F.col(f"{c}_r").cast("double").alias("right")) for c in names])
    return one.select(F.explode(rows).alias("m")).select("m.*", (F.col("m.right") - F.col("m.left")).alias("delta"))


def decision_counts(decisions: DataFrame, units: DataFrame, key: str, known: list[str]) -> DataFrame:
    """Decisions by kind, with invalid and unknown ones apart."""
    met = decisions.join(units.select(key).distinct().withColumn("__known", F.lit(True)), key, "left")
    kind = F.when(F.col("__known").isNull(), "unknown_unit").when(~F.col("decision").isin(known), "invalid").otherwise(F.col("decision"))
    return met.groupBy(kind.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


def stratified_fill(df: DataFrame, strata: list[str], key: str, size: str, item: str, n: int, salts: int = 16) -> DataFrame:
    """n items, round by round over the strata, larger first; of items that share a key only the largest takes part.

    No item beyond the n-th of a stratum can be chosen, so each stratum is cut to n rows in salted parts first.
    """
    rest = [c for c in df.columns if c != key]
    one = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(size), -F.col(item))).alias("__w")).select(key, *[F.col(f"__w.{c}").alias(c) for c in rest])
    nth = lambda d, *keys: d.withColumn("round", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(size), item))).filter(F.col("round") <= n)
    few = nth(one.withColumn("__s", F.pmod(F.xxhash64(item), F.lit(salts))), *strata, "__s").drop("round", "__s")
    return nth(few, *strata).orderBy("round", *strata).limit(n)


def sample_by_rules(df: DataFrame, rules: list[tuple[str, Column, list[Column]]], item: str, n: int) -> list[tuple[str, int]]:
    """Up to n items, one for each rule in turn, none twice; each rule ranks its candidates on Spark, n at most reach the driver."""
    chosen: list[tuple[str, int]] = []
    for name, condition, order in rules:
        rows = df.filter(condition).orderBy(*order, item).select(item).limit(n).collect()
        free = [r[0] for r in rows if r[0] not in {i for _, i in chosen}]
        if free and len(chosen) < n:
            chosen.append((name, free[0]))
    return chosen


def review_queue(df: DataFrame, groups: list[str], risk: str, item: str, n: int) -> DataFrame:
    """The riskiest row of each group, then the riskiest others, n in all."""
    first = df.groupBy(*groups).agg(F.max_by(item, F.struct(F.col(risk), -F.col(item))).alias(item)).select(item, F.lit(0).alias("turn"))
    others = df.join(first, item, "left_anti").select(item, F.lit(1).alias("turn"))
    return df.join(first.unionByName(others), item).orderBy("turn", F.desc(risk), item).limit(n)


def cap_by_class(df: DataFrame, by: str, cls: str, order: str, caps: dict[str, int]) -> DataFrame:
    """df with its place in the class, and whether it is within the class's cap."""
    place = F.row_number().over(Window.partitionBy(by, cls).orderBy(order))
    cap = F.try_element_at(F.create_map(*[F.lit(x) for p in caps.items() for x in p]), F.col(cls))
    return df.withColumns({"place": place, "within": place <= F.coalesce(cap, F.lit(0))})


def gate_sources(runs: DataFrame, status: str, accepted: list[str], failures: str) -> DataFrame:
    """runs with ``gate``: open, closed, or inconsistent where a partial status and the failures disagree."""
    gate = F.when(~F.col(status).isin(accepted), "closed").when((F.col(status) == "partial") & (F.col(failures) == 0), "inconsistent").otherwise("open")
    return runs.withColumn("gate", gate)


def pipeline_gate(papers: DataFrame, status: str, least: int = 2) -> DataFrame:
    """One row: included, failed and whether the pipeline goes on."""
    n = papers.agg(F.count_if(F.col(status) == "included").alias("included"), F.count_if(F.col(status) == "failed").alias("failed"))
    return n.withColumn("outcome", F.when(F.col("failed") > 0, "stopped").when(F.col("included") < least, "too_few").otherwise("go"))


def project_synthesis(evidence: DataFrame, key_points: DataFrame, unit: str) -> DataFrame:
    """evidence with ``is_key_point``."""
    return evidence.join(key_points.select(unit).distinct().withColumn("__key", F.lit(True)), unit, "left").withColumn("is_key_point", F.coalesce("__key", F.lit(False))).drop("__key")


def snapshot(cards: DataFrame, paper: str, order: str, fields: list[str]) -> DataFrame:
    """Per paper the number of cards and a hash over them in order; cards count by their own hashes, summed by place."""
    w = Window.partitionBy(paper).orderBy(order)
    place = F.row_number().over(w)
    each = cards.select(paper, F.sha2(F.concat_ws("\x1f", place.cast("string"), *[F.col(f).cast("string") for f in fields]), 256).alias("h"))
    return each.groupBy(paper).agg(F.count(F.lit(1)).alias("n_cards"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("snapshot"))


def illegal_transitions(events: DataFrame, by: str, order: str, state: str, legal: dict[str, list[str]]) -> DataFrame:
    """Rows whose state doesn't follow legally from the one before."""
    before = F.lag(state).over(Window.partitionBy(by).orderBy(order))
    ok = F.lit(False)
    for a, bs in legal.items():
        ok = ok | ((F.col("before") == a) & F.col(state).isin(bs))
    return events.withColumn("before", before).filter(F.col("before").isNotNull() & ~ok)


def merge_edits(nodes: DataFrame, edits: DataFrame, node: str, parent: str, level: str) -> DataFrame:
    """edits with ``reason``: null if a new level fits between parent and children as they were before all edits."""
    up = nodes.select(F.col(node).alias("__p"), F.col(level).alias("__pl"))
    down = nodes.groupBy(F.col(parent).alias("__c")).agg(F.min(level).alias("__cl"))
    met = edits.join(nodes.select(node, parent), node, "left").join(up, F.col(parent) == F.col("__p"), "left").join(down, F.col(node) == F.col("__c"), "left")
    known = nodes.select(node).distinct().withColumn("__known", F.lit(True))
    met = met.join(known, node, "left")
    reason = F.when(F.col("__known").isNull(), "unknown_node").when(F.col("new_level") <= F.col("__pl"), "not_below_parent").when(F.col("new_level") >= F.col("__cl"), "not_above_children")
    return met.select(node, "new_level", reason.alias("reason"))


def revisit_candidates(cards: DataFrame, selected: DataFrame, gaps: DataFrame, key: str, by: str) -> DataFrame:
    """Cards left out, of groups that have a gap."""
    return cards.join(selected.select(key), key, "left_anti").join(gaps.select(by).distinct(), by, "left_semi")


def brief_violations(points: DataFrame, evidence: DataFrame, unit: str) -> DataFrame:
    """(unit, code): key points that aren't the claim of their evidence, or refer to none."""
    met = points.join(evidence.select(unit, F.col("claim").alias("__claim")), unit, "left")
    code = F.when(F.col("__claim").isNull(), "unknown_evidence").when(F.col("__claim") != F.col("point"), "not_the_claim")
    return met.select(unit, code.alias("code")).filter("code IS NOT NULL")
