"""Evidence contracts, review gates, revisions and batches. Each check returns violations; each gate a decision per unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.functions.arrays import is_subset
from litspark.functions.text import stable_id


def evidence_violations(units: DataFrame, unit: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(unit, code) for each rule that a unit breaks; null conditions count as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules]))
    return units.select(unit, F.explode(broken).alias("code"))


def evidence_ids(evidence: DataFrame, generation: str, kind: str, citations: str, claim: str) -> DataFrame:
    """evidence with anchor (hash of generation, type and sorted citations) and unit (hash of anchor and claim)."""
    sources = F.array_join(F.array_sort(citations), "\x1e")
    df = evidence.withColumn("anchor_id", stable_id("anchor_", F.col(generation), F.col(kind), sources))
    return df.withColumn("unit_id", stable_id("unit_", F.col("anchor_id"), F.col(claim)))


def gate_decisions(first: DataFrame, confirm: DataFrame, overrides: DataFrame, verbatim: DataFrame, unit: str) -> DataFrame:
    """Six outcomes in a fixed order: first pass, verbatim, override, missing confirmation, disagreement, blocker."""
    c = confirm.select(unit, F.col("verdict").alias("__confirmed"))
    o = overrides.select(unit, F.lit(True).alias("__override"))
    v = verbatim.select(unit, F.lit(True).alias("__verbatim"))
    met = first.join(c, unit, "left").join(o, unit, "left").join(v, unit, "left")
    good = "directly_supported"
    decision = (
        F.when(F.col("verdict") == good, "passed_first_pass")
        .when(F.col("__verbatim"), "passed_quote_containment")
        .when(F.col("__override"), "accepted_human_override")
        .when(F.col("__confirmed").isNull(), "confirmation_missing")
        .when(F.col("__confirmed") == good, "gate_disagreement")
        .otherwise("confirmed_blocker")
    )
    effective = F.when(decision == "confirmed_blocker", F.col("__confirmed")).when(decision == "passed_quote_containment", good).otherwise(F.col("verdict"))
    return met.select(unit, decision.alias("decision"), effective.alias("effective"))


def confirmation_queue(first: DataFrame, verbatim: DataFrame, overrides: DataFrame, unit: str) -> DataFrame:
    """Units that need a second review."""
    df = first.filter("verdict <> 'directly_supported'")
    return df.join(verbatim.select(unit), unit, "left_anti").join(overrides.select(unit), unit, "left_anti")


def failure_class(decisions: DataFrame) -> DataFrame:
    """One row: the class of the stage's failure, disagreement before blocker before missing."""
    n = lambda d: F.count_if(F.col("decision") == d)
    kind = F.when(n("gate_disagreement") > 0, "disagreement").when(n("confirmed_blocker") > 0, "confirmed").when(n("confirmation_missing") > 0, "missing").otherwise("none")
    return decisions.agg(kind.alias("failure"), n("gate_disagreement").alias("n_disagreement"), n("confirmed_blocker").alias("n_blocker"), n("confirmation_missing").alias("n_missing"))


def gate_statements(statements: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Blocked statements and why: not supported, or inferred where direct support is required."""
    met = statements.join(reviews, key, "left")
    why = F.when(F.col("verdict").isNull(), "not_reviewed").when(F.col("verdict").isin("unsupported", "partial"), "not_supported").when((F.col("required") == "direct") & (F.col("verdict") == "inferred"), "must_be_direct")
    return met.select(key, why.alias("why")).filter("why IS NOT NULL")


def unit_statements(links: DataFrame, unit: str, statement: str) -> DataFrame:
    """Per unit its statements in order; links of one unit."""
    return links.groupBy(unit).agg(F.array_sort(F.collect_set(statement)).alias("statements"))


def semantic_issues(units: DataFrame, statements: DataFrame, links: DataFrame) -> DataFrame:
    """Long table of blocked units and statements: kind, id and number of related items."""
    per_unit = links.groupBy("unit").agg(F.countDistinct("statement").alias("n"))
    per_statement = links.groupBy("statement").agg(F.countDistinct("unit").alias("n"))
    u = units.join(per_unit, "unit", "left").select(F.lit("unit").alias("kind"), F.col("unit").alias("id"), F.coalesce("n", F.lit(0)).alias("n_related"))
    s = statements.join(per_statement, "statement", "left").select(F.lit("statement").alias("kind"), F.col("statement").alias("id"), F.coalesce("n", F.lit(0)).alias("n_related"))
    return u.unionByName(s)


def apply_correction(units: DataFrame, corrections: DataFrame, keys: list[str], longer: int = 16, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(units, violations) after keep, delete or replace, of which each unit has exactly one.

    A replacement has no number that the claim lacks, is hardly longer, has no hedge that neither claim nor quote has, and
    keeps at least half of the claim's characters in matching blocks. A replacement that holds the whole claim keeps all of
    them, and one that has too few of its characters anywhere keeps too few in blocks; only the rest is aligned, each
    pair once. Pairs without digits have no numbers to compare.
    """
    from litspark.functions.numeric import numeric_facts
    from litspark.functions.text import QUALIFIERS, char_overlap
    from litspark.operators.trees import written

    once = corrections.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first("action").alias("action"), F.first("replacement").alias("replacement"))
    met = units.join(once, keys, "left")
    replaces, new, claim = F.col("action") == "replace", F.coalesce("replacement", F.lit("")), F.coalesce("claim", F.lit(""))
    hedges = F.array(*[F.lit(q) for q in QUALIFIERS])
    added = F.exists(hedges, lambda q: F.contains(new, q) & ~F.contains(claim, q) & ~F.contains(F.coalesce("quote", F.lit("")), q))
    bad = (
        F.when(F.col("__n").isNull(), "missing")
        .when(F.col("__n") > 1, "repeated")
        .when(~F.coalesce(F.col("action").isin("keep", "delete", "replace"), F.lit(False)), "unknown_action")
        .when(replaces & (F.trim(new) == ""), "empty")
        .when(replaces & new.rlike("[0-9]") & ~is_subset(numeric_facts(new), numeric_facts(claim)), "new_numbers")
        .when(replaces & (F.length(new) > F.length(claim) + longer), "too_long")
        .when(replaces & added, "hedge_not_quoted")
    )
    shared = F.length(claim) - F.length(F.call_function("translate", claim, new, F.lit("")))
    sure = F.contains(new, claim) & (claim != "")
    left = F.col("code").isNull() & replaces
    judged = written(met.select(*keys, "action", "claim", "replacement", bad.alias("code")), "judged")
    judged = judged.withColumn("code", F.when(left & ~sure & (shared < least * F.length(claim)), "low_overlap").otherwise(F.col("code")))
    asked = judged.filter(left & ~sure).withColumns({"__claim": claim, "__new": new})
    pairs = written(asked.select("__claim", "__new").distinct(), "pairs")  # else the filter would be pushed below distinct
    low = pairs.filter(char_overlap(F.col("__claim"), F.col("__new")) < least).withColumn("__low", F.lit(True))
    aligned = asked.join(low, ["__claim", "__new"], "left").withColumn("code", F.when(F.col("__low"), "low_overlap"))
    met = judged.filter(~F.coalesce(left & ~sure, F.lit(False))).unionByName(aligned.select(judged.columns))
    met = written(met, "corrected")
    kept = met.filter("code IS NULL AND action IN ('keep', 'replace')").select(*keys, F.when(replaces, F.col("replacement")).otherwise(F.col("claim")).alias("claim"))
    return kept, met.filter("code IS NOT NULL").select(*keys, "code")


def fact_owner(facts: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(owners, delegated) of facts of tables that several units state.

    facts: unit, header, row, column, fact, row_label; a fact is the same where the first four parts after unit are. units:
    unit, claim. The owner is the unit whose claim ranks nothing, names the row, has the fewest facts to state, and is the
    least, in this order. delegated are the facts of all other units, with the owner that states them.
    """
    from litspark.operators.contracts import RANKING
    from litspark.operators.trees import written

    identity = ["header", "row", "column", "fact"]
    # parts of as many rows in any input, since Spark would join them by their packed size
    parts = max(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), facts.count() // 500_000)
    counted = facts.repartition(parts, "unit").withColumn("n_facts", F.count(F.lit(1)).over(Window.partitionBy("unit")))
    whole = counted.filter("header <> '' AND row <> '' AND column >= 0 AND fact <> ''")
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", "")
    claims = units.select("unit", F.col("claim").rlike(RANKING).cast("int").alias("__ranks"), plain("claim").alias("__claim"))
    unnamed = (~F.contains("__claim", plain("row_label"))).cast("int")
    # ranks, unnamed and n_facts as one number, least first: aggregates of numbers need no sort of all rows, as those of structs do
    rank = (2 * F.coalesce("__ranks", F.lit(-1)) + unnamed + 2).cast("long") * F.lit(1 << 48) + F.col("n_facts")
    met = whole.join(claims, "unit").select("unit", *identity, rank.alias("__rank"))
    met = written(met.groupBy("unit", *identity).agg(F.min("__rank").alias("__rank")), "stated")
    first = met.groupBy(*identity, "__rank").agg(F.min("unit").alias("unit"), F.count(F.lit(1)).alias("n"))
    owners = first.groupBy(*identity).agg(F.min_by("unit", "__rank").alias("owner"), F.sum("n").alias("n_units")).filter("n_units > 1")
    owners = written(owners, "owners")
    delegated = met.join(owners.drop("n_units"), identity).filter(F.col("unit") != F.col("owner")).select("unit", *identity, "owner")
    return owners, delegated


def match_labels(claims: DataFrame, labels: DataFrame, by: str, claim: str, label: str) -> DataFrame:
    """Per claim the longest label of its table that it contains, the last one by name among equals."""
    from litspark.operators.trees import written

    # labels meet a claim as one array, so that its text isn't repeated for each of them and sorted as a key
    tables = labels.groupBy(by).agg(F.collect_set(label).alias("__labels"))
    held = F.filter("__labels", lambda x: F.contains(F.col(claim), x))
    best = F.array_max(F.transform(held, lambda x: F.struct(F.length(x).alias("n"), x.alias("label"))))["label"]
    # written, since Spark may push the filter, which needs the claim, to the side of the labels
    return written(claims.join(tables, by).select(by, claim, best.alias("label")), "labels").filter("label IS NOT NULL").distinct()


def fixed_batches(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """rows with their batch: n rows each, inside of a group."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(place / n))


def replacement_candidates(blocked: DataFrame, supported: DataFrame, paper: str, unit: str, text: str, order: str, least: float = 0.35) -> DataFrame:
    """Supported units near a blocked one (same paper, next to each other) that resemble it by bigrams."""
    from litspark.functions.text import bigram_jaccard, bigrams

    b = blocked.select(paper, F.col(unit).alias("blocked"), F.explode(F.array(F.col(order) - 1, F.col(order) + 1)).alias("__at"), bigrams(F.col(text)).alias("__b"))
    s = supported.select(paper, F.col(unit).alias("candidate"), F.col(order).alias("__at"), bigrams(F.col(text)).alias("__s"))
    met = b.join(s, [paper, "__at"]).withColumn("similarity", bigram_jaccard(F.col("__b"), F.col("__s")))
    return met.filter(F.col("similarity") >= least).select("blocked", "candidate", F.round("similarity", 6).alias("similarity"))


def canonical_candidates(statements: DataFrame, statement: str, field: str, evidence: str) -> DataFrame:
    """Pairs of statements of different fields with the evidence they share, joined on the evidence."""
    a = statements.select(F.col(statement).alias("a"), F.col(field).alias("__fa"), evidence).distinct()
    b = statements.select(F.col(statement).alias("b"), F.col(field).alias("__fb"), evidence).distinct()
    met = a.join(b, evidence).filter("a < b AND __fa <> __fb")
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"), F.min(evidence).alias("first_shared"))


def split_cached(requests: DataFrame, cache: DataFrame, runs: DataFrame, identity: list[str]) -> DataFrame:
    """requests (run, key and identity) with status, source, distance and stale.

    runs: run, parent. A request is a hit if its own run or one that it descends from has an entry of its key with all
    parts of the identity equal, of which the nearest run is the source; stale if there are entries but none fits, with
    the parts in which the nearest one differs; else a miss. Runs that descend from themselves have no parents.
    """
    from litspark.operators.trees import descendants, tree_paths

    paths = tree_paths(runs.select("run", "parent"), [], "run", "parent").withColumn("path", F.coalesce("path", F.array("run")))
    up = descendants(paths, [], "run").select("run", F.col("ancestor").alias("source"), "distance")
    entries = cache.select(F.col("run").alias("source"), "key", *[F.col(f).alias(f"__{f}") for f in identity])
    asked = requests.select("run", "key", *identity).distinct()
    differs = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(f)) for f in identity]))
    met = asked.join(up, "run").join(entries, ["source", "key"]).withColumn("stale", differs)
    best = met.groupBy("run", "key", *identity).agg(F.min(F.struct((F.size("stale") > 0).alias("unfit"), "distance", "source", "stale")).alias("best"))
    same = [F.col(f"q.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("run", "key", *identity)]
    out = requests.alias("q").join(best.alias("b"), same, "left")
    status = F.when(F.col("best").isNull(), "miss").when(F.col("best.unfit"), "stale").otherwise("hit")
    return out.select("q.*", status.alias("status"), F.col("best.source").alias("source"), F.col("best.distance").alias("distance"), F.array_join("best.stale", ",").alias("stale"))


def correction_ledger(requests: DataFrame, key: str, source: str, status: str) -> DataFrame:
    """Failed requests and whether a request made to correct them completed."""
    fixes = requests.filter(F.col(source).isNotNull()).groupBy(F.col(source).alias(key)).agg(F.count(F.lit(1)).alias("n_corrections"), F.bool_or(F.col(status) == "completed").alias("resolved"))
    failed = requests.filter(F.col(status) == "failed").select(key)
    return failed.join(fixes, key, "left").select(key, F.coalesce("n_corrections", F.lit(0)).alias("n_corrections"), F.coalesce("resolved", F.lit(False)).alias("resolved"))


def select_replay(batches: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, status): wanted batches that fail now or failed before are replayed; unknown ids are violations."""
    met = wanted.join(batches, key, "left")
    status = F.when(F.col("failed_now").isNull(), "unknown").when(F.col("failed_now") | F.col("failed_before"), "replay").otherwise("skip")
    return met.select(key, status.alias("status"))
