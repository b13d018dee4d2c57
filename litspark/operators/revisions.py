"""Revisions of statements and evidence, automatic resolutions, and what they do to references and dispositions.

Tables: evidence (unit, anchor_id, claim, ...); statements (statement_id, field, pos, single, statement, units), units
being the ids of the evidence that a statement cites and single marking fields of one statement; dispositions (unit,
disposition, reason). Violations are rows (code, item). Tables that come out leave out what is in violation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.functions.text import stable_id
from litspark.operators.evidence import evidence_ids
from litspark.operators.relations import remap_ids
from litspark.operators.trees import chain_ends, written

#: Reasons that go with each disposition, and what makes a doubted fragment too risky to be overridden.
REASONS = {"used": ["supports_claim"], "redundant": ["duplicate_support"], "peripheral": ["background_only", "supporting_detail", "low_confidence"], "excluded": ["low_confidence", "off_topic"]}
RISKY = "[0-9０-９%=<>≤≥≈±+*/^]|因果|导致|提高|降低|增长|下降|倍|比例|构建|建立|验证|证明|完成|发现|公式|最优|鲁棒|度量|含义|作用"


def faults(df: DataFrame, item: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(code, item) for each rule (code, whether it is broken); null isn't broken."""
    found = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules]))
    return df.select(F.explode(found).alias("code"), F.col(item).cast("string").alias("item"))


def answered_once(asked: DataFrame, given: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(ids that are asked for and given once, violations missing, unknown and repeated)."""
    n = lambda asked, given: [F.lit(asked).cast("long").alias("asked"), F.lit(given).cast("long").alias("n")]
    met = asked.select(key, *n(1, 0)).unionByName(given.select(key, *n(0, 1))).groupBy(key).agg(F.sum("asked").alias("asked"), F.sum("n").alias("n"))
    null, times = F.col(key).isNull(), F.col("n")  # a null id answers nothing
    known = F.col("asked") > 0
    bad = faults(met, key, [("missing", known & ((times == 0) | null)), ("unknown", (times > 0) & (~known | null)), ("repeated", known & (times > 1) & ~null)])
    return met.filter(known & (times == 1) & ~null).select(key), bad


def reason_fits(disposition: Column, reason: Column) -> Column:
    allowed = F.create_map(*[x for d, rs in REASONS.items() for x in (F.lit(d), F.array(*[F.lit(r) for r in rs]))])
    return F.coalesce(F.array_contains(F.coalesce(F.try_element_at(allowed, disposition), F.array().cast("array<string>")), reason), F.lit(False))


def references(statements: DataFrame) -> DataFrame:
    """(unit) of all evidence that some statement cites."""
    return statements.select(F.explode("units").alias("unit")).distinct()


def disposition_rules() -> tuple[Column, Column, list[tuple[str, Column]]]:
    """Whether a unit is used, whether it is answered once, and rules, by its cited, there, n, fits and uncited."""
    null, there, n = F.col("unit").isNull(), F.col("there"), F.col("n")  # a null id is no reference and answers nothing
    used = F.col("cited") & there & ~null
    once = there & ~used & ~null & (n == 1)
    return used, once, [
        ("missing", there & ~used & ((n == 0) | null)), ("unknown", (n > 0) & (~there | null)), ("repeated", there & ~used & ~null & (n > 1)),
        ("reason_not_allowed", once & ~F.col("fits")), ("used_but_not_cited", once & F.col("uncited")), ("classified_though_used", used & (n > 0)),
    ]


def finalize_dispositions(refs: DataFrame, evidence: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dispositions, violations): cited evidence is used, all other has exactly one disposition that isn't ``used``.

    Codes: missing, unknown, repeated; reason_not_allowed; classified_though_used; used_but_not_cited.
    """
    fits = reason_fits(F.col("disposition"), F.col("reason"))
    flags = lambda cited, there, n, fit, wrong: [F.lit(cited).alias("cited"), F.lit(there).alias("there"), F.lit(n).cast("long").alias("n"), F.lit(fit).alias("fits"), F.lit(wrong).alias("uncited")]
    told = given.select("unit", *flags(False, False, 1, fits, fits & (F.col("disposition") == "used")))
    each = reduce(DataFrame.unionByName, [refs.select("unit", *flags(True, False, 0, False, False)), evidence.select("unit", *flags(False, True, 0, False, False)), told])
    # one aggregate of numbers and flags by unit instead of joins, each of which would sort the units again
    met = each.groupBy("unit").agg(*[F.bool_or(c).alias(c) for c in ("cited", "there", "fits", "uncited")], F.sum("n").alias("n"))
    used, once, rules = disposition_rules()
    bad = faults(met, "unit", rules)
    good = met.filter(used).select("unit", F.lit("used").alias("disposition"), F.lit("supports_claim").alias("reason"))
    rows = given.join(met.filter(once).select("unit"), "unit", "left_semi")
    return good.unionByName(rows.filter(fits & (F.col("disposition") != "used")).select("unit", "disposition", "reason")), bad


def judged_revisions(statements: DataFrame, blocked: DataFrame, revisions: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """(statements with ``out``, the array of what each becomes, as a written table; violations)."""
    once, bad = answered_once(blocked, revisions, "statement_id")
    given = revisions.join(once, "statement_id", "left_semi").select("statement_id", "action", "items", F.lit(True).alias("met"))
    n, replaces, items = F.size("items"), F.col("action") == "replace", F.col("items")
    empty = F.exists(items, lambda x: (F.coalesce(F.length(x["statement"]), F.lit(0)) == 0) | (F.coalesce(F.size(x["units"]), F.lit(0)) <= 0))
    rules = [
        ("unknown_action", ~F.coalesce(F.col("action").isin("replace", "delete"), F.lit(False))),
        ("single_deleted", F.col("single") & (F.col("action") == "delete")),
        ("item_count", F.when(replaces, ~F.coalesce(n.between(1, F.when(F.col("single"), 1).otherwise(4)), F.lit(False))).otherwise(F.coalesce(n, F.lit(0)) > 0)),
        ("item_empty", replaces & empty),
        ("item_too_long", replaces & F.exists(items, lambda x: F.length(x["statement"]) > longest)),
        ("item_repeated", replaces & (F.size(F.array_distinct(items)) < n)),
        ("new_evidence", replaces & F.exists(items, lambda x: F.size(F.array_except(x["units"], F.col("units"))) > 0)),
        ("unchanged", replaces & (n == 1) & (F.get(items, 0)["statement"] == F.col("statement")) & (F.get(items, 0)["units"] == F.col("units"))),
    ]
    codes = F.when(F.col("met"), F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules])))
    # rows of one id stand or fall together; the join has put them side by side
    df = statements.join(given, "statement_id", "left").withColumn("codes", codes)
    df = df.withColumn("ok", F.coalesce(F.max(F.size("codes")).over(Window.partitionBy("statement_id")) == 0, F.lit(False)) & F.coalesce("met", F.lit(False)))
    one = lambda part, x, units: F.struct(part.cast("int").alias("part"), x.alias("statement"), units.alias("units"))
    new = F.when(replaces, F.transform(items, lambda x, i: one(i, x["statement"], x["units"])))
    out = F.when(~F.col("ok"), F.array(one(F.lit(0), F.col("statement"), F.col("units")))).otherwise(new)
    judged = written(df.select("statement_id", "field", "pos", "single", "units", "codes", out.alias("out")), "judged")
    return judged, bad.unionByName(judged.select(F.explode("codes").alias("code"), F.col("statement_id").cast("string").alias("item")))


def placed(judged: DataFrame, block: int = 4096) -> DataFrame:
    """The statements that came out, with places counted anew: inside of blocks of old places, after the rows of those before."""
    df = judged.select("statement_id", "field", "pos", "single", F.floor(F.col("pos") / block).alias("__block"), F.explode("out").alias("x")).select("statement_id", "field", "pos", "single", "__block", "x.*")
    sizes = df.groupBy("field", "__block").agg(F.count(F.lit(1)).alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("field").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("field").alias("__f"), F.col("__block").alias("__b"), start.alias("__start"))
    place = F.row_number().over(Window.partitionBy("field", "__block").orderBy("pos", "part", "statement_id")) - 1
    met = df.withColumn("__place", place).join(starts, F.col("field").eqNullSafe(F.col("__f")) & F.col("__block").eqNullSafe(F.col("__b")))
    return met.select("statement_id", "part", "field", (F.col("__start") + F.col("__place")).cast("int").alias("pos"), "single", "statement", "units")


def revise_statements(statements: DataFrame, blocked: DataFrame, revisions: DataFrame, longest: int = 320) -> tuple[DataFrame, DataFrame]:
    """(statements after revision, violations).

    revisions: statement_id, action, items (array of statement and units). Every blocked statement is revised exactly once:
    deleted, or replaced by one to four others (a single one by one), which cite only evidence that it cited. What is in
    violation stays as it was. Places in a field are counted anew.
    """
    judged, bad = judged_revisions(statements, blocked, revisions, longest)
    return placed(judged), bad


def apply_revision(statements: DataFrame, blocked: DataFrame, revisions: DataFrame, evidence: DataFrame, dispositions: DataFrame, released: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statements, dispositions, violations) after a revision.

    Evidence that was cited before and no longer is, is released: each such unit needs exactly one row of ``released``, no
    other unit has one, and its reason must be allowed. Together with the old dispositions of evidence that nothing cited
    these are then finalized for all evidence. All that is asked of a unit is one aggregate by unit.
    """
    judged, bad = judged_revisions(statements, blocked, revisions, 320)
    fits = reason_fits(F.col("disposition"), F.col("reason"))
    old = dispositions.filter("disposition <> 'used'")
    names = {"before": "boolean", "cited": "boolean", "there": "boolean", "n_old": "long", "old_fits": "boolean", "n_new": "long", "new_fits": "boolean", "new_uncited": "boolean"}
    row = lambda df, **told: df.select("unit", *[told.get(c, F.lit(0 if kind == "long" else False)).cast(kind).alias(c) for c, kind in names.items()])
    sure, one = F.lit(True), F.lit(1)
    each = [
        row(judged.select(F.explode("units").alias("unit")), before=sure),
        row(judged.select(F.explode(F.flatten("out.units")).alias("unit")), cited=sure),
        row(evidence, there=sure),
        row(old.select("unit", fits.alias("f")), n_old=one, old_fits=F.col("f")),
        row(released.select("unit", "disposition", fits.alias("f")), n_new=one, new_fits=F.col("f"), new_uncited=F.col("f") & (F.col("disposition") == "used")),
    ]
    met = reduce(DataFrame.unionByName, each).groupBy("unit").agg(*[(F.sum(c) if kind == "long" else F.bool_or(c)).alias(c) for c, kind in names.items()])
    null = F.col("unit").isNull()
    freed = F.col("before") & (~F.col("cited") | null)
    met = met.withColumns({"freed": freed, "answered": freed & (F.col("n_new") == 1) & ~null})
    kept, answered = null | (~F.col("freed") & ~F.col("cited")), F.col("answered")
    n = F.when(kept, F.col("n_old")).otherwise(0) + answered.cast("long")
    met = met.withColumns({"kept": kept, "n": n, "fits": (kept & F.col("old_fits")) | (answered & F.col("new_fits")), "uncited": answered & F.col("new_uncited")})
    met = written(met.select("unit", "cited", "there", "freed", "answered", "kept", "n_new", "n", "fits", "uncited"), "units")

    used, once, rules = disposition_rules()
    freed, new, named = F.col("freed"), F.col("n_new"), F.col("freed") & ~answered & ~null
    wrong = [("released_missing", freed & ((new == 0) | null)), ("released_unknown", (new > 0) & (~freed | null)), ("released_repeated", freed & (new > 1) & ~null)]
    # released units without a single answer have been named already
    bad = bad.unionByName(faults(met, "unit", [*wrong, *[(code, broken & ~named if code == "missing" else broken) for code, broken in rules]]))
    final = met.filter(used).select("unit", F.lit("used").alias("disposition"), F.lit("supports_claim").alias("reason"))
    for given, which in ((old, F.col("kept")), (released, answered)):
        rows = given.filter(fits & (F.col("disposition") != "used")).join(met.filter(once & which).select("unit"), "unit", "left_semi")
        final = final.unionByName(rows.select("unit", "disposition", "reason"))
    return placed(judged), final, bad


def revise_evidence(evidence: DataFrame, blocked: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence, mapping, violations): blocked units are deleted, or get another claim or caveats and with it a new id.

    revisions: unit, action, claim, caveats. The anchor, which stands for the citations, stays. mapping: unit, action and
    result, null for deleted ones. Units that would get the same id are in violation, and both stay as they were.
    """
    once, bad = answered_once(blocked, revisions, "unit")
    r = revisions.join(once, "unit", "left_semi").select("unit", "action", F.trim("claim").alias("new_claim"), F.coalesce("caveats", F.array().cast("array<string>")).alias("new_caveats"))
    met = evidence.join(r, "unit", "left")
    replaces = F.col("action") == "replace"
    same = (F.trim("claim") == F.col("new_claim")) & (F.coalesce("caveats", F.array().cast("array<string>")) == F.col("new_caveats"))
    unknown = F.col("action").isNotNull() & ~F.col("action").isin("replace", "delete")
    rules = [("unknown_action", unknown), ("unchanged", replaces & same), ("claim_empty", replaces & (F.coalesce(F.length("new_claim"), F.lit(0)) == 0))]
    ok = F.col("action").isNotNull() & ~reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), [c for _, c in rules], F.lit(False))
    met = met.withColumn("ok", ok).withColumn("result", F.when(ok & replaces, stable_id("unit_", F.col("anchor_id"), F.col("new_claim"))).when(~ok, F.col("unit")))
    met = written(met, "revised_evidence")
    bad = bad.unionByName(faults(met, "unit", rules))
    twice = met.filter("result IS NOT NULL").groupBy("result").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("result", F.lit(True).alias("clash"))
    met = met.join(twice, "result", "left").withColumn("ok", F.col("ok") & F.col("clash").isNull())
    bad = bad.unionByName(faults(met, "unit", [("id_repeated", F.col("clash") & F.col("action").isNotNull())]))
    changes = F.col("ok") & replaces
    values = {"unit": F.when(changes, F.col("result")).otherwise(F.col("unit")), "claim": F.when(changes, F.col("new_claim")).otherwise(F.col("claim")), "caveats": F.when(changes, F.col("new_caveats")).otherwise(F.col("caveats"))}
    kept = met.filter(~(F.col("ok") & (F.col("action") == "delete"))).select([values.get(c, F.col(c)).alias(c) for c in evidence.columns])
    mapping = met.filter("ok").select("unit", "action", F.when(replaces, F.col("result")).alias("result"))
    return kept, mapping, bad


def override_allowed(verdict: Column, fragments: Column) -> Column:
    """Whether a gate may be overridden without a human: partly supported, and no doubted fragment is risky."""
    return (verdict == "partially_supported") & ~F.exists(F.coalesce(fragments, F.array().cast("array<string>")), lambda x: x.rlike(RISKY))


def evidence_outcomes(evidence: DataFrame, issues: DataFrame, actions: DataFrame, quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, violations). outcomes: unit, action, applied, link (the id it is mapped to, null if none), citations.

    issues: unit, verdict, fragments. actions: unit, action, replacement, selected (quote ids). quotes: unit, quote_id that
    may be chosen for it.
    """
    once, bad = answered_once(issues, actions, "unit")
    chosen = actions.join(once, "unit", "left_semi").join(issues.select("unit", "verdict", "fragments"), "unit").join(evidence.select("unit", "generation", "kind", "claim"), "unit", "left")
    allowed = quotes.groupBy("unit").agg(F.collect_set("quote_id").alias("allowed"))
    there = evidence.select(F.col("unit").alias("replacement"), F.lit(True).alias("there"))
    df = chosen.join(allowed, "unit", "left").join(there, "replacement", "left")
    df = evidence_ids(df.withColumn("old", F.col("unit")).withColumn("picked", F.array_distinct(F.coalesce("selected", F.array().cast("array<string>")))).drop("unit"), "generation", "kind", "picked", "claim")
    df = df.withColumnsRenamed({"unit_id": "repaired", "old": "unit"})
    a = F.col("action")
    rules = [
        ("unknown_action", ~F.coalesce(a.isin("human_required", "keep_gate_override", "replace_with_supported_evidence", "repair_citations"), F.lit(False))),
        ("override_not_allowed", (a == "keep_gate_override") & ~F.coalesce(override_allowed(F.col("verdict"), F.col("fragments")), F.lit(False))),
        ("replacement_missing", (a == "replace_with_supported_evidence") & (F.col("there").isNull() | (F.col("replacement") == F.col("unit")))),
        ("quotes_not_allowed", (a == "repair_citations") & ((F.size("picked") == 0) | (F.size(F.array_except("picked", F.coalesce("allowed", F.array().cast("array<string>")))) > 0))),
        ("citations_unchanged", (a == "repair_citations") & (F.col("repaired") == F.col("unit"))),
        ("unit_unknown", F.col("claim").isNull()),
    ]
    good = ~reduce(lambda x, y: x | F.coalesce(y, F.lit(False)), [c for _, c in rules], F.lit(False))
    link = F.when(a == "replace_with_supported_evidence", F.col("replacement")).when(a == "repair_citations", F.col("repaired"))
    df = written(df.withColumn("good", good), "outcomes")
    applied = F.col("good") & (a != "human_required")
    return df.select("unit", "action", applied.alias("applied"), F.when(F.col("good"), link).alias("link"), F.when(F.col("good") & (a == "repair_citations"), F.col("picked")).alias("citations"), F.col("anchor_id").alias("new_anchor")), bad.unionByName(faults(df, "unit", rules))


def auto_resolve(evidence: DataFrame, issues: DataFrame, actions: DataFrame, quotes: DataFrame, statements: DataFrame, statement_actions: DataFrame, dispositions: DataFrame) -> dict[str, DataFrame]:
    """evidence, statements, dispositions, mapping, log and violations after one chosen action for each issue.

    A unit that is replaced goes, one whose citations are repaired gets a new id. Ids are mapped to the ends of their
    chains, since a replacement may be replaced or repaired itself; chains that go in circles are violations and change
    nothing. Statements that are named as copies of another are deleted, in fields of several only. All others cite the
    mapped ids, each once, in order of first place. Dispositions are built anew: cited evidence is used, other evidence
    keeps what it (or the unit that it was repaired from) had, and what was used before is redundant.
    """
    outcomes, bad = evidence_outcomes(evidence, issues, actions, quotes)
    links = written(outcomes.filter("link IS NOT NULL").select("unit", "link"), "links")
    ends = written(chain_ends(links, "unit", "link").select("unit", F.col("end").alias("result"), "hops"), "mapping")
    bad = bad.unionByName(faults(ends, "unit", [("mapping_cycle", F.col("result").isNull())]))
    mapping = ends.filter("result IS NOT NULL")

    done = outcomes.join(ends.select("unit", "result", F.lit(True).alias("mapped")), "unit", "left")
    done = done.withColumn("applied", F.col("applied") & ~(F.coalesce("mapped", F.lit(False)) & F.col("result").isNull()))
    done = written(done, "done")
    change = done.filter("applied").select("unit", "action", "link", "citations", "new_anchor")
    repaired = F.col("action") == "repair_citations"
    values = {"unit": F.when(repaired, F.col("link")).otherwise(F.col("unit")), "citations": F.when(repaired, F.col("change_citations")).otherwise(F.col("citations")), "anchor_id": F.when(repaired, F.col("new_anchor")).otherwise(F.col("anchor_id"))}
    met = evidence.join(change.withColumnRenamed("citations", "change_citations"), "unit", "left")
    revised = met.filter("action IS NULL OR action <> 'replace_with_supported_evidence'").select([values.get(c, F.col(c)).alias(c) for c in evidence.columns])
    revised = written(revised, "revised_evidence")
    twice = revised.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    bad = bad.unionByName(faults(twice, "unit", [("id_repeated", F.col("n") > 1)]))

    asked = statement_actions.select("statement_id", "action", "canonical")
    known = statements.select(F.col("statement_id").alias("canonical"), F.lit(True).alias("there"))
    judged = asked.join(statements.select("statement_id", "single", F.lit(True).alias("known")), "statement_id", "left").join(known, "canonical", "left")
    deletes = F.col("action") == "delete_misplaced"
    rules = [
        ("statement_unknown", F.col("known").isNull()),
        ("statement_action_unknown", ~F.coalesce(F.col("action").isin("human_required", "delete_misplaced"), F.lit(False))),
        ("canonical_invalid", deletes & (F.col("there").isNull() | (F.col("canonical") == F.col("statement_id")))),
        ("delete_not_allowed", deletes & F.col("single")),
    ]
    good = ~reduce(lambda x, y: x | F.coalesce(y, F.lit(False)), [c for _, c in rules], F.lit(False))
    judged = written(judged.withColumn("applied", deletes & good), "judged")
    bad = bad.unionByName(faults(judged, "statement_id", rules))
    left = statements.join(judged.filter("applied").select("statement_id").distinct(), "statement_id", "left_anti")
    refs = left.select("statement_id", F.posexplode_outer("units").alias("at", "ref")).filter("ref IS NOT NULL")
    ids = remap_ids(refs, mapping.select(F.col("unit").alias("ref"), F.col("result").alias("new_id")), "statement_id", "ref", "at")
    left = left.drop("units").join(ids.withColumnRenamed("ids", "units"), "statement_id", "left").withColumn("units", F.coalesce("units", F.array().cast("array<string>")))
    left = written(left.select(statements.columns), "statements")

    sources = mapping.join(done.filter("applied AND action = 'repair_citations'").select(F.col("link").alias("result"), F.col("unit").alias("source")), "result").select(F.col("result").alias("unit"), "source").distinct()
    had = revised.select("unit").distinct().join(sources, "unit", "left").withColumn("source", F.coalesce("source", "unit"))
    had = had.join(dispositions.select(F.col("unit").alias("source"), F.col("disposition").alias("d"), F.col("reason").alias("r")), "source", "left").join(references(left).withColumn("cited", F.lit(True)), "unit", "left")
    keeps = F.col("d").isNotNull() & (F.col("d") != "used")
    final = had.select("unit", F.when(F.col("cited"), "used").when(keeps, F.col("d")).otherwise("redundant").alias("disposition"), F.when(F.col("cited"), "supports_claim").when(keeps, F.col("r")).otherwise("duplicate_support").alias("reason"))
    log = done.select(F.lit("evidence").alias("kind"), F.col("unit").cast("string").alias("id"), "action", "applied", F.when(F.col("applied"), F.coalesce("result", "link")).alias("result"))
    log = log.unionByName(judged.select(F.lit("statement").alias("kind"), F.col("statement_id").cast("string").alias("id"), "action", "applied", F.when(F.col("applied"), F.col("canonical").cast("string")).alias("result")))
    return {"evidence": revised, "statements": left, "dispositions": final, "mapping": mapping, "log": log, "violations": bad}
