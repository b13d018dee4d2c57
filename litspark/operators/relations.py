"""Joins between documents, cards, runs and evidence, and the checks built on them.

A violation is a row that names what is wrong; a check returns violations and never stops the job itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rebuild_corpus(runs: DataFrame, cards: DataFrame, paper: str, generation: str) -> tuple[DataFrame, DataFrame]:
    """Cards of papers all of whose cards belong to the paper's run, and the stale papers, which are left out as a whole."""
    current = runs.select(paper, F.col(generation).alias("__current"))
    met = cards.join(current, paper)
    # the join has sorted the cards by paper: a window needs no second copy of them, nor another sort
    other = F.max(~F.col(generation).eqNullSafe(F.col("__current"))).over(Window.partitionBy(paper))
    met = met.withColumn("__stale", other)
    return met.filter("NOT __stale").drop("__current", "__stale"), met.filter("__stale").select(paper).distinct()


def cover_lines(lines: DataFrame, regions: DataFrame, by: str, number: str) -> DataFrame:
    """lines with the number of regions (by, start_line, end_line) that cover each; the key is equal, the range a residual."""
    spans = regions.select(F.col(by).alias("__by"), "start_line", "end_line", *[c for c in ("role",) if c in regions.columns])
    met = lines.join(spans, (F.col(by) == F.col("__by")) & F.col(number).between(F.col("start_line"), F.col("end_line")), "left")
    role = [F.min("role").alias("role")] if "role" in regions.columns else []
    return met.groupBy(by, number).agg(F.count("start_line").alias("assignment_count"), *role)


def assign_sections(cards: DataFrame, sections: DataFrame, by: str, card: str) -> DataFrame:
    """The only section that holds both ends of a card, null if there is none or more than one."""
    s = sections.select(F.col(by).alias("__by"), "section_id", F.col("start_line").alias("__s"), F.col("end_line").alias("__e"))
    inside = (F.col(by) == F.col("__by")) & (F.col("start_line") >= F.col("__s")) & (F.col("end_line") <= F.col("__e"))
    found = cards.join(s, inside, "left").groupBy(by, card).agg(F.count("section_id").alias("n"), F.min("section_id").alias("section_id"))
    return found.select(by, card, F.when(F.col("n") == 1, F.col("section_id")).alias("section_id"))


def overlapping(cards: DataFrame, regions: DataFrame, by: str) -> DataFrame:
    """Cards that share a line with a region of the same document."""
    r = regions.select(F.col(by).alias("__by"), F.col("start_line").alias("__s"), F.col("end_line").alias("__e"))
    return cards.join(r, (F.col(by) == F.col("__by")) & (F.col("start_line") <= F.col("__e")) & (F.col("end_line") >= F.col("__s")), "left_semi")


def verify_coverage(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, code): ids that are missing, unknown or repeated. Both sides are counted first, so each key meets once."""
    e = expected.groupBy(key).agg(F.count(F.lit(1)).alias("__e"))
    o = observed.groupBy(key).agg(F.count(F.lit(1)).alias("__o"))
    code = F.when(F.col("__o").isNull(), "missing").when(F.col("__e").isNull(), "unknown").when(F.col("__o") > 1, "repeated")
    return e.join(o, key, "full_outer").select(key, code.alias("code")).filter("code IS NOT NULL")


def resolve_citations(citations: DataFrame, quotes: DataFrame, quote: str, owner: str) -> DataFrame:
    """citations with ``status``: ok, unknown_quote, or foreign_quote if the quote belongs to another card."""
    q = quotes.select(quote, F.col(owner).alias("__owner"))
    status = F.when(F.col("__owner").isNull(), "unknown_quote").when(F.col("__owner") != F.col(owner), "foreign_quote").otherwise("ok")
    return citations.join(q, quote, "left").withColumn("status", status).drop("__owner")


def longest_word(text: Column) -> Column:
    """The longest word of a text, the first one by name among equals, which stands for its rarest; null without a word."""
    words = F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return F.get(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 0)["w"]


def grams(text: Column, width: Column) -> Column:
    """Different substrings of ``width`` characters; none of shorter texts, and the empty one for width 0."""
    starts = F.when(width == 0, F.array(F.lit(1))).when(F.length(text) >= width, F.sequence(F.lit(1), F.length(text) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, width)))


def find_quotes(quotes: DataFrame, texts: DataFrame, quote: str, text: str) -> DataFrame:
    """Pairs of quotes and texts that contain them, without a common key: exactly those for which ``contains`` holds.

    A text can only contain a quote whose inner words it has, so texts are posted under their different words and quotes
    probe with the longest of their inner words. Quotes without a whole inner word (one or two words, or only signs between
    them) could be cut out of longer words; texts are posted for them under their substrings of as many characters as
    such a quote has, up to eight. Posts hold a key of the text only; texts are fetched for pairs that meet. Nothing is
    broadcast. Null quotes and texts meet nothing; an empty quote is in every text and is met with each.
    """
    inner = F.regexp_extract(F.col(quote), r"(?s)^\S+\s+(.*)\s+\S+$", 1)
    named = quotes.withColumn("__word", longest_word(inner)).filter(F.col(quote).isNotNull())
    keyed = texts.filter(F.col(text).isNotNull()).withColumn("__t", F.unhex(F.substring(F.sha2(text, 256), 1, 32)))
    bodies = keyed.select("__t", F.col(text).alias("__text")).dropDuplicates(["__t"])
    asked = named.select(F.col(quote).alias("__quote"), "__word").distinct()

    probe = asked.filter("__word IS NOT NULL")
    words = bodies.select("__t", F.explode(F.array_distinct(F.split("__text", r"[^\p{L}\p{N}]+"))).alias("__word"))
    met = probe.join(words.join(probe.select("__word").distinct(), "__word", "left_semi"), "__word").select("__quote", "__t")

    cut = asked.filter("__word IS NULL").withColumn("__n", F.least(F.length("__quote"), F.lit(8)))
    cut = cut.withColumn("__gram", F.substring("__quote", F.lit(1), F.col("__n")))
    sizes = cut.groupBy().agg(F.collect_set("__n").alias("__sizes"))  # at most nine numbers in one row
    every = F.flatten(F.transform("__sizes", lambda n: grams(F.col("__text"), n)))
    pieces = bodies.crossJoin(F.broadcast(sizes)).select("__t", F.explode(every).alias("__gram"))
    met = met.unionByName(cut.join(pieces.join(cut.select("__gram").distinct(), "__gram", "left_semi"), "__gram").select("__quote", "__t"))
    pairs = met.distinct().join(bodies, "__t").filter(F.contains("__text", F.col("__quote"))).select("__quote", "__t")
    left = quotes.withColumn("__quote", F.col(quote))
    return left.join(pairs, "__quote").join(keyed, "__t").drop("__quote", "__t")


def verify_quotes(evidence: DataFrame, cards: DataFrame, card: str, quote: str, text: str) -> DataFrame:
    """evidence with ``verbatim``: whether the quote is part of the text of its card."""
    c = cards.select(card, F.col(text).alias("__text"))
    return evidence.join(c, card, "left").withColumn("verbatim", F.coalesce(F.contains("__text", F.col(quote)), F.lit(False))).drop("__text")


def frozen_differences(stored: DataFrame, frozen: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, code, field): where stored rows aren't what was frozen.

    ``differs`` names a field that isn't the same, nulls being equal; ``not_frozen`` is a stored key without a frozen row,
    ``repeated`` one with several, which are compared with none of them. Frozen rows that nothing stores are no fault.
    """
    once = frozen.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__times"), *[F.first(c).alias(f"__{c}") for c in fields])
    met = stored.join(once, F.col(key).eqNullSafe(F.col("__key")), "left")
    one = F.col("__times") == 1
    fault = lambda bad, code, field: F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))
    found = [fault(F.col("__times").isNull(), "not_frozen", None), fault(F.col("__times") > 1, "repeated", None), *[fault(one & ~F.col(c).eqNullSafe(F.col(f"__{c}")), "differs", c) for c in fields]]
    return met.select(key, F.explode(F.array_compact(F.array(*[f.cast("struct<code:string,field:string>") for f in found]))).alias("v")).select(key, "v.*")


def neighbor_context(cards: DataFrame, cited: DataFrame, paper: str, order: str, card: str, reach: int = 1) -> DataFrame:
    """Cited cards and those before and after them in the order of the paper, with ``is_cited``."""
    placed = cards.withColumn("__pos", F.row_number().over(Window.partitionBy(paper).orderBy(order, card)))
    hits = placed.join(cited.select(card).distinct(), card, "left_semi").select(paper, F.explode(F.sequence(F.col("__pos") - reach, F.col("__pos") + reach)).alias("__pos"), F.col("__pos").alias("__at"))
    near = hits.groupBy(paper, "__pos").agg(F.max(F.col("__at") == F.col("__pos")).alias("is_cited"))
    return placed.join(near, [paper, "__pos"]).drop("__pos")


def dangling_refs(refs: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    return refs.join(targets.select(key), key, "left_anti")


def pack_integrity(pack: DataFrame, cards: DataFrame, card: str) -> DataFrame:
    """One row: ids in the pack, those missing from the corpus, hits and their share of all cards."""
    known = pack.select(card).distinct().join(cards.select(card).distinct().withColumn("__known", F.lit(1)), card, "left")
    one = known.agg(F.count(F.lit(1)).alias("n_pack"), F.count("__known").alias("n_hit"))
    total = cards.agg(F.count(F.lit(1)).alias("n_cards"))
    both = one.crossJoin(F.broadcast(total))  # one row each
    return both.select("n_pack", "n_hit", (F.col("n_pack") - F.col("n_hit")).alias("n_missing"), F.coalesce(F.try_divide("n_hit", "n_cards"), F.lit(0.0)).alias("hit_ratio"))


def evidence_catalog(runs: DataFrame, evidence: DataFrame, run: str, paper: str, unit: str) -> tuple[DataFrame, DataFrame]:
    """Evidence of the chosen runs with its paper, and violations: an id found twice, two runs of one paper."""
    found = evidence.join(runs.select(run, paper), run)
    twice = found.groupBy(F.col(unit).cast("string").alias("value")).count().filter("count > 1").select(F.lit("repeated_evidence").alias("code"), "value")
    papers = runs.groupBy(F.col(paper).cast("string").alias("value")).count().filter("count > 1").select(F.lit("two_runs").alias("code"), "value")
    return found, twice.unionByName(papers)


def compare_runs(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change): added, removed, or the name of a field that differs."""
    a = left.select(key, F.lit(1).alias("__l"), *[F.col(c).alias(f"__l_{c}") for c in fields])
    b = right.select(key, F.lit(1).alias("__r"), *[F.col(c).alias(f"__r_{c}") for c in fields])
    differs = [F.when(F.col("__l").isNotNull() & F.col("__r").isNotNull() & ~F.col(f"__l_{c}").eqNullSafe(F.col(f"__r_{c}")), F.lit(c)) for c in fields]
    change = F.array_compact(F.array(F.when(F.col("__l").isNull(), F.lit("added")), F.when(F.col("__r").isNull(), F.lit("removed")), *differs))
    return a.join(b, key, "full_outer").select(key, F.explode(change).alias("change"))


def migrate_decisions(previous: DataFrame, current: DataFrame, unit: str, anchor: str, decision: str) -> DataFrame:
    """current with ``decision`` and ``outcome``: carried for the same unit, pending for the same anchor only, else new; conflict if the unit has another anchor."""
    units = previous.select(unit, F.col(anchor).alias("__anchor"), F.col(decision).alias("__decision"))
    anchors = previous.select(anchor).distinct().withColumn("__known", F.lit(True))
    met = current.join(units, unit, "left").join(anchors, anchor, "left")
    outcome = F.when(F.col("__anchor").isNotNull() & (F.col("__anchor") != F.col(anchor)), "conflict").when(F.col("__anchor").isNotNull(), "carried").when(F.col("__known"), "pending").otherwise("new")
    return met.withColumn("outcome", outcome).withColumn("decision", F.when(F.col("outcome") == "carried", F.col("__decision"))).drop("__anchor", "__decision", "__known")


def ancestors(nodes: DataFrame, node: str, parent: str, levels: int) -> DataFrame:
    """(node, ancestor, distance), the node itself included, up to a number of levels; one self-join a level."""
    up = nodes.select(F.col(node).alias("__n"), F.col(parent).alias("__p"))
    step = nodes.select(F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).alias("distance"))
    found = [step]
    for k in range(1, levels + 1):
        step = step.join(up, F.col("ancestor") == F.col("__n")).filter("__p IS NOT NULL").select("node", F.col("__p").alias("ancestor"), F.lit(k).alias("distance"))
        found.append(step)
    return reduce(DataFrame.unionByName, found)


def lowest_common(units: DataFrame, closure: DataFrame, unit: str, node: str) -> DataFrame:
    """Per unit the nearest ancestor that all of its nodes share."""
    cited = units.select(unit, node).distinct()
    total = cited.groupBy(unit).agg(F.count(F.lit(1)).alias("__total"))
    up = cited.join(closure.withColumnRenamed("node", node), node).groupBy(unit, "ancestor").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("d"))
    return up.join(total, unit).filter("n = __total").groupBy(unit).agg(F.min_by("ancestor", F.struct("d", "ancestor")).alias("lca"))


def nearest_before(rows: DataFrame, by: list[str], order: str, is_mark: Column, value: Column, to: str) -> DataFrame:
    """rows with the value of the nearest marked row before or at each, in its group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(to, F.last(F.when(is_mark, value), ignorenulls=True).over(w))


def supported_ordinals(cands: DataFrame, by: str, ordinal: str) -> DataFrame:
    """Candidates with a neighbour of the ordinal before or after in the same document."""
    near = cands.select(F.col(by).alias("__by"), F.explode(F.array(F.col(ordinal) - 1, F.col(ordinal) + 1)).alias("__o")).distinct()
    return cands.join(near, (F.col(by) == F.col("__by")) & (F.col(ordinal) == F.col("__o")), "left_semi")


def set_changes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): ids that only one of two sets has, and those of both."""
    x, y = a.select(key).distinct().withColumn("__a", F.lit(1)), b.select(key).distinct().withColumn("__b", F.lit(1))
    side = F.when(F.col("__b").isNull(), "left").when(F.col("__a").isNull(), "right").otherwise("both")
    return x.join(y, key, "full_outer").select(key, side.alias("side"))


def remap_ids(refs: DataFrame, mapping: DataFrame, owner: str, ref: str, order: str) -> DataFrame:
    """Per owner its references after replacement by the mapping (ref, new_id), different ones in order of first place."""
    met = refs.join(mapping, ref, "left").withColumn("__id", F.coalesce("new_id", ref))
    first = met.groupBy(owner, "__id").agg(F.min(order).alias("__at"))
    return first.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__id"))), lambda x: x["__id"]).alias("ids"))
