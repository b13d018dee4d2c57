"""Plans of requests: which cards go into which batch, within a budget of tokens, and the audit of such plans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.operators.trees import descendants, numbered_groups, tree_paths, written


@dataclass(frozen=True)
class Budget:
    """A window of tokens for the prompt's frame, the cards, the answer and a margin, and bounds on answer and cards."""

    window: int
    base: int = 0
    margin: int = 0
    answer_base: int = 0
    answer_per_card: int = 0
    answer_most: int = 1 << 40
    cards_most: int = 1 << 40

    def failure(self, n: Column, tokens: Column) -> Column:
        """Why n cards of so many tokens together are no batch; null if they are one."""
        answer = self.answer_base + self.answer_per_card * n
        return F.when(n > self.cards_most, "too_many_cards").when(answer > self.answer_most, "answer_too_long").when(tokens + self.base + answer + self.margin > self.window, "window_exceeded")

    def fits(self, n: int, tokens: int) -> bool:
        answer = self.answer_base + self.answer_per_card * n
        return n <= self.cards_most and answer <= self.answer_most and tokens + self.base + answer + self.margin <= self.window


def card_units(cards: DataFrame, sections: DataFrame, budget: Budget, paper: str, section: str, tokens: str, deepest: int = 3) -> DataFrame:
    """(paper, section, unit, mode, code): where the cards of a section are planned.

    The budgets of all sections are sums over their descendants. From the top, a section that fits is a unit as a whole;
    one of level 0, of level ``deepest`` or more, or without children is packed card by card; all others hand their cards
    to their children and keep those that are directly in them as a unit. ``code`` says where the section tree didn't
    offer a way and packing is a makeshift.
    """
    # sections that the tree doesn't have are roots of their own, of level 0
    known = sections.select(paper, section, F.col("parent"), F.col("level"))
    extra = cards.select(paper, F.col(section)).distinct().join(known, [paper, section], "left_anti")
    known = known.unionByName(extra.select(paper, section, F.lit(None).cast(known.schema["parent"].dataType).alias("parent"), F.lit(0).cast(known.schema["level"].dataType).alias("level")))
    known = written(known, "sections")
    paths = tree_paths(known, [paper], section, "parent")
    paths = written(paths.withColumn("path", F.coalesce("path", F.array(section))), "section_paths")  # on a cycle: by itself
    own = written(cards.groupBy(paper, section).agg(F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("t")), "section_sums")
    closure = descendants(paths, [paper], section)
    sums = closure.join(own, [paper, section]).groupBy(paper, "ancestor").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    parents = known.filter("parent IS NOT NULL").select(paper, F.col("parent").alias("ancestor")).distinct().withColumn("has_children", F.lit(True))
    levels = known.select(paper, F.col(section).alias("ancestor"), "level")
    node = sums.join(levels, [paper, "ancestor"]).join(parents, [paper, "ancestor"], "left").withColumn("failure", budget.failure(F.col("n"), F.col("t")))
    leaf = F.col("has_children").isNull()
    packs = (F.col("level") >= deepest) | (F.col("level") == 0) | leaf
    mode = F.when(F.col("failure").isNull(), "whole").when(packs, "packed")
    poor = leaf & F.col("level").between(1, deepest - 1) & (F.col("failure") != "too_many_cards") & (F.col("n") > 1)
    node = written(node.select(paper, "ancestor", mode.alias("mode"), F.when(poor, "no_finer_section").alias("code")).filter("mode IS NOT NULL"), "section_modes")
    stops = closure.join(node, [paper, "ancestor"]).groupBy(paper, section)
    stops = stops.agg(F.max(F.struct("distance", F.col("ancestor").alias("unit"), "mode", "code")).alias("stop"))
    direct = own.withColumn("failure", budget.failure(F.col("n"), F.col("t")))
    direct = direct.select(paper, section, F.when(F.col("failure").isNull(), "direct").otherwise("direct_packed").alias("own_mode"), F.when((F.col("failure") != "too_many_cards") & (F.col("n") > 1), "no_finer_section").alias("own_code"))
    met = direct.join(stops, [paper, section], "left")
    here = F.col("stop").isNull()
    return met.select(paper, section, F.when(here, F.col(section)).otherwise(F.col("stop.unit")).alias("unit"), F.when(here, F.col("own_mode")).otherwise(F.col("stop.mode")).alias("mode"), F.when(here, F.col("own_code")).otherwise(F.col("stop.code")).alias("code"))


def greedy_parts(cards: DataFrame, by: list[str], order: list[str], tokens: str, budget: Budget, to: str = "part") -> DataFrame:
    """cards with the number of their part in their group: a part takes cards in order while they fit.

    A fold over each group that keeps two numbers, read as a stream from Spark's sort, so a group is never held.
    """
    keyed = cards.select(F.struct(*[F.col(c) for c in cards.columns]).alias("row"), F.to_json(F.struct(*by)).alias("group"), F.col(tokens).cast("long").alias("tokens"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    sorted_rows = keyed.repartition("group").sortWithinPartitions("group", *[f"o{i}" for i in range(len(order))]).select("row", "group", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, part, n, held = None, 0, 0, 0
        for batch in batches:
            parts = []
            for g, t in zip(batch.column("group").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if g != group:
                    group, part, n, held = g, 0, 0, 0
                if n and not budget.fits(n + 1, held + (t or 0)):
                    part, n, held = part + 1, 0, 0
                n, held = n + 1, held + (t or 0)
                parts.append(part)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(parts, pa.int32())], names=["row", "part"])

    kind = sorted_rows.schema["row"].dataType.simpleString()
    placed = sorted_rows.mapInArrow(run, f"row {kind}, part int")
    return placed.select("row.*", F.col("part").alias(to))


def plan_batches(cards: DataFrame, sections: DataFrame, budget: Budget, paper: str, card: str, section: str, order: str, tokens: str, deepest: int = 3) -> tuple[DataFrame, DataFrame]:
    """(plan, violations). plan: paper, card, batch (numbered in order), section (that of the batch) and mode.

    A paper that fits is one batch. Any other is planned by ``card_units``, and units that don't fit are packed greedily.
    cards: unique (paper, card); sections: paper, section, parent, level. Every card is planned once. Violations are
    (paper, section, code): sections that should have had finer ones, and cards that exceed the budget alone.
    """
    cards = cards.select(paper, card, section, F.col(order).alias("__order"), F.coalesce(tokens, F.lit(0)).cast("long").alias("__tokens"))
    whole = cards.groupBy(paper).agg(F.count(F.lit(1)).alias("n"), F.sum("__tokens").alias("t"))
    fits = whole.filter(budget.failure(F.col("n"), F.col("t")).isNull()).select(paper)
    large = written(cards.join(fits, paper, "left_anti"), "large")
    units = written(card_units(large, sections, budget, paper, section, "__tokens", deepest), "units")
    met = large.join(units, [paper, section])
    packed = F.col("mode").isin("packed", "direct_packed")
    parts = greedy_parts(met.filter(packed), [paper, "unit", "mode"], ["__order", card], "__tokens", budget)
    small = cards.join(fits, paper, "left_semi").withColumns({"unit": F.lit(None).cast(large.schema[section].dataType), "mode": F.lit("paper"), "code": F.lit(None).cast("string")})
    rest = met.filter(~packed).unionByName(small.select(met.columns)).withColumn("part", F.lit(0))
    placed = written(parts.unionByName(rest), "placed")
    numbers = numbered_groups(placed.withColumn("unit", F.coalesce(F.col("unit").cast("string"), F.lit(""))), [paper], ["unit", "mode", "part"], "__order", "batch")
    plan = placed.withColumn("__unit", F.coalesce(F.col("unit").cast("string"), F.lit(""))).join(numbers.withColumnRenamed("unit", "__unit"), [paper, "__unit", "mode", "part"])
    alone = placed.filter(budget.failure(F.lit(1), F.col("__tokens")).isNotNull()).select(paper, F.col(section).cast("string").alias("section"), F.lit("card_over_budget").alias("code"))
    poor = units.filter("code IS NOT NULL").select(paper, F.col("unit").cast("string").alias("section"), "code").distinct()
    return plan.select(paper, card, "batch", F.col("unit").alias("section"), "mode"), alone.unionByName(poor)


def audit_plan(plan: DataFrame, cards: DataFrame, budget: Budget, paper: str, card: str, order: str, tokens: str) -> tuple[DataFrame, DataFrame]:
    """(violations, totals) of a plan (paper, card, batch).

    Violations are (paper, item, code): cards that are not planned, planned repeatedly or unknown; batches over the
    budget that have more than one card; batches that begin before the one before them ends; batch numbers with gaps.
    Totals are of each paper: cards, batches, tokens and the most tokens of a batch.
    """
    known = cards.select(paper, card, F.col(order).alias("__order"), F.coalesce(tokens, F.lit(0)).cast("long").alias("__tokens"))
    times = plan.groupBy(paper, card).agg(F.count(F.lit(1)).alias("times"))
    met = known.join(times, [paper, card], "full_outer")
    code = F.when(F.col("__order").isNull() & F.col("__tokens").isNull(), "unknown_card").when(F.col("times").isNull(), "not_planned").when(F.col("times") > 1, "planned_repeatedly")
    single = met.select(paper, F.col(card).cast("string").alias("item"), code.alias("code")).filter("code IS NOT NULL")
    batches = plan.select(paper, card, "batch").join(known, [paper, card]).groupBy(paper, "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("__tokens").alias("t"), F.min("__order").alias("first"), F.max("__order").alias("last"))
    batches = written(batches, "batches")
    w = "OVER (PARTITION BY `%s` ORDER BY batch)" % paper
    placed = batches.withColumns({"before": F.expr(f"max(last) OVER (PARTITION BY `{paper}` ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), "number": F.expr(f"row_number() {w}") - 1})
    over = budget.failure(F.col("n"), F.col("t")).isNotNull() & (F.col("n") > 1)
    codes = F.array_compact(F.array(F.when(over, "over_budget"), F.when(F.col("before") >= F.col("first"), "out_of_order"), F.when(F.col("batch") != F.col("number"), "number_gap")))
    whole = placed.select(paper, F.col("batch").cast("string").alias("item"), F.explode(codes).alias("code"))
    totals = batches.groupBy(paper).agg(F.sum("n").alias("n_cards"), F.count(F.lit(1)).alias("n_batches"), F.sum("t").alias("tokens"), F.max("t").alias("most_tokens"))
    return single.unionByName(whole), totals
