"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a target number of words. A source whose target is e times its size and a rest goes through e complete
epochs; the rest is drawn without replacement. Each document has the key u ** (1 / w), u uniform from a keyed hash of its
id and text and w its quality weight; documents are taken by falling key until their words reach the rest.

The prefix sums over a source are found by radix: words are summed by source and the leading bits of the key, the digit
in which the budget ends is found by a window over those sums (at most 2 ** RADIX rows per source), and only rows of
that digit go on to the next round. The few documents that agree in all digits are decided by a second hash. So no task
ever holds a source.

Defined cases: null or empty text has size 0 and takes nothing; null source is a source of its own, last in order; rows
that repeat as a whole are documents of their own, drawn together; an empty table gives no rows; reruns agree. Other
columns are carried by repeat_rows and play no part. The document at which the budget ends is taken if at least half of
it is inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.llm.common import NOT_SPACE, SPACES, saved

RADIX, ROUNDS = 10, 3
CAP = 3


def quality_weight(text: Column, size: Column) -> Column:
    """Weight from 0.1 to 1: share of letters among the visible characters, less for texts of under 50 words."""
    visible = F.length(F.translate(text, SPACES, ""))
    symbols = visible - F.length(F.translate(text, SPACES + "#*$%&|<>0123456789!?=", ""))
    share = 1 - symbols / F.greatest(visible, F.lit(1))
    return F.greatest(F.lit(0.1), share * F.least(F.lit(1.0), (size + 10) / 60))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sizes: source, source_size, one row per source -> also target.

    The total is shared by weight, but none gets over CAP times its size. Filling by weight to a common level is the
    same as sharing the excess again and again: sources sorted by CAP * size / weight reach their cap in that order, and
    the level is that of the first prefix that leaves the next one below its own. The table has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("weight", pick).withColumn("cap", F.lit(float(CAP)) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    df = df.withColumn("level", left / open_weight)
    free = F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.select("source", "source_size", F.least("cap", F.coalesce(free * F.col("weight"), F.col("cap"))).alias("target"))


def prepared(docs: DataFrame, seed: int) -> DataFrame:
    """size, the integer rank of the sampling key (small for keys near 1), tie, sid, source, and ``row``: docs' columns as one struct."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce("row.text", F.lit(""))
    hashed = lambda k: F.xxhash64(F.lit(k), "row.doc_id", "row.text")
    df = df.withColumns({"size": F.regexp_count(text, F.lit(NOT_SPACE)).cast("long"), "u": (F.shiftrightunsigned(hashed(seed), 11) + 0.5) / float(1 << 53)})
    bits = RADIX * ROUNDS
    rank = F.least(F.floor(-F.expm1(F.log("u") / quality_weight(text, F.col("size"))) * float(1 << bits)), F.lit((1 << bits) - 1))
    return df.select("size", rank.cast("long").alias("rank"), hashed(seed + 1).alias("tie"), source_id(F.col("row.source")).alias("sid"), F.col("row.source").alias("source"), "row")


def source_id(source: Column) -> Column:
    """Text that stands for a source, null included."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def plan_mix(rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """rows: sid, source, size, rank, tie -> per source: source_size, target, epochs, and where the drawing ends.

    Drawn are ranks below ``end``, and at ``end`` ties up to ``tie_end``.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights).withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = saved(plan.withColumns({"sid": source_id(F.col("source")), "end": F.lit(0).cast("long"), "used": F.lit(0).cast("long")}), "plan")
    for k in range(ROUNDS):
        shift = RADIX * (ROUNDS - 1 - k)
        now = plan.select("sid", "end", "used", "rest")
        part = rows.select("sid", "size", "rank").join(now, "sid").filter(F.shiftright("rank", shift + RADIX) == F.shiftright("end", shift + RADIX))
        sums = part.groupBy("sid", "used", "rest", F.shiftright("rank", shift).alias("digit")).agg(F.sum("size").alias("words"))
        before = F.sum("words").over(Window.partitionBy("sid").orderBy("digit")) - F.col("words")
        over = sums.withColumn("before", F.col("used") + before).filter(F.col("before") + F.col("words") > F.col("rest"))
        ends = over.groupBy("sid").agg(F.min(F.struct("digit", "before")).alias("at"))
        end = F.coalesce(F.shiftleft(F.col("at.digit"), shift), F.when(F.lit(k > 0), F.col("end")), F.lit(1 << (RADIX * ROUNDS)))
        plan = plan.join(ends, "sid", "left").withColumns({"end": end, "used": F.coalesce("at.before", "used")}).drop("at")
        plan = saved(plan, "plan")
    tied = rows.join(plan.select("sid", "end", "used", "rest"), "sid").filter(F.col("rank") == F.col("end"))
    tied = tied.groupBy("sid", "used", "rest", "tie").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("sid").orderBy("tie")) - F.col("words")
    fits = tied.withColumn("fits", F.col("used") + before + F.col("words") / 2 <= F.col("rest")).filter("fits")
    return saved(plan.join(fits.groupBy("sid").agg(F.max("tie").alias("tie_end")), "sid", "left").drop("used", "rest"), "plan")


def is_drawn(rank: Column, tie: Column) -> Column:
    return (rank < F.col("end")) | ((rank == F.col("end")) & F.coalesce(tie <= F.col("tie_end"), F.lit(False)))


def keys_of(docs: DataFrame, seed: int) -> DataFrame:
    rows = prepared(docs.select("doc_id", "text", "source"), seed)
    return saved(rows.select("row.doc_id", "sid", "source", "size", "rank", "tie"), "keys")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, epochs, drawn and taken (words, repeats counted)."""
    rows = keys_of(docs, seed)
    df = rows.join(plan_mix(rows, weights).drop("source"), "sid").withColumn("drawn", (F.col("size") > 0) & is_drawn(F.col("rank"), F.col("tie")))
    taken = F.col("size") * (F.col("epochs") + F.col("drawn").cast("long"))
    return df.select("doc_id", "source", "size", "source_size", "target", "epochs", "drawn", taken.alias("taken"))


def repeat_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with all its columns; rows of size 0 aren't taken."""
    plan = plan_mix(keys_of(docs, seed), weights).select("sid", "epochs", "end", "tie_end")
    df = prepared(docs, seed).drop("source").join(plan, "sid")
    times = F.when(F.col("size") == 0, 0).otherwise(F.col("epochs") + is_drawn(F.col("rank"), F.col("tie")).cast("long")).cast("int")
    return df.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")
