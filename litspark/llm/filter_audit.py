"""How filters interact: what each one removes, and what it would have removed, in every order of application.

Each document is reduced to the mask of the filters that it fails, and masks are counted by part, with those of good and
of toxic label. The rest needs only these counts. Let M (mask x filter) hold 0 where a mask fails a filter and infinity
elsewhere, and P (filter x order) the place of a filter in an order, the inverse of the permutation. Their min-plus
product R = min_f(M + P) is the step at which a mask is removed. Scattering the counts of a part to the steps in R gives
what each step removes; where R is less than the place of a filter that the mask fails, that filter was redundant.

A document whose text is that of a document with a smaller id is found by the least id of each text's SHA-256, so that a
large group of copies is reduced before it is shuffled; small rows (id, digest, mask) are joined with that on digest and
id, so no task gets a group. The counts are at most 32 rows a part, of any number of parts.

Defined cases: null text counts as empty; null source is the part of the empty name; a null id has no label, is never
a copy and makes nothing one; rows with one id and text are no copies of each other; of several labels of an id the
largest of each kind counts; an empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.llm.common import let, saved, word_array

FILTERS = "ABCDE"
FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails, A the lowest."""
    few = lambda n, d: F.struct((n < 50).alias("a"), (100 * d < 65 * n).alias("b"))
    words = let(word_array(text), lambda w: few(F.size(w).cast("long"), F.size(F.array_distinct(w)).cast("long")))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [words["a"], words["b"], 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents counted by part, mask, good and toxic: columns part, mask, n, good, toxic (counts)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"))
    rows = saved(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "masks")
    first = saved(rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True)), "firsts")
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    own = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).alias("salt"))
    df = rows.join(first, ["doc_id", "digest"], "left").withColumn("own", own)
    known = known.select(F.struct("doc_id", F.lit(None).cast("long").alias("salt")).alias("own"), "good", "toxic")
    df = df.join(known, "own", "left")  # a struct with nulls inside isn't null, so rows without an id are dealt too
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    mask = F.col("mask") + F.when(copy, 16).otherwise(0)
    count = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0))
    return df.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))


def removal_steps(n: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray]:
    """All orders of n filters; fails (mask x filter); places (order x filter, from 1); removal step (mask x order, n + 1 if kept)."""
    orders = list(permutations(range(n)))
    fails = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1 == 1
    places = np.argsort(np.array(orders), axis=1) + 1
    never = n + 1
    steps = np.minimum((np.where(fails, 0, never)[:, None, :] + places[None, :, :]).min(axis=2), never)
    return orders, fails, places, steps


def interactions(counts: np.ndarray, good: np.ndarray, toxic: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Counts (part x mask) -> for each field a table part x order x step; the filter of a step is that of the order."""
    orders, fails, places, steps = removal_steps(n)
    at, parts = np.arange(len(orders)), len(counts)

    def scattered(weights: np.ndarray) -> np.ndarray:
        out = np.zeros((parts, len(orders), n + 2), np.int64)
        for mask in range(1 << n):
            out[:, at, steps[mask]] += weights[:, mask, None]
        return out[:, :, 1 : n + 1]

    removed = scattered(counts)
    redundant = np.zeros_like(removed)
    for mask, f in zip(*np.nonzero(fails), strict=True):
        late = at[steps[mask] < places[:, f]]
        redundant[:, late, places[late, f] - 1] += counts[:, mask, None]
    by_filter = np.array(orders)
    alone = counts[:, 1 << by_filter]
    shapley = np.zeros((parts, n), np.int64)
    for step in range(n):
        np.add.at(shapley, (slice(None), by_filter[:, step]), removed[:, :, step])
    kept = counts.sum(axis=1)[:, None, None] - np.cumsum(removed, axis=2)
    return dict(zip(FIELDS, (kept, removed, redundant, alone, scattered(good), scattered(toxic), shapley[:, by_filter]), strict=True))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, with the counts of FIELDS."""
    n = len(FILTERS)
    by_part = masks(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))  # at most 2 ** n
    names = ["".join(FILTERS[f] for f in o) for o in permutations(range(n))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                part = batch.slice(begin, 100)
                table = np.zeros((3, part.num_rows, 1 << n), np.int64)
                for i, rows in enumerate(part.column("rows").to_pylist()):
                    for r in rows:
                        table[:, i, r["mask"]] = r["n"], r["good"], r["toxic"]
                found = interactions(*table, n)
                each = len(names) * n
                arrays = [part.column("part").take(pa.array(np.repeat(np.arange(part.num_rows), each)))]
                arrays += [pa.array(np.tile(np.repeat(names, n), part.num_rows).tolist()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), part.num_rows * len(names)))]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(found[f].ravel()) for f in FIELDS], names=["part", "filter_order", "step", *FIELDS])

    return by_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{f} bigint" for f in FIELDS))


#: The same question in DuckDB.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
firsts AS (SELECT x, min(doc_id) AS first_id FROM t GROUP BY x),
known AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
w AS (SELECT t.*, string_split_regex(x, '[\x20\x09-\x0D]+') AS ws FROM t),
v AS (SELECT *, list_filter(ws, lambda y: y <> '') AS words FROM w),
d AS (
  SELECT v.part, coalesce(k.good, false) AS good, coalesce(k.toxic, false) AS toxic,
    [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
     100 * length(regexp_replace(v.x, '[^A-Z]', '', 'g')) > 5 * length(v.x),
     regexp_matches(v.x, '[#$%&*|]'), coalesce(v.doc_id > f.first_id, false)] AS fails
  FROM v JOIN firsts f ON f.x = v.x LEFT JOIN known k ON k.doc_id = v.doc_id
),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS seq
  FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
),
s AS (SELECT filter_order, seq, unnest([1, 2, 3, 4, 5]) AS step FROM o),
r AS (
  SELECT part, filter_order, step, seq[step] AS f,
    sum(n) FILTER (NOT list_contains(list_transform(seq[1:step], lambda q: fails[q]), true)) AS kept,
    sum(n) FILTER (fails[seq[step]] AND NOT list_contains(list_transform(seq[1:step - 1], lambda q: fails[q]), true)) AS removed,
    sum(n) FILTER (fails[seq[step]] AND list_contains(list_transform(seq[1:step - 1], lambda q: fails[q]), true)) AS redundant,
    sum(n) FILTER (fails[seq[step]] AND len(list_filter(fails, lambda q: q)) = 1) AS unique_fails,
    sum(good) FILTER (fails[seq[step]] AND NOT list_contains(list_transform(seq[1:step - 1], lambda q: fails[q]), true)) AS good_lost,
    sum(toxic) FILTER (fails[seq[step]] AND NOT list_contains(list_transform(seq[1:step - 1], lambda q: fails[q]), true)) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM r
"""
