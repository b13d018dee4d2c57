"""Exact dedup by an extendible-hash index kept in shared files.

Buckets are named by the first bits of a text's hash key. The directory starts with one bucket and doubles, one more bit
at a time, while a bucket holds more than ``capacity`` keys; buckets that hold few enough aren't split with the rest. It
may double until all 64 bits are used, so only keys that are equal stay together whatever their number.

The texts are dealt to owner tasks by bucket, which put them in the order of key and bytes. Texts of one key form its
chain: each is compared with the one before as bytes, and differing ones are further entries of the chain. So what is
equal, how large its group is and which row stays is decided inside of the bucket. Copies are pre-aggregated first, by
hash of their ids in ``LANES`` lanes, so a text with a third of all rows reaches its owner as a few rows. The index, an
entry for each different text, is written to the shared folder, and rows are looked up by bucket, key and sha256.

Defined cases: null text counts as empty; of equal texts the row with the largest doc_id stays, null ids being smallest;
rows that repeat as a whole are copies of each other, and distinct_rows keeps one of them (of rows with one id and text
that differ elsewhere, the one with the least hash of its columns); other columns play no part and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.llm.common import saved

CAPACITY, LANES = 1000, 16


def hash_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def leading_bits(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """((cell, bucket) for each cell of leading bits that has keys, and the number of these bits).

    keys: column key, one row per different key. A bucket is written as its depth and leading bits.
    """
    depth = max(0, (keys.count() // max(1, capacity)).bit_length() + 3)
    while True:
        cells = saved(keys.groupBy(leading_bits(F.col("key"), depth).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "cells")
        if depth >= 64 or cells.filter(F.col("n") > capacity).isEmpty():
            break
        depth = min(64, depth + 4)
    at = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("bits"))
    at = at.withColumn("prefix", F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftrightunsigned(cell, {depth} - bits)")))
    # a prefix with few enough keys needs no more bits; a cell's bucket is its shortest such prefix
    held = at.groupBy("bits", "prefix").agg(F.sum("n").alias("held")).filter((F.col("held") <= capacity) | (F.col("bits") == depth))
    found = at.join(held, ["bits", "prefix"]).groupBy("cell").agg(F.min(F.struct("bits", "prefix")).alias("b"))
    return saved(found.select("cell", F.concat_ws(":", "b.bits", "b.prefix").alias("bucket")), "directory"), depth


def small_side(table: DataFrame, most: int = 500_000) -> DataFrame:
    """A written table of numbers and short names, broadcast up to ``most`` rows; a larger one is joined by shuffle."""
    return F.broadcast(table) if table.count() <= most else table


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, int]:
    """The index as a table in the shared folder (bucket, key, chain, text_sha256, group_size, keep_id), its directory and depth."""
    rows = docs.select(hash_key(F.col("text")).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"), "doc_id")
    cells, depth = directory(saved(rows.select("key").distinct(), "keys"), capacity)
    lane = F.pmod(F.xxhash64("doc_id"), F.lit(LANES))
    few = rows.groupBy("key", "text", lane.alias("lane")).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("most"))
    owned = few.withColumn("cell", leading_bits(F.col("key"), depth)).join(small_side(cells), "cell").repartition("bucket")
    # equal bytes share a place in the chain of their key; both steps stay in the owner's task
    chain = F.dense_rank().over(Window.partitionBy("bucket", "key").orderBy("text"))
    entries = owned.select("bucket", "key", "n", "most", F.sha2("text", 256).alias("text_sha256"), chain.alias("chain"))
    index = entries.groupBy("bucket", "key", "chain").agg(F.min("text_sha256").alias("text_sha256"), F.sum("n").alias("group_size"), F.max("most").alias("keep_id"))
    return saved(index, "index"), cells, depth


def looked_up(rows: DataFrame, capacity: int) -> DataFrame:
    """rows, a struct ``row`` with doc_id and text, with the entries of their texts."""
    text = F.col("row.text")
    index, cells, depth = build_index(rows.select("row.doc_id", "row.text"), capacity)
    key = hash_key(text)
    asked = rows.withColumns({"key": key, "cell": leading_bits(key, depth), "text_sha256": F.sha2(F.coalesce(text, F.lit("")), 256)})
    return asked.join(small_side(cells), "cell").join(index, ["bucket", "key", "text_sha256"])


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and the bucket and chain of its entry."""
    found = looked_up(docs.select(F.struct("doc_id", "text").alias("row")), capacity)
    return found.select("row.doc_id", "keep_id", "group_size", F.col("row.doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "chain")


def distinct_rows(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row of docs for each different text, the one that exact_duplicates keeps, with all columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = looked_up(rows, capacity).filter(F.col("row.doc_id").eqNullSafe(F.col("keep_id")))
    # rows with one id and text may repeat; single ones need no further step
    single = kept.filter("group_size = 1").select("row")
    again = kept.filter("group_size > 1").withColumn("hash", F.sha2(F.to_json("row"), 256))
    again = again.groupBy("bucket", "key", "chain").agg(F.min_by("row", "hash").alias("row")).select("row")
    return single.unionByName(again).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
