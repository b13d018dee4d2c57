"""MinHash near-dedup by an inverted join on signature coordinates.

Documents are sets of word shingles. Equal sets are one class, found by a 128-bit digest, so exact copies and repeated
rows are one row from then on. Each class has a signature of ``COORDS`` minima. It is posted under each pair of coordinate and
value; a pair of classes is a candidate if it collides in ``MATCHES`` coordinates or more. A pair of similarity 0.8, whose
collisions are binomial of 64 and 0.8, misses that with a probability of 3.2e-7; more similar ones miss it less.

Prefix merging: a class whose postings of at least two classes number m can only reach MATCHES with another one if they
meet in its m - MATCHES + 1 rarest postings, so only those are merged; single postings and classes with too few are
skipped. Skip merging: classes already known to be connected are not compared again. First each class is compared with
the leader of one of its postings, then with the leaders of all; verified links join classes into components. What is
left are components that meet in postings. There all members outside of the largest one are compared with all members of
other components, in blocks of classes held by one task, so no link between components is lost, while a large group of
near copies costs a few rows for each member and none for each pair. Candidates are confirmed on their full sets.

Defined cases: null and empty texts and those without words have empty sets, are linked with nothing and stay; null
doc_ids never are component ids unless all of a component are null; rows with one doc_id are rows of their own;
other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.llm.common import saved
from litspark.llm.shingles import mixed, shingle_set

COORDS, MATCHES = 64, 34
_rng = np.random.default_rng(20240607)
FACTORS = _rng.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 2**63, COORDS, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """For each coordinate the least value of its own hash over the set, as int32.

    Of the least value the low half is kept: the high half of a least value of many is near 0 and tells sets apart less.
    """
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        low = np.minimum(low, mixed_rows(hashes[i : i + 2048]).min(axis=0))
    return (low & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def mixed_rows(h: np.ndarray) -> np.ndarray:
    x = h[:, None] * FACTORS + SHIFTS
    return x ^ (x >> np.uint64(32)) * np.uint64(0x9E3779B9)


def describe(docs: DataFrame, width: int) -> DataFrame:
    """Of each row: doc_id, row_key, n_shingles, digest of the set and signature (both null for empty sets)."""
    rows = docs.select("doc_id", "text", row_key().alias("row_key"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signs = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py() or "", width)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.list_(pa.int32()))],
                names=["doc_id", "row_key", "n_shingles", "digest", "sign"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, row_key bigint, n_shingles bigint, digest binary, sign array<int>")


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def prefixes(classes: DataFrame) -> DataFrame:
    """(coord, value, id): the postings of each class that have to be merged."""
    posts = classes.select("id", F.posexplode("sign").alias("coord", "value"))
    shared = posts.groupBy("coord", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = posts.join(shared, ["coord", "value"])
    # at most COORDS rows for each class
    rank = F.row_number().over(Window.partitionBy("id").orderBy("n", "coord"))
    met = met.withColumns({"rank": rank, "m": F.count(F.lit(1)).over(Window.partitionBy("id"))})
    return met.filter(F.col("rank") <= F.col("m") - MATCHES + 1).select("coord", "value", "id")


def agreeing(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))


def alike(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the candidate pairs a, b those that collide often enough and whose full sets are similar enough."""
    small = classes.select("id", "sign", "n_shingles")
    side = lambda c: small.select(F.col("id").alias(c), F.col("sign").alias(f"sign_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    size_ok = (100 * F.least("n_a", "n_b")) >= percent * F.greatest("n_a", "n_b")
    met = met.filter(size_ok & (agreeing(F.col("sign_a"), F.col("sign_b")) >= MATCHES)).select("a", "b")
    whole = lambda c: sets.select(F.col("id").alias(c), F.col("hashes").alias(f"set_{c}"))
    met = met.join(whole("a"), "a").join(whole("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                keep.append(similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, "a binary, b binary")


def shingle_tables(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, hashes): the full sets of the wanted classes, each from one of its rows."""
    rows = classes.join(wanted, "id", "left_semi").select("id", "row_key")
    texts = docs.select(row_key().alias("row_key"), "text")
    met = rows.join(texts, "row_key").dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or "", width).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "hashes"])

    return met.select("id", "text").mapInArrow(run, "id binary, hashes binary")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): of each end of an edge the least id that it is connected with, by least labels and pointer jumping.

    Labels only fall, so the rounds end; there are about as many as the logarithm of the longest path.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    nodes = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("comp")), "labels")
    while True:
        heard = both.join(nodes, both["a"] == nodes["id"]).groupBy(F.col("b").alias("id")).agg(F.min("comp").alias("heard"))
        near = nodes.join(heard, "id").select("id", F.col("comp").alias("old"), F.least("comp", "heard").alias("comp"))
        far = nodes.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        nodes = saved(near.join(far, "comp").select("id", "old", F.least("comp", "far").alias("comp")), "labels")
        if nodes.filter("comp <> old").isEmpty():
            return nodes.select("id", "comp")
        nodes = nodes.select("id", "comp")


def leaders(posts: DataFrame, one: bool) -> DataFrame:
    """Pairs of each posted class with the least one of its posting, if it is of another component; one for each class or all."""
    lead = posts.groupBy("coord", "value").agg(F.min("id").alias("lead"), F.min_by("comp", "id").alias("lead_comp"), F.max("comp").alias("top"), F.min("comp").alias("low"))
    pairs = posts.join(lead.filter("top <> low"), ["coord", "value"]).filter("comp <> lead_comp")
    if one:
        return pairs.groupBy(F.col("id").alias("b")).agg(F.min("lead").alias("a")).select("a", "b")
    return pairs.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()


MINOR_BLOCK, WHOLE_BLOCK = 256, 1024


def clusters(posts: DataFrame) -> DataFrame:
    """(id, comp, cluster): posted classes of components that meet others in a posting, by what is connected that way."""
    met = posts.groupBy("coord", "value", "comp").agg(F.first("comp").alias("c"))
    lead = met.groupBy("coord", "value").agg(F.min("comp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("coord", "value", "a")
    pairs = met.join(lead, ["coord", "value"]).filter("comp <> a").select("a", F.col("comp").alias("b")).distinct()
    named = components(saved(pairs, "meetings")).select(F.col("id").alias("comp"), F.col("comp").alias("cluster"))
    return posts.select("id", "comp").distinct().join(named, "comp")


def crossing(posts: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components, enough to connect all that are linked.

    In each cluster the classes outside of its largest component are compared with all classes of other components, in
    blocks: a task holds MINOR_BLOCK of the former and WHOLE_BLOCK of the latter with their signatures and sets, counts
    collisions for all at once, and confirms pairs with enough of them whose ends aren't connected yet. Rows are one for
    each class and block, not for each pair.
    """
    here = saved(clusters(posts), "clusters")
    size = here.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
    plan = size.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most"))
    plan = saved(plan.withColumns({"minors": F.ceil((F.col("n") - F.col("most")) / MINOR_BLOCK), "wholes": F.ceil(F.col("n") / WHOLE_BLOCK)}), "blocks")
    rows = here.join(plan, "cluster").withColumn("minor", F.col("comp") != F.col("largest"))
    rows = rows.withColumns({"i": F.pmod(F.xxhash64("id"), F.col("minors")), "j": F.pmod(F.xxhash64(F.lit(1), "id"), F.col("wholes"))})
    payload = rows.select("id", "comp", "cluster", "minor", "i", "j", "minors", "wholes")
    left = payload.filter("minor").select("id", "comp", "cluster", F.lit(True).alias("probe"), "i", F.explode(F.sequence(F.lit(0), F.col("wholes") - 1)).alias("j"))
    right = payload.select("id", "comp", "cluster", F.lit(False).alias("probe"), F.explode(F.sequence(F.lit(0), F.col("minors") - 1)).alias("i"), "j")
    dealt = left.unionByName(right).join(classes.select("id", "sign"), "id").join(sets, "id")

    def run(table: pa.Table) -> pa.Table:
        ids, comps, sides = (table.column(c).to_pylist() for c in ("id", "comp", "probe"))
        signs = np.array(table.column("sign").to_pylist(), np.int32)
        probe, whole = np.flatnonzero(sides), np.flatnonzero(~np.array(sides))
        held = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
        up: dict[bytes, bytes] = {}

        def top(c: bytes) -> bytes:
            while up.get(c, c) != c:
                c = up[c]
            return c

        found = []
        for x in probe:
            hits = (signs[whole] == signs[x]).sum(axis=1)
            order = np.argsort(-hits, kind="stable")
            for y in whole[order[hits[order] >= MATCHES]]:
                p, q = top(comps[x]), top(comps[y])
                if p != q and similar(held[x], held[y], percent):
                    up[p] = q
                    found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(run, "a binary, b binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough, exactly."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, row_key (hash of id and text), n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    rows = saved(describe(docs, width), "shingles")
    full = rows.filter("digest IS NOT NULL")
    classes = full.groupBy(F.col("digest").alias("id")).agg(F.min_by(F.struct("row_key", "n_shingles", "sign"), "row_key").alias("r"), F.min("doc_id").alias("least"))
    classes = saved(classes.select("id", "least", "r.*"), "classes")
    posts = saved(prefixes(classes), "postings")
    sets = saved(shingle_tables(docs, classes, posts.select("id").distinct(), width), "sets")

    edges, comps = None, None
    for find in (lambda p: alike(leaders(p, True), classes, sets, percent), lambda p: alike(leaders(p, False), classes, sets, percent), lambda p: crossing(p, classes, sets, percent)):
        now = posts.withColumn("comp", F.col("id")) if comps is None else posts.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        found = saved(find(now), "links")
        edges = found if edges is None else saved(edges.unionByName(found), "links")
        comps = components(edges)

    named = classes.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_class = named.join(names, "comp").select(F.col("id").alias("digest"), "component_id")
    out = rows.select("doc_id", "row_key", "n_shingles", "digest").join(by_class, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "row_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def distinct_documents(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """The rows of docs that are kept, with all columns: one of each group, if exact copies are gone before.

    Rows without an id can't be told from each other by it and stay.
    """
    gone = near_duplicates(docs, width, percent).filter("NOT kept").select("row_key", "doc_id")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key().alias("row_key"), "doc_id")
    return rows.join(gone, ["row_key", "doc_id"], "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
