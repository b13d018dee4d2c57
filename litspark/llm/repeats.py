"""Removal of repeated passages by suffix arrays.

Every byte is removed that a string of ``width`` bytes covers which also starts anywhere else.

Which strings can be equal is known from their minimizers: the least hash among the grams of ``GRAM`` bytes in a window of
``width``. Equal windows have equal minimizers in equal places, so only windows whose minimizer occurs twice need to be
compared; as a gram is half as long as a window, frequent short lines seldom are one. Consecutive windows with one
minimizer are one run, about fifty windows. Copies of a whole text are told by its sha256; in them every window is
repeated. Equal runs are found by grouping, and one of each stays. What is left are different runs with a shared
minimizer, as at the ends of repeated passages. They are dealt to shards by minimizer. Each shard builds the suffix array
of its runs by Larsson-Sadakane refinement and the common prefixes by Kasai's rule; a window is repeated if a neighbour
in the array shares ``width`` bytes.

A minimizer with more than ``SHARD_RUNS`` different runs, as of a very frequent passage, is spread over several shards.
Each of them hands on its sorted list of the fingerprints of its different windows, cut into ranges; the owner of a range
merges the shards' lists by binary search.

Memory of a task is bounded by a shard and by slices of texts; texts over ``SLICE`` bytes are cut into slices that share
width - 1 bytes. Runs of one minimizer are compared by 64 bits of hash, windows of different shards by 128, windows of one
shard as bytes.

Defined cases: null counts as empty; texts of under ``width`` bytes have nothing removed; repeated rows are other
occurrences of each other; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.llm.common import saved
from litspark.llm.shingles import BASE, mixed, powers
from litspark.llm.suffix import common_prefixes, suffix_array

GRAM = 100
SLICE = 1 << 20
SHARD_RUNS = 2500
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_inverse = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        _inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 2 * len(_inverse)), INVERSE, np.uint64))])
    return _inverse[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which the polynomial hash of any range follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * inverse_powers(len(sums))[start] + (end - start).astype(np.uint64))


def window_runs(data: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: first window, number of windows, hash of the minimizer, hash of the run."""
    sums = prefix_sums(data)
    grams = len(data) - GRAM + 1
    hashes = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse_powers(grams))
    at = np.arange(grams, dtype=np.uint64)
    low = (hashes & np.uint64(0xFFFFFFFFFF000000)) | at
    span, have = width - GRAM + 1, 1
    while have < span:  # the least of have grams from each place on
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    count = np.diff(first, append=len(low))
    gram = hashes[(low[first] & np.uint64(0xFFFFFF)).astype(np.int64)]
    return first, count, gram, range_hash(sums, first, first + count + width - 1)


def text_key() -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))


def list_runs(docs: DataFrame, width: int) -> DataFrame:
    """Of each row: doc_id, tid (128 bits of sha256 of the text), and the arrays first, count, gram, digest of its runs."""
    rows = docs.select("doc_id", text_key().alias("tid"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def of_text(data: bytes) -> list[np.ndarray]:
        found = []
        for base in range(0, max(1, len(data) - width + 1), SLICE):
            part = np.frombuffer(data, np.uint8)[base : base + SLICE + width - 1]
            if len(part) >= width:
                first, count, gram, digest = window_runs(part, width)
                found.append((first + base, count, gram, digest))
        if not found:
            return [np.zeros(0, np.int64)] * 4
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [of_text(x.as_py()) for x in batch.column("data")]
            offsets = np.concatenate([[0], np.cumsum([len(x[0]) for x in each])]).astype(np.int32)
            arrays = [np.concatenate([x[i] for x in each] or [np.zeros(0, np.int64)]) for i in range(4)]
            types = [np.int32, np.int32, np.uint64, np.uint64]
            values = [a.astype(t).view(np.int32 if t is np.int32 else np.int64) for a, t in zip(arrays, types, strict=True)]
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in values]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), *lists], names=["doc_id", "tid", "first", "count", "gram", "digest"])

    return rows.mapInArrow(run, f"doc_id {kind}, tid binary, first array<int>, count array<int>, gram array<bigint>, digest array<bigint>")


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, tid and the text compressed, to be joined by tid."""
    rows = docs.select("doc_id", text_key().alias("tid"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = pa.array([press.compress(x.as_py()) for x in batch.column("data")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), packed], names=["doc_id", "tid", "packed"])

    return rows.mapInArrow(run, f"doc_id {kind}, tid binary, packed binary")


def unpacked(column: pa.Array) -> Iterator[bytes]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    for x in column:
        data = x.as_py()
        yield press.decompress(data) if data else b""


PIECE = "tid binary, first int, count int, gram bigint, digest bigint, runs bigint, data binary"
SPANS = "tid binary, start int, stop int"
#: a window in a list that a shard hands on: fingerprint, the two halves of its text's key, place
PRINT = np.dtype([("x", "<i8"), ("y", "<i8"), ("t0", "<u8"), ("t1", "<u8"), ("start", "<i4")])


def cut_pieces(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Bytes of the wanted runs (tid, first, count, gram, digest, runs)."""
    lists = wanted.groupBy("tid").agg(F.collect_list(F.struct("first", "count", "gram", "digest", "runs")).alias("list"))  # runs of one text
    # copies of a text are one row for each task before they are dealt
    met = texts.groupBy("tid").agg(F.first("packed").alias("packed")).join(lists, "tid").select("tid", "packed", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, data, items in zip(batch.column("tid").to_pylist(), unpacked(batch.column("packed")), batch.column("list").to_pylist(), strict=True):
                for i in range(0, len(items), 5000):
                    part = items[i : i + 5000]
                    columns = [pa.array([tid] * len(part), pa.binary())]
                    columns += [pa.array([x[c] for x in part], t) for c, t in (("first", pa.int32()), ("count", pa.int32()), ("gram", pa.int64()), ("digest", pa.int64()), ("runs", pa.int64()))]
                    columns.append(pa.array([data[x["first"] : x["first"] + x["count"] + width - 1] for x in part], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=["tid", "first", "count", "gram", "digest", "runs", "data"])

    return met.mapInArrow(run, PIECE)


def spans_of(flags: np.ndarray, piece: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged windows: piece, first and last place."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.concatenate([[True], (np.diff(at) != 1) | (piece[at[1:]] != piece[at[:-1]])])
    ends = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])
    return piece[at[new]], place[at[new]], place[at[ends]]


def resolve_shards(pieces: DataFrame, width: int, n_shards: int) -> DataFrame:
    """Spans of windows that are repeated within a shard (tid, start, stop), and of minimizers in several shards lists of window fingerprints (gram, range, prints)."""
    salt = F.when(F.col("runs") > SHARD_RUNS, F.pmod(F.xxhash64("digest"), F.ceil(F.col("runs") / SHARD_RUNS))).otherwise(F.lit(0))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("gram", salt), F.lit(n_shards)))

    def run(table: pa.Table) -> pa.Table:
        rows = [x.as_py() for x in table.column("data")]
        data = np.frombuffer(b"".join(rows), np.uint8)
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        first = np.cumsum(size) - size
        piece = np.repeat(np.arange(len(rows)), size)
        end = np.repeat(first + size, size)
        sa, packed = suffix_array(data, end)
        lcp = common_prefixes(sa, packed, first, end)
        near = np.zeros(len(data), bool)
        near[sa] = (lcp >= width) | np.concatenate([lcp[1:] >= width, [False]])
        place = np.arange(len(data)) - first[piece]
        p, a, b = spans_of(near, piece, place)
        start = table.column("first").to_numpy()
        tids = table.column("tid").to_pylist()
        spans = pa.table({"tid": pa.array([tids[i] for i in p], pa.binary()), "start": pa.array(start[p] + a, pa.int32()), "stop": pa.array(start[p] + b + width, pa.int32())})
        lists: list[tuple[int, int, bytes]] = []
        runs, gram = table.column("runs").to_numpy(), table.column("gram").to_numpy()
        if (wide := runs > SHARD_RUNS).any():  # one of each different window
            window = wide[piece] & (np.arange(len(data)) + width <= end)
            lead = np.concatenate([[True], lcp[1:] < width])
            chosen = sa[lead & window[sa]]
            q = piece[chosen]
            found = np.empty(len(chosen), PRINT)
            found["x"], found["y"] = fingerprints(data, chosen, width)
            keys = np.frombuffer(b"".join(tids), "<u8").reshape(-1, 2)
            found["t0"], found["t1"], found["start"] = keys[q, 0], keys[q, 1], start[q] + place[chosen]
            ranges = -(-runs // SHARD_RUNS)
            part = (found["x"].view(np.uint64) >> np.uint64(32)).astype(np.int64) * ranges[q] >> 32
            order = np.lexsort((found["y"], found["x"].view(np.uint64), part, gram[q]))
            found, part, g = found[order], part[order], gram[q][order]
            cuts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (g[1:] != g[:-1])]))
            lists = [(int(g[i]), int(part[i]), found[i:j].tobytes()) for i, j in zip(cuts, [*cuts[1:], len(found)], strict=True)]
        prints = pa.table({"gram": pa.array([x[0] for x in lists], pa.int64()), "range": pa.array([x[1] for x in lists], pa.int64()), "prints": pa.array([x[2] for x in lists], pa.binary())})
        return pa.concat_tables([spans, prints], promote_options="default").select(["tid", "start", "stop", "gram", "range", "prints"])

    return dealt.groupBy("shard").applyInArrow(run, f"{SPANS}, gram bigint, range bigint, prints binary")


def fingerprints(data: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of the windows from each start on."""
    x = range_hash(prefix_sums(data), start, start + width)
    y = range_hash(prefix_sums(mixed(data.astype(np.uint64) + BASE).astype(np.uint8)), start, start + width)
    return x.view(np.int64), y.view(np.int64)


def merge_shards(lists: DataFrame, width: int) -> DataFrame:
    """Spans of the windows that are in the lists of two shards, found in the merged order by binary search."""

    def run(table: pa.Table) -> pa.Table:
        each = [np.frombuffer(x.as_py(), PRINT) for x in table.column("prints")]
        found = np.concatenate(each)
        # lists are in the order of x as unsigned number; a stable sort merges them
        x = found["x"].view(np.uint64)
        order = np.argsort(x, kind="stable")
        found, x = found[order], x[order]
        low, high = np.searchsorted(x, x, "left"), np.searchsorted(x, x, "right")
        twice = high - low == 2
        twice &= found["y"][low] == found["y"][np.maximum(high - 1, 0)]
        for i in np.flatnonzero(high - low > 2):
            twice[i] = (found["y"][low[i] : high[i]] == found["y"][i]).sum() > 1
        chosen = found[twice]
        tids = np.ascontiguousarray(np.stack([chosen["t0"], chosen["t1"]], axis=1)).tobytes()
        start = chosen["start"].astype(np.int32)
        return pa.table({"tid": pa.array([tids[i : i + 16] for i in range(0, len(tids), 16)], pa.binary()), "start": pa.array(start), "stop": pa.array(start + np.int32(width))})

    return lists.groupBy("gram", "range").applyInArrow(run, SPANS)


def joined(spans: list[dict] | None, size: int, copied: bool, width: int) -> list[tuple[int, int]]:
    """The repeated parts of a text of size bytes as spans that don't touch, in order."""
    if copied and size >= width:
        return [(0, size)]
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(tid, copied, spans) of the texts with repeated parts, and doc_id, tid and packed text of all rows.

    Spans may overlap; copied tells that the text is that of several rows.
    """
    texts = saved(packed_texts(docs), "texts")
    rows = saved(list_runs(docs, width), "runs")
    copies = saved(rows.groupBy("tid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("tid"), "copies")
    runs = rows.select("tid", F.explode(F.arrays_zip("first", "count", "gram", "digest")).alias("r")).select("tid", "r.*")
    # written, so that the join deals both sides and Spark can split a frequent minimizer's rows
    shared = saved(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "shared_grams")
    runs = saved(runs.join(shared, "gram"), "shared_runs")
    kinds = saved(runs.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tid", "first", "count")).alias("one")), "kinds")
    rivals = saved(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("runs")).filter("runs > 1"), "rivals")
    whole = runs.join(kinds.filter("n > 1").select("gram", "digest"), ["gram", "digest"]).select("tid", F.col("first").alias("start"), (F.col("first") + F.col("count") + width - 1).alias("stop")).distinct()
    wanted = kinds.join(rivals, "gram").select("one.*", "gram", "digest", "runs")
    pieces = saved(cut_pieces(texts, wanted, width), "pieces")
    n_shards = max(1, pieces.count() // SHARD_RUNS)
    resolved = saved(resolve_shards(pieces, width, n_shards), "resolved")
    merged = merge_shards(resolved.filter("prints IS NOT NULL").select("gram", "range", "prints"), width)
    spans = whole.unionByName(resolved.filter("tid IS NOT NULL").select("tid", "start", "stop")).unionByName(merged)
    spans = spans.join(copies, "tid", "left_anti").groupBy("tid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # those of one text
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    return saved(spans.select("tid", F.lit(False).alias("copied"), "spans").unionByName(copies.select("tid", F.lit(True).alias("copied"), none.alias("spans"))), "spans"), texts


def without_repeats(docs: DataFrame, width: int = 200) -> DataFrame:
    """One row per row of docs: doc_id, spans (removed), and kept, the remaining bytes."""
    docs = docs.select("doc_id", "text")
    spans, texts = repeated_spans(docs, width)
    met = texts.join(spans, "tid", "left").select("doc_id", "packed", "copied", "spans")
    kind = met.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for data, copied, spans in zip(unpacked(batch.column("packed")), batch.column("copied").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                found = joined(spans, len(data), bool(copied), width)
                parts, at = [], 0
                for a, b in found:
                    parts.append(data[at:a])
                    at = b
                kept.append(b"".join([*parts, data[at:]]))
                removed.append([{"start": a, "stop": b} for a, b in found])
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(removed, kinds), pa.array(kept, pa.binary())], names=["doc_id", "spans", "kept"])

    return met.mapInArrow(run, f"doc_id {kind}, spans array<struct<start:int,stop:int>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    """without_repeats' result as counts and the hash of the remaining bytes."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", (F.length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
