"""The prefix trie of rebuilt conversations, summed up by time-forward processing.

Every conversation c starts with the first turns of conversation c - c % 20, as many as a checksum of c says, and goes
on with its own turns after as many. A node of the trie is a distinct sequence of first turns.

*Names.* A node's key is its turns as digits (SHA-256 of role and text, mod P) of a number to the base B, mod the prime
P = 2 ** 127 - 1. Such numbers can be continued from anywhere, so turns are dealt to tasks by ranges of (conversation,
turn), and where a conversation goes over several tasks, the last number of one is carried to the next. Exchanging
the first turns of a conversation is one addition. Keys of different sequences of up to n turns agree with a
probability of about n / 2 ** 127.

*Shards.* The weight of a node is the number of turns, repeats counted, in its subtree. A node of class k has a weight
over SHARD ** (k - 1) and up to SHARD ** k; its shard is the topmost node of the class or below it on its path. So a
shard has at most SHARD nodes for each level of depth, and the number of classes is the logarithm of the input to the
base SHARD.

*Totals.* Classes are worked off from the lightest. Inside a shard, nodes come sorted by falling depth and key (Spark's
external sort); each takes the messages of its children from a priority queue, which is ordered alike and goes to sorted runs in
files when it outgrows its room, adds its own, and sends the sum to its parent in the same queue. The sums at the tops
of shards are added up by parent, partly before the shuffle, and wait for the class of the parent.

*Members that end at a node* are sorted by ranges of (node, conversation), joined to pieces of bounded length by each
task, and the pieces of a node go through SHA-256 in order as a stream.

Defined cases: null role or text counts as empty; turns go by number, null first, equal numbers by the digest of role
and text; repeated rows are turns of their own; rows without conv_id are left out; the quotient of a negative c is taken
toward zero; an empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush, merge

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.llm.common import NOT_SPACE, saved

P, B = (1 << 127) - 1, 0x5BD1E995_9E3779B9_7F4A7C15_F39CC060
UNBASE = pow(B, -1, P)
SHARD = 1024
PIECE = 4096
GROUP, MOST = 20, 4
ROOT = bytes(16)


def num(key: bytes) -> int:
    return int.from_bytes(key, "big")


def key_of(n: int) -> bytes:
    return (n % P).to_bytes(16, "big")


@cache
def small_power(n: int) -> int:
    return pow(B, n, P)


def power(n: int) -> int:
    return small_power(n) if n < 4096 else pow(B, n, P)


def mapped(df: DataFrame, schema: str, rows) -> DataFrame:
    """df through rows, a function from an iterator of rows (tuples in df's order) to one of tuples of schema."""
    names, types = zip(*(f.split(" ") for f in schema.split(", ")), strict=True)
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    kinds = [arrow[t] for t in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=list(names))
            held.clear()
            return batch

        for row in rows(each):
            held.append(row)
            if len(held) == 8192:
                yield out()
        if held:
            yield out()

    return df.mapInArrow(run, schema)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv, turn, digit (16 bytes), words and a number of the row, which keeps repeated rows divisible."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    df = conversations.filter("conv_id is not null")
    df = df.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digit"), F.regexp_count(text, F.lit(NOT_SPACE)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))
    return saved(df, "turns")


def numbered(turns: DataFrame) -> DataFrame:
    """conv, at (place from 1), key of the conversation's own first ``at`` turns, digit, words."""
    order = ["conv", F.col("turn").asc_nulls_first(), "digit", "row"]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digit", "words")

    def local(rows):
        task, conv, first = TaskContext.get().partitionId(), None, None
        held: tuple | None = None
        for c, digit, words in rows:
            if c != conv:
                if held:
                    yield (*held, conv == first)
                first = c if first is None else first
                conv, at, key = c, 0, 0
            elif held:
                yield (*held, False)
            at, key = at + 1, (key * B + num(digit)) % P
            held = task, c, at, key_of(key), digit, words
        if held:
            yield (*held, True)

    df = saved(mapped(dealt, "task bigint, conv bigint, at bigint, key binary, digit binary, words bigint, edge boolean", local), "local")
    # The last rows of a task's first and last conversation hold what these sum up to: two rows a task at most.
    ends = df.filter("edge").select("conv", "task", "at", "key")

    def carried(rows):
        conv, at, key = None, 0, 0
        for c, task, n, k in rows:
            if c != conv:
                conv, at, key = c, 0, 0
            elif at:
                yield task, c, at, key_of(key)
            at, key = at + n, (key * power(n) + num(k)) % P

    carry = saved(mapped(ends.repartition(1).sortWithinPartitions("conv", "task"), "task bigint, conv bigint, before bigint, base binary", carried), "carry")

    def moved(rows):
        for c, at, key, digit, words, before, base in rows:
            if before is not None:
                at, key = at + before, key_of(num(base) * power(at) + num(key))
            yield c, at, key, digit, words

    df = df.join(F.broadcast(carry), ["task", "conv"], "left").select("conv", "at", "key", "digit", "words", "before", "base")
    return saved(mapped(df, "conv bigint, at bigint, key binary, digit binary, words bigint", moved), "numbered")


def memberships(own: DataFrame) -> DataFrame:
    """conv, depth, key, parent, words, len: one row per rebuilt conversation and depth."""
    heads = own.groupBy("conv").agg(F.max("at").alias("n"), *[F.max(F.when(F.col("at") == j, F.struct("key", "words"))).alias(f"t{j}") for j in range(1, MOST)])
    base = heads.filter(F.col("conv") % GROUP == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"), *[F.col(f"t{j}").alias(f"b{j}") for j in range(1, MOST)])
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % MOST
    plan = heads.withColumns({"base": F.col("conv") - F.col("conv") % GROUP, "h": h}).join(base, "base", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    pick = lambda side, i: F.coalesce(*[F.when(F.col(i) == j, F.col(f"{side}{j}.key")) for j in range(1, MOST)], F.lit(ROOT))
    plan = plan.select("conv", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"), pick("t", "h").alias("out"), pick("b", "taken").alias("into"), *[f"b{j}" for j in range(1, MOST)])
    plan = saved(plan, "plan")
    rest = own.join(plan.select("conv", "h", "taken", "len", "out", "into"), "conv").filter("at > h").select("conv", "at", "key", "digit", "words", "h", "taken", "len", "out", "into")

    def exchanged(rows):
        for c, at, key, digit, words, h, taken, length, out, into in rows:
            k = (num(key) + (num(into) - num(out)) * power(at - h)) % P
            yield c, taken + at - h, key_of(k), key_of((k - num(digit)) * UNBASE), words, length

    schema = "conv bigint, depth bigint, key binary, parent binary, words bigint, len bigint"
    parts = [F.struct(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"))]
    for j in range(1, MOST):
        parent = F.col(f"b{j - 1}.key") if j > 1 else F.lit(ROOT)
        parts.append(F.struct(F.lit(j).cast("long").alias("depth"), F.col(f"b{j}.key").alias("key"), parent.alias("parent"), F.col(f"b{j}.words").alias("words")))
    heads = plan.select("conv", "taken", "len", F.explode(F.array(*parts)).alias("x")).filter("x.depth <= taken").select("conv", "x.depth", "x.key", "x.parent", "x.words", "len")
    return saved(mapped(rest, schema, exchanged).unionByName(heads), "members")


class Queue:
    """A priority queue of tuples. Over ``room`` tuples in memory, they are sorted and go to a run in a file.

    Tuples come out in ascending order; one that is put must not be less than the last that came out.
    """

    def __init__(self, room: int = 200_000):
        self.room, self.heap, self.runs = room, [], []  # runs: heap of (least tuple, number, iterator)
        self.spilled = 0

    def put(self, item: tuple) -> None:
        heappush(self.heap, item)
        if len(self.heap) > self.room:
            self.spill()

    def spill(self) -> None:
        if len(self.runs) >= 32:  # few files at a time: old runs are merged with the new one
            items, self.runs = self.merged(), []
        else:
            items = iter(sorted(self.heap))
        file = tempfile.TemporaryFile()  # this task's own, gone with the task
        for item in items:
            pickle.dump(item, file)
        file.seek(0)
        self.heap, self.spilled = [], self.spilled + 1
        run = self.read(file)
        heappush(self.runs, (next(run), self.spilled, run))

    def merged(self) -> Iterator[tuple]:
        def whole(first, run):
            yield first
            yield from run

        return merge(sorted(self.heap), *[whole(first, run) for first, _, run in self.runs])

    @staticmethod
    def read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield pickle.load(file)
                except EOFError:
                    return

    def least(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def get(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            first, number, run = heappop(self.runs)
            if (item := next(run, None)) is not None:
                heappush(self.runs, (item, number, run))
            return first
        return heappop(self.heap)


def forward(rows, room: int = 200_000):
    """Totals of nodes that come by shard, falling depth and key.

    Rows: shard, depth, key, parent, own saved tokens, and what came from other shards: children, leaves, saved. Yields
    depth, key, parent, children, leaves, saved and whether the node is the top of its shard.
    """
    queue, shard = Queue(room), None
    for of, depth, key, parent, own, children, leaves, tokens in rows:
        if of != shard:
            shard, queue = of, Queue(room)
        while (least := queue.least()) is not None and least[:2] == (-depth, key):
            _, _, m_leaves, m_tokens = queue.get()
            children, leaves, tokens = children + 1, leaves + m_leaves, tokens + m_tokens
        leaves, tokens = leaves if children else 1, tokens + own
        top = key == shard
        if not top:
            queue.put((1 - depth, parent, leaves, tokens))
        yield depth, key, parent, children, leaves, tokens, top


def totals(members: DataFrame, nodes: DataFrame, shard: int = SHARD) -> DataFrame:
    """depth, key, n_children, n_leaves, saved_tokens of every node."""
    whole = nodes.agg(F.max("weight")).first()[0] or 0
    classes = 1
    while shard**classes < whole:
        classes += 1
    inner = range(1, classes)  # the shard of the last class is the whole trie above
    dealt = nodes.select("depth", "key", "parent", "weight", ((F.col("n_convs") - 1) * F.col("words")).alias("own"), F.col("conv_id").alias("conv"))
    if inner:
        weights = members.filter("depth > 0").select("conv", "depth", "key").join(nodes.select("depth", "key", "weight"), ["depth", "key"])
        tops = weights.groupBy("conv").agg(*[F.min(F.when(F.col("weight") <= shard**k, F.struct("depth", "key"))).alias(f"top{k}") for k in inner])
        dealt = dealt.join(saved(tops, "tops"), "conv", "left")
    kind = F.coalesce(*[F.when(F.col("weight") <= shard**k, k) for k in inner], F.lit(classes))
    top = F.coalesce(*[F.when(F.col("weight") <= shard**k, F.col(f"top{k}.key")) for k in inner], F.lit(ROOT))
    dealt = saved(dealt.select(kind.alias("kind"), top.alias("shard"), "depth", "key", "parent", "own"), "shards")
    done: DataFrame | None = None
    for k in range(1, classes + 1):
        rows = dealt.filter(F.col("kind") == k)
        if done is None:
            rows = rows.select("shard", "depth", "key", "parent", "own", *[F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "tokens")])
        else:
            sent = done.filter("top and parent is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("key"))
            sent = sent.agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("tokens"))
            rows = rows.join(sent, ["depth", "key"], "left").select("shard", "depth", "key", "parent", "own", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("children", "leaves", "tokens")])
        rows = rows.repartition("shard").sortWithinPartitions("shard", F.col("depth").desc(), "key")
        now = saved(mapped(rows, "depth bigint, key binary, parent binary, n_children bigint, n_leaves bigint, saved_tokens bigint, top boolean", forward), f"totals{k}")
        done = now if done is None else done.unionByName(now)
    return done.drop("parent", "top")


def end_digests(members: DataFrame) -> DataFrame:
    """depth, key, ends_sha256 of nodes at which conversations end."""
    ends = members.filter("depth = len").select("depth", "key", "conv")
    order = ["depth", "key", "conv"]

    def pieces(rows):
        node, held, first = None, [], 0
        for depth, key, conv in rows:
            if (depth, key) != node or len(held) == PIECE:
                if held:
                    yield *node, first, ",".join(held)
                node, held, first = (depth, key), [], conv
            held.append(str(conv))
        if held:
            yield *node, first, ",".join(held)

    cut = mapped(ends.repartitionByRange(*order).sortWithinPartitions(*order), "depth bigint, key binary, first bigint, piece string", pieces)

    def hashed(rows):
        node, state = None, None
        for depth, key, _, piece in rows:
            if (depth, key) != node:
                if node:
                    yield *node, state.hexdigest()
                node, state = (depth, key), hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        if node:
            yield *node, state.hexdigest()

    cut = cut.repartition("depth", "key").sortWithinPartitions("depth", "key", "first")
    return saved(mapped(cut, "depth bigint, key binary, ends_sha256 string", hashed), "ends")


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key."""
    members = memberships(numbered(turns_of(conversations)))
    nodes = members.groupBy("depth", "key").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.min("parent").alias("parent"), F.min("words").alias("words"), F.sum(F.col("len") - F.col("depth") + 1).alias("weight"))
    nodes = saved(nodes, "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    df = nodes.select("depth", "key", "parent", "conv_id", "n_convs").join(parents, ["depth", "parent"], "left")
    df = df.join(totals(members, nodes, shard), ["depth", "key"]).join(end_digests(members), ["depth", "key"], "left")
    none = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    return df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", none, F.lower(F.hex("key")).alias("key"))
