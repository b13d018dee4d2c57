"""SentencePiece encoding with seeded merge-dropout, and decoding.

Text is cut at spaces and line ends, across which no piece of the vocabulary reaches. In each cut the best-scored pair of
neighbours is merged again and again, the leftmost of equals first, as byte-pair encoding does from its agenda. Each
candidate that the agenda comes to is skipped for good with probability ``dropout``. The skips are drawn anew for every
occurrence of a cut: a hash of the seed, the row, the place in the row and the number of skips so far says how many
candidates pass until the next one is skipped. So the same text is segmented in varied ways without a bound, the same
seed always in the same way, and every segmentation decodes to the text.

Cuts of at most ``SHORT`` characters are kept as trees while a bounded table lasts: the root is the segmentation without
skips, the child q of a node the one that also skips candidate q. An occurrence goes down from its root by its draws;
nodes that are missing are made in numpy, all of a batch at once, one candidate per cut and round. A longer cut is merged
on its own from a heap, in time n log n. With dropout 0 the ids equal those of the sentencepiece library, but for the
character U+2581, which is encoded as bytes here so that it also comes back.

Defined cases: null text has null ids; empty text has none; any length is encoded whole; repeated rows with one id get
one segmentation; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CUT = re.compile(" *[^ \n]+| +|\n")
SPACE = "▁"
M1, M2, ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
NEVER = np.int64(1 << 31)
SHORT = 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Pieces of a byte-pair model: ids of characters and bytes, and what pairs of pieces merge to."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bytes = [sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.byte_id = np.zeros(256, np.int32)
        self.char_id = np.full(0x110000, -1, np.int32)
        ids: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ids[piece.replace(SPACE, " ")] = i
                if len(piece) == 1:
                    self.char_id[ord(piece.replace(SPACE, " "))] = i
        self.ranks = [round(-sp.get_score(i)) for i in range(n)]
        self.rank = np.array(self.ranks, np.int64)
        self.pairs = pairs = {(a << 16) | b: i for p, i in ids.items() for k in range(1, len(p)) if (a := ids.get(p[:k])) is not None and (b := ids.get(p[k:])) is not None}
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.merged = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        for key, i in pairs.items():
            at = int(self.slot(np.array([key], np.int64))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.merged[at] = key, i

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the piece that a and b make together, -1 if none."""
        key = (a.astype(np.int64) << 16) | b.astype(np.int64)
        at = self.slot(key)
        got = self.keys[at]
        out = np.where(got == key, self.merged[at], -1)
        todo = np.flatnonzero((got != key) & (got >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[todo]]
            out[todo] = np.where(got == key[todo], self.merged[at[todo]], -1)
            todo = todo[(got != key[todo]) & (got >= 0)]
        return np.where((a >= 0) & (b >= 0), out, -1)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()[1:]


def merge_short(voc: Vocabulary, cuts: list[str], skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all cuts one after another, their numbers, and how many candidates each agenda came to.

    skips has a row per cut with the numbers of the candidates to skip, filled up with -1.
    """
    points = np.frombuffer("".join(cuts).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, cuts), np.int64, len(cuts))
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(cuts)), size)
    start = np.arange(len(points)) - first[owner]
    sym, came = voc.char_id[points], np.zeros(len(cuts), np.int64)

    def candidates(j: np.ndarray, sym, owner) -> tuple[np.ndarray, np.ndarray]:
        """What symbols j and j + 1 merge to, and its rank; NEVER if they don't."""
        to = np.where(owner[j] == owner[j + 1], voc.merge_of(sym[j], sym[j + 1]), -1)
        return to, np.where(to >= 0, voc.rank[to], NEVER)

    done: list[tuple[np.ndarray, ...]] = []
    to, rank = np.full(len(sym), -1, np.int32), np.full(len(sym), NEVER, np.int64)
    if len(sym) > 1:
        to[:-1], rank[:-1] = candidates(np.arange(len(sym) - 1), sym, owner)
    number = 0
    while len(sym):
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        best = np.minimum.reduceat(rank * len(sym) + np.arange(len(sym)), heads)
        live = best < NEVER * len(sym)
        at = best % len(sym)
        if not live.all():  # cuts without a candidate left are finished
            came[owner[heads[~live]]] = number
            keep = np.repeat(live, np.diff(heads, append=len(sym)))
            done.append((owner[~keep], start[~keep], sym[~keep]))
            at = (np.cumsum(keep) - 1)[at[live]]
            sym, start, owner, to, rank = (x[keep] for x in (sym, start, owner, to, rank))
        if not len(sym):
            break
        skip = (skips[owner[at]] == number).any(axis=1)
        number += 1
        rank[at[skip]] = NEVER
        at = at[~skip]
        sym[at] = to[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, start, owner, to, rank = (x[keep] for x in (sym, start, owner, to, rank))
        at = at - np.arange(len(at))  # one symbol went for each merge before
        to[at], rank[at] = -1, NEVER
        j = at[at + 1 < len(sym)]
        to[j], rank[j] = candidates(j, sym, owner)
        j = at[at > 0] - 1
        to[j], rank[j] = candidates(j, sym, owner)
    owner, start, sym = (np.concatenate([d[i] for d in done]) for i in range(3))
    order = np.lexsort((start, owner))
    owner, start, sym = owner[order], start[order], sym[order]
    if (sym < 0).any():  # characters without a piece, as UTF-8 bytes
        lost = np.flatnonzero(sym < 0)
        raw = [list(chr(points[first[owner[i]] + start[i]]).encode()) for i in lost]
        times = np.ones(len(sym), np.int64)
        times[lost] = [len(r) for r in raw]
        at = (np.cumsum(times) - times)[lost]
        owner, sym = np.repeat(owner, times), np.repeat(sym, times)
        for a, r in zip(at, raw, strict=True):
            sym[a : a + len(r)] = voc.byte_id[r]
    return sym.astype(np.int32), np.bincount(owner, minlength=len(cuts)), came


def merge_long(voc: Vocabulary, cut: str, skips: Iterator[int]) -> list[int]:
    """Ids of one cut of any length, from a heap of candidates; skips gives the numbers to skip, ascending."""
    sym, n = voc.char_id[np.frombuffer(cut.encode("utf-32-le"), np.uint32)].tolist(), len(cut)
    after, before, stamp = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
    pairs, rank = voc.pairs, voc.ranks

    def candidate(i: int, j: int) -> tuple[int, int, int, int] | None:
        to = pairs.get((sym[i] << 16) | sym[j]) if sym[i] >= 0 and sym[j] >= 0 else None
        return None if to is None else (rank[to], i, stamp[i], to)

    heap = [c for i in range(n - 1) if (c := candidate(i, i + 1))]
    heapify(heap)
    number, skip = 0, next(skips, -1)
    while heap:
        _, i, s, to = heappop(heap)
        if s != stamp[i]:  # one of the two symbols has changed since
            continue
        number += 1
        if number - 1 == skip:
            skip = next(skips, -1)
            continue
        j = after[i]
        sym[i], stamp[i], stamp[j], after[i] = to, s + 1, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
            if c := candidate(i, after[i]):
                heappush(heap, c)
        if (h := before[i]) >= 0:
            stamp[h] += 1
            if c := candidate(h, i):
                heappush(heap, c)
    out, i = [], 0
    while i < n:
        out += [sym[i]] if sym[i] >= 0 else voc.byte_id[list(cut[i].encode())].tolist()
        i = after[i]
    return out


class Encoder:
    """Encodes texts, keeping trees of segmentations until they have over ``room`` nodes or 16 ids for each."""

    def __init__(self, voc: Vocabulary, seed: int, dropout: float, room: int = 500_000):
        self.voc, self.seed, self.dropout, self.room = voc, seed, dropout, room
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.names: list[str] = []
        self.root = np.zeros(0, np.int64)  # node of each cut in code
        # of each node: its cut, the node above, the candidate it skips beyond that, how many its agenda came to, where
        # its children start, and where its ids are
        self.cut, self.above, self.skips, self.came, self.base, self.at, self.n = (np.zeros(0, np.int64) for _ in range(7))
        self.child = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def gaps(self, key: np.ndarray, level) -> np.ndarray:
        """How many candidates pass between two skips, by the occurrence's key and the number of skips before."""
        if self.dropout <= 0:
            return np.full(len(key), 1 << 40)
        if self.dropout >= 1:
            return np.zeros(len(key), np.int64)
        level = np.atleast_1d(np.asarray(level, np.uint64))
        unit = ((mixed(key + ODD * (level + np.uint64(1))) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        return np.minimum(np.log(unit) / np.log1p(-self.dropout), 2.0**40).astype(np.int64)

    def drawn(self, key: np.ndarray) -> Iterator[int]:
        """Numbers of all candidates that one occurrence skips."""
        number, level = -1, 0
        while True:
            for gap in self.gaps(np.repeat(key, 64), np.arange(level, level + 64)).tolist():
                number += gap + 1
                yield number
            level += 64

    def add(self, cut: np.ndarray, above: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """New nodes for cuts, each with the skips of the node above it and one more; -1 for none."""
        columns, node = [skip], above
        while (node >= 0).any():
            columns.append(np.where(node >= 0, self.skips[node], -1))
            node = np.where(node >= 0, self.above[node], -1)
        ids, n, came = merge_short(self.voc, [self.names[i] for i in cut], np.stack(columns, axis=1))
        width = came - skip - 1
        new = {"cut": cut, "above": above, "skips": skip, "came": came, "base": len(self.child) + np.cumsum(width) - width}
        return self.append(ids, n, width.sum(), **new)

    def append(self, ids: np.ndarray, n: np.ndarray, width: int, **new: np.ndarray) -> np.ndarray:
        nodes = len(self.at) + np.arange(len(n))
        new |= {"at": len(self.ids) + np.cumsum(n) - n, "n": n}
        for name in ("cut", "above", "skips", "came", "base", "at", "n"):
            setattr(self, name, np.concatenate([getattr(self, name), new.get(name, np.full(len(n), -1))]))
        self.ids, self.child = np.concatenate([self.ids, ids]), np.concatenate([self.child, np.full(width, -1)])
        return nodes

    def encode(self, texts: list[str], salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their numbers."""
        if len(self.at) > self.room or len(self.ids) > 16 * self.room:
            self.clear()
        cuts = [CUT.findall(" " + t) if t else [] for t in texts]
        flat, sizes = [c for x in cuts for c in x], np.fromiter(map(len, cuts), np.int64, len(cuts))
        if not flat:
            return np.zeros(0, np.int32), sizes
        code, new = self.code, self.code.setdefault
        number = np.fromiter((new(c, len(code)) if len(c) <= SHORT else -1 for c in flat), np.int64, len(flat))
        if len(code) > len(self.names):
            fresh = np.arange(len(self.names), len(code))
            self.names = list(code)
            none = np.full(len(fresh), -1)
            self.root = np.concatenate([self.root, self.add(fresh, none, none)])
        doc = np.repeat(np.arange(len(cuts)), sizes)
        place = np.arange(len(number)) - (np.cumsum(sizes) - sizes)[doc]
        own = mixed(salt.astype(np.uint64) + np.uint64((int(ODD) * (self.seed + 1)) % 2**64))
        key = mixed(own[doc] + ODD * place.astype(np.uint64))
        node = np.where(number >= 0, self.root[number], -1) if len(self.root) else number
        where = np.flatnonzero(number >= 0)
        skip, level = self.gaps(key[where], 0), 0
        while True:
            hit = skip < self.came[node[where]]
            where, skip = where[hit], skip[hit]
            if not len(where):
                break
            above = node[where]
            slot = self.base[above] + skip - self.skips[above] - 1
            missing = np.flatnonzero(self.child[slot] < 0)
            if len(missing):
                to, one = np.unique(slot[missing], return_index=True)
                one = missing[one]
                nodes = self.add(self.cut[above[one]], above[one], skip[one])
                self.child[to] = nodes
            node[where] = self.child[slot]
            level += 1
            skip = skip + 1 + self.gaps(key[where], level)
        long = np.flatnonzero(number < 0)
        if len(long):
            made = [merge_long(self.voc, flat[i], self.drawn(key[i : i + 1])) for i in long.tolist()]
            n = np.fromiter(map(len, made), np.int64, len(made))
            node[long] = self.append(np.concatenate([np.array(m, np.int32) for m in made]), n, 0)
        n = self.n[node]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[node] - (ends - n), n) + np.arange(ends[-1])]
        return ids, np.bincount(doc, weights=n, minlength=len(cuts)).astype(np.int64)


def parts(texts: list, limit: int = 2_000_000) -> Iterator[slice]:
    """Slices of about ``limit`` characters at most, so that memory doesn't grow with a batch of long texts."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= limit:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(model: str) -> Vocabulary:
    """One for each Python worker."""
    if model not in _vocabularies:
        _vocabularies[model] = Vocabulary(model)
    return _vocabularies[model]


def encode_pieces(docs: DataFrame, model: str = MODEL, seed: int = 11, dropout: float = 0.1) -> DataFrame:
    """One row per row of docs: doc_id and ids. The model's file is read by path on every executor."""
    rows = docs.select("doc_id", "text", F.xxhash64(F.lit(seed), "doc_id").alias("salt"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(model), seed, dropout)
        for batch in batches:
            texts, salt = batch.column("text").to_pylist(), batch.column("salt").to_numpy()
            for s in parts(texts):
                ids, n = encoder.encode([t or "" for t in texts[s]], salt[s])
                null = np.array([t is None for t in texts[s]])
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), mask=np.append(null, False))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[s], lists], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per row of encoded: doc_id and text."""
    rows = encoded.select("doc_id", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model)
        for batch in batches:
            texts = [None if x is None else voc.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def encode_and_check(docs: DataFrame, model: str = MODEL, seed: int = 11, dropout: float = 0.1) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids, and whether the ids decode to the text again, in one pass."""
    rows = docs.select("doc_id", "text", F.xxhash64(F.lit(seed), "doc_id").alias("salt"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model)
        encoder = Encoder(voc, seed, dropout)
        for batch in batches:
            texts, salt = batch.column("text").to_pylist(), batch.column("salt").to_numpy()
            for s in parts(texts):
                ids, n = encoder.encode([t or "" for t in texts[s]], salt[s])
                ends = np.cumsum(n)
                values = ids.tolist()
                same = [voc.decode(values[e - k : e]) == (t or "") for t, e, k in zip(texts[s], ends.tolist(), n.tolist(), strict=True)]
                null = np.array([t is None for t in texts[s]])
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(null, False))
                arrays = [batch.column("doc_id")[s], pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(same)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids", "lossless"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids array<int>, lossless boolean")
