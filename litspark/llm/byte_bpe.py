"""Byte-level BPE encoding and decoding with a contiguous rank array.

Text is cut where the tokenizer's file cuts it: at special tokens, and between them by the pattern of byte-level BPE. A
short word is held as its part boundaries and, contiguous beside them, the ranks of the merges of neighbouring parts. The
array is scanned for its minimum, the boundary there is deleted and the two ranks next to it are refreshed, until no
neighbours merge. Scanning is the fastest for a few parts, but grows with the square of a word, so a word of over
``SHORT`` bytes is merged from a heap over linked parts, in time n log n, with the same result. Ids of short words are
kept by word in a table of bounded size.

Ids equal those of the tokenizers library (add_special_tokens=False), of which the operator needs no more than how it
classifies characters that are newer than Python's tables. Decoding joins the bytes of the ids.

Defined cases: null text counts as empty; empty text has no ids; texts and words of any length are encoded whole; the
name of a special token inside a text becomes that token; repeated rows are encoded alike; an empty table gives no
rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.llm.pieces import parts

MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the published pattern of this family of tokenizers.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 64
NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The character that stands for each byte in the file: itself if it is visible, else the next one from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


def newer_letters(model: str) -> str:
    """Letters and numbers of the regex module that neither Python's tables nor the tokenizers library know as such."""
    import tokenizers

    new = "".join(c for c in map(chr, chain(range(0xD800), range(0xE000, 0x110000))) if category(c) == "Cn")
    found = regex.findall(r"[\p{L}\p{N}\s]", new)
    cut = tokenizers.Tokenizer.from_file(model).pre_tokenizer.pre_tokenize_str
    kept = {end for _, (begin, end) in cut("".join(f"a{c}\n1{c}\n" for c in found)) if end - begin == 2}
    return "".join(c for i, c in enumerate(found) if not {6 * i + 2, 6 * i + 5} & kept)


def ranges_of(chars: str) -> str:
    """Ascending characters as the ranges of a character class."""
    points = np.array([ord(c) for c in chars])
    runs = np.split(points, np.flatnonzero(np.diff(points) != 1) + 1)
    return "".join(rf"\U{r[0]:08x}-\U{r[-1]:08x}" for r in runs)


def latin_words() -> re.Pattern:
    """WORDS for texts of the first 256 characters, with the classes written out, which is three times as fast."""
    chars, pattern = "".join(map(chr, range(256))), WORDS.replace(r"\S", r"[^\s]")
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        ranges = ranges_of("".join(regex.findall(name, chars)))
        pattern = re.sub(rf"(\[[^]]*){re.escape(name)}", lambda m, r=ranges: m[1] + r, pattern).replace(name, f"[{ranges}]")
    return re.compile(pattern)


@cache
def bytes_of(model: str) -> list[bytes]:
    """Bytes by id."""
    spec = json.load(open(model, encoding="utf-8"))
    at = {c: b for b, c in enumerate(byte_letters())}
    names = {i: bytes(at[c] for c in name) for name, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [names.get(i, b"") for i in range(max(names) + 1)]


def decoded(table: list[bytes], ids: list[int]) -> str:
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")


class Words(dict):
    """Ids by word. Words that are missing are merged, and kept unless they are long or the table is full."""

    def __init__(self, model: str, room: int = 400_000):
        spec = json.load(open(model, encoding="utf-8"))
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.room = room
        self.byte_ids = [vocab[c] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a] << 20) | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.words, self.latin = regex.compile(WORDS), latin_words()
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        newer = newer_letters(model)
        self.newer = regex.compile(f"[{ranges_of(newer)}]") if newer else None
        self.plain = dict.fromkeys(map(ord, newer), "")

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        if len(raw) > SHORT:
            return tuple(self.merge_long(raw))
        ids = tuple(self.merge_short(raw))
        if len(self) >= self.room:
            self.clear()
        self[word] = ids
        return ids

    def merge_short(self, word: bytes) -> list[int]:
        """Ids of a short word: ids[i] stands between boundaries i and i + 1, rank[i] is that of boundary i + 1."""
        find, made = self.ranks.get, self.made
        ids = [self.byte_ids[b] for b in word]
        rank = [find((a << 20) | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while rank and (best := min(rank)) < NEVER:
            i = rank.index(best)
            ids[i] = made[best]
            del ids[i + 1], rank[i]
            if i < len(rank):
                rank[i] = find((ids[i] << 20) | ids[i + 1], NEVER)
            if i:
                rank[i - 1] = find((ids[i - 1] << 20) | ids[i], NEVER)
        return ids

    def merge_long(self, word: bytes) -> list[int]:
        """The same for a word of any length, from a heap of candidates (rank, place, the two ids)."""
        find, made, n = self.ranks.get, self.made, len(word)
        ids, after, before = [self.byte_ids[b] for b in word], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := find((ids[i] << 20) | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:  # one of the two parts has changed since
                continue
            ids[i], ids[j], after[i] = made[rank], -1, after[j]
            if (k := after[i]) < n:
                before[k] = i
                if (r := find((ids[i] << 20) | ids[k])) is not None:
                    heappush(heap, (r, i, ids[i], ids[k]))
            if (k := before[i]) >= 0 and (r := find((ids[k] << 20) | ids[i])) is not None:
                heappush(heap, (r, k, ids[k], ids[i]))
        return [i for i in ids if i >= 0]

    def cut(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        try:
            text.encode("latin-1")
            return self.latin.findall(text)
        except UnicodeEncodeError:
            pass
        if self.newer and self.newer.search(text):
            return [text[slice(*m.span())] for m in self.words.finditer(text.translate(self.plain))]
        return self.words.findall(text)

    def encode(self, text: str) -> list[int]:
        if self.at_special and self.at_special.search(text):
            pieces = self.at_special.split(text)
            return [i for k, p in enumerate(pieces) for i in ([self.special[p]] if k % 2 else self.encode_plain(p))]
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.cut(text))))


@cache
def words_of(model: str) -> Words:
    """One for each Python worker."""
    return Words(model)


def encode_bytes(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per row of docs: doc_id and ids. The tokenizer's file is read by path on every executor."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for s in parts(texts):
                made = [words.encode(t) if t else [] for t in texts[s]]
                ends = np.cumsum([0, *map(len, made)])
                ids = pa.array(np.fromiter(chain.from_iterable(made), np.int32, ends[-1]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[s], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids)], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def slices(batch: pa.RecordBatch, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` ids at most, so that memory doesn't grow with a batch of long texts."""
    begin = held = 0
    for i, n in enumerate(pa.compute.list_value_length(batch.column("ids")).to_pylist()):
        held += n or 0
        if held >= limit:
            yield batch.slice(begin, i + 1 - begin)
            begin, held = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def decode_bytes(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per row of encoded: all its columns and text, decoded from ids; null ids give null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "text")
    rows = encoded.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bytes_of(model)
        for batch in batches:
            for part in slices(batch):
                ids = part.column("ids")
                flat, ends = ids.flatten().to_numpy(), np.cumsum([0, *(n or 0 for n in pa.compute.list_value_length(ids).to_pylist())])
                texts = [decoded(table, flat[a:b].tolist()) if there else None for a, b, there in zip(ends, ends[1:], ids.is_valid().to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "text"])

    return rows.mapInArrow(run, schema + ", text string")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, ids, text -> doc_id, n_tokens and the SHA-256 of ids and text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
