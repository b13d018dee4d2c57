"""Byte-level BPE, the audit of filters and the conversation trie against libraries, SQL and plain Python."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest

from litspark.llm import byte_bpe, conversation_trie, filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ["ids", "__row", "words", "key", "mask", "part", "digest", "depth", "conv"]


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe.MODEL)


def odd_texts():
    r = random.Random(3)
    pools = [(0x20, 0x7F), (0x80, 0x250), (0x2000, 0xD000), (0x10000, 0x30000), (9, 14)]
    drawn = ["".join(chr(r.randrange(*r.choice(pools))) for _ in range(r.randrange(60))) for _ in range(500)]
    plain = ["", " ", "\n\n a  b", "don't we'll I'M", "x" * 3000, "né e" * 200, " " * 500, "a<|endoftext|>b  <|endoftext|><|endoftext|>", "1234567 ½²", "\x00\x1c\x85\xa0 a", "￾\U0010ffff"]
    return plain + drawn


def test_ids_and_texts_equal_the_library(library):
    words = byte_bpe.words_of(byte_bpe.MODEL)
    for text, want in zip(odd_texts(), library.encode_batch(odd_texts(), add_special_tokens=False), strict=True):
        assert words.encode(text) == want.ids
        assert byte_bpe.decoded(byte_bpe.bytes_of(byte_bpe.MODEL), want.ids) == library.decode(want.ids, skip_special_tokens=False) == text


def test_characters_are_cut_like_the_library(library):
    """All of the first planes' scripts, all that are newer than some table, and every ninth of the rest."""
    words = byte_bpe.words_of(byte_bpe.MODEL)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 9 == 0 or (c in words.plain and c % 3 == 0))]
    text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in points)
    assert words.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_rank_array_and_heap_agree():
    words, r = byte_bpe.words_of(byte_bpe.MODEL), random.Random(8)
    for n in range(1, 65):
        for raw in (bytes(r.choice(b"aaabht e") for _ in range(n)), r.randbytes(n)):
            assert words.merge_short(raw) == words.merge_long(raw)


def test_a_full_table_of_words_changes_nothing(library):
    words = byte_bpe.Words(byte_bpe.MODEL, room=3)
    assert words.encode("one two three four five one two") == library.encode("one two three four five one two", add_special_tokens=False).ids
    assert len(words) <= 3


def test_long_words_in_linear_time():
    words, text = byte_bpe.words_of(byte_bpe.MODEL), "ab" * 150_000 + "é" * 100_000
    began = time.time()
    assert byte_bpe.decoded(byte_bpe.bytes_of(byte_bpe.MODEL), words.encode(text)) == text
    assert time.time() - began < 30


def test_encoding_of_tables(spark, library):
    texts = [*odd_texts(), None, "", "the same", "the same", "long " * 100_000]
    rows = [(i, t, *"123456789") for i, t in enumerate(texts)] + [(3, texts[3], *"123456789"), (None, "no id", *"123456789")]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(3)
    got = byte_bpe.digest(byte_bpe.decode_bytes(byte_bpe.encode_bytes(df)))
    hashed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), hashed(",".join(map(str, ids))), hashed(t or ""))] += 1
    assert Counter(map(tuple, got.collect())) == want
    assert byte_bpe.decode_bytes(byte_bpe.encode_bytes(df.limit(0))).count() == 0
    whole = byte_bpe.encode_bytes(df).toArrow().combine_chunks().to_batches()[0]
    assert sum(b.num_rows for b in byte_bpe.slices(whole, 100)) == whole.num_rows and len(list(byte_bpe.slices(whole, 100))) > 10
    lost = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {tuple(x) for x in byte_bpe.decode_bytes(lost).select("doc_id", "text").collect()} == {(1, None), (2, "")}


# the audit of filters


def brute_audit(docs, labels):
    first, known = {}, defaultdict(lambda: [False, False])
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, quality, toxic in labels:
        if i is not None:
            known[i][0] |= quality == 1
            known[i][1] |= toxic == 1
    fails = []
    for i, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        failed = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)]
        failed += [bool(re.search(r"[#$%&*|]", text)), i is not None and i > first[text]]
        fails.append((source or "", dict(zip("ABCDE", failed, strict=True)), *(known[i] if i is not None else (False, False))))
    out = {}
    for part in {f[0] for f in fails}:
        mine, shapley = [f[1:] for f in fails if f[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone, stay = [x for x in left if x[0][f]], [x for x in left if not x[0][f]]
                earlier = sum(x[0][f] for x in mine) - len(gone)
                alone = sum(x[0][f] and sum(x[0].values()) == 1 for x in mine)
                out[part, order, step] = [len(stay), len(gone), earlier, alone, sum(x[1] for x in gone), sum(x[2] for x in gone), f]
                shapley[f] += len(gone)
                left = stay
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]]
    return {(*k, *v) for k, v in out.items()}


def audit_fixture():
    r = random.Random(4)
    lexicon = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(150):
        text = " ".join(r.choice(lexicon[: r.choice([20, 200])]) for _ in range(r.choice([3, 49, 50, 90])))
        text = text.upper() if r.random() < 0.2 else text + " #" * (r.random() < 0.3)
        docs.append((i, text, r.choice(["a", "b", "", None])))
    docs += [(200 + k, docs[k % 5][1], "a") for k in range(30)]  # copies
    docs += [(300, None, "a"), (301, "", "b"), (302, " \t\n", None), docs[3], docs[3], (None, docs[7][1], "b"), (None, None, None), (303, "long word " * 60_000, "b")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 320, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_audit_of_filters(spark):
    docs, labels = audit_fixture()
    names = ", ".join(f"`{c}` string" for c in [*CLASHING, "good", "n", "own", "quality"])
    df = spark.createDataFrame([(*d, *"1234567890123") for d in docs], "doc_id long, text string, source string, " + names).repartition(5)
    known = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = [tuple(x) for x in filter_audit.audit_filters(df, known).collect()]
    want = brute_audit(docs, labels)
    assert len(got) == len(want) == 3 * 600 and set(got) == want
    assert filter_audit.audit_filters(df.limit(0), known).count() == 0
    assert {x[8] for x in filter_audit.audit_filters(df, known.limit(0)).collect()} == {0}


def test_sql_of_the_audit(spark):
    docs, labels = ([x for x in rows if x[0] is not None] for rows in audit_fixture())
    duck = duckdb.connect()
    duck.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    duck.sql("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    duck.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert set(duck.sql(filter_audit.SQL).fetchall()) == brute_audit(docs, labels)


def test_min_plus_product_is_the_removal_step():
    orders, fails, _, steps = filter_audit.removal_steps(3)
    for m in range(8):
        for k, order in enumerate(orders):
            assert steps[m, k] == next((s for s, f in enumerate(order, 1) if fails[m, f]), 4)
    counts = np.arange(8)[None, :]
    found = filter_audit.interactions(counts, counts, counts, 3)
    assert (found["removed"].sum(axis=2) + found["kept"][:, :, -1] == 28).all()


# the conversation trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members, ends, children = defaultdict(list), defaultdict(list), Counter()
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = (*own.get(c - int(math.fmod(c, 20)), [])[:h], *turns[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    for k in members:
        children[k[:-1]] += bool(k)
    leaves, tokens = Counter(), Counter()
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += not children[k]
        tokens[k] += (len(members[k]) - 1) * (len(WORD.findall(k[-1][1])) if k else 0)
        if k:
            leaves[k[:-1]] += leaves[k]
            tokens[k[:-1]] += tokens[k]
    hashed = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], tokens[k], hashed(k)) for k, m in members.items())


def conversation_rows():
    r = random.Random(6)
    pool = [("user", "hi there"), ("assistant", "yes no maybe"), ("user", ""), (None, "a b"), ("system", None), ("user", "hi  there")]
    rows = []
    for c in [*range(-45, 130), 10**12, 10**12 + 20]:
        if c % 11 == 0:
            continue  # also bases that are absent
        for turn in range(r.randrange(1, 7)):
            rows.append((c, None if turn == 0 and c % 3 == 0 else turn // 2 if c % 5 == 0 else turn, *pool[r.randrange(len(pool) if c % 4 else 2)]))
    rows += [(40, 50 + i, "user", f"turn {i % 7}") for i in range(400)]  # a conversation with most turns
    rows += [(60, 9, "user", "again")] * 150  # one row repeated
    rows += [(61, 1, "user", "word " * 30_000), (None, 1, "user", "no conversation"), (None, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [4096, 9])
def test_trie(spark, shard):
    rows = conversation_rows()
    names = "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    df = spark.createDataFrame([(*x, *"123456789") for x in rows], names).repartition(6)
    got = Counter(tuple(x)[:8] for x in conversation_trie.prefix_trie(df, shard).collect())
    assert got == brute_trie(rows)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.prefix_trie(df).count() == 0
    lost = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert conversation_trie.prefix_trie(lost).count() == 0


def test_ends_in_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 3)
    rows = [(c, 0, "user", "same") for c in range(0, 4000, 20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert Counter(tuple(x)[:8] for x in conversation_trie.prefix_trie(df).collect()) == brute_trie(rows)


def test_queue_spills_and_keeps_order():
    r, queue, want = random.Random(2), conversation_trie.Queue(room=5), []
    low = 0
    for _ in range(3000):
        if want and r.random() < 0.4:
            got = queue.get()
            assert got == min(want)
            want.remove(got)
            low = got[0]
        else:
            item = (low + r.randrange(50), r.randrange(9))
            queue.put(item)
            want.append(item)
    assert queue.spilled > 100
    while want:
        assert queue.least() == min(want)
        want.remove(queue.get())
    assert queue.least() is None


def test_totals_with_a_queue_of_no_room():
    depth = 300
    nodes = [(b"r", d, b"%03d%d" % (d, i), b"%03d%d" % (d - 1, 0), 1, 0, 0, 0) for d in range(depth, 0, -1) for i in range(3)]
    nodes.append((b"r", 0, b"r", None, 0, 0, 0, 0))
    nodes = [(s, d, k, b"r" if d == 1 else p, *x) for s, d, k, p, *x in nodes]
    out = list(conversation_trie.forward(iter(nodes), room=2))
    assert out == list(conversation_trie.forward(iter(nodes)))
    assert out[-1] == (0, b"r", None, 3, 2 * depth + 1, 3 * depth, True)
