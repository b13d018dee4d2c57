"""Quotes by place against plain Python."""

import random
from collections import Counter

from litspark.operators import relations, structure


def brute(cards, quotes, most=20):
    out = Counter()
    ids = Counter(q[1] for q in quotes if q[1] is not None)
    for i, n in ids.items():
        if n > 1:
            k, s = min((q[0], q[2]) for q in quotes if q[1] == i)
            out[k, i, "id_repeated", s, n] += 1
    covered = {k: set() for k in cards}
    for k, i, s, e, q in quotes:
        text, kind = cards.get(k, (None, None))
        bad = [("unknown_card", text is None), ("not_a_slice", text is not None and not (0 <= s < e <= len(text) and text[s:e] == q)), ("too_long", len(q) > most), ("several_lines", "\n" in q or "\r" in q), ("quote_of_image", kind == "image"), ("id_missing", not i)]
        out.update((k, i, code, s, 1) for code, hit in bad if hit)
        if text is not None and s >= 0:
            covered[k].update(range(s, e))
    for k, (text, kind) in cards.items():
        at = 0
        while kind != "image" and at < len(text):
            end = at
            while end < len(text) and end not in covered[k]:
                end += 1
            solid = [p for p in range(at, end) if not text[p].isspace()]
            if solid:
                out[k, None, "not_covered", solid[0], len(solid)] += 1
            at = end + 1
    return out


def test_quotes_by_place(spark):
    r = random.Random(9)
    cards = {k: ("".join(r.choice("ab  \n　") for _ in range(r.randrange(60))), "image" if k % 9 == 4 else "text") for k in range(60)}
    quotes = [(0, "x", 0, 1, "?"), (99, "lost", 0, 1, "a"), (1, None, 0, 2, cards[1][0][:2]), (1, "", 1, 3, cards[1][0][1:3]), (2, "x", 5, 3, "b"), (3, "far", 10, 500, "a"), (5, "minus", -3, 4, "abc")]
    for k, (text, _) in cards.items():
        for n in range(r.randrange(8)):
            s = r.randrange(max(1, len(text)))
            e = min(len(text), s + r.randrange(1, 30))
            quotes.append((k, f"{k}.{n}", s, e, text[s:e]))
    c = spark.createDataFrame([(k, *v) for k, v in cards.items()], "k int, t string, kind string")
    q = spark.createDataFrame(quotes, "k int, quote_id string, start_char int, end_char int, quote string")
    got = Counter(tuple(x) for x in structure.quote_violations(q, c, "k", "t", 20, c.kind).collect())
    assert got == brute(cards, quotes)
    assert structure.quote_violations(q.limit(0), c.limit(0), "k", "t").count() == 0


def test_overlaps_hide_no_gap(spark):
    c = spark.createDataFrame([("p", "abcd")], "k string, t string")
    q = spark.createDataFrame([("p", "1", 0, 2, "ab"), ("p", "2", 1, 3, "bc")], "k string, quote_id string, start_char int, end_char int, quote string")
    assert [tuple(x) for x in structure.quote_violations(q, c, "k", "t").collect()] == [("p", None, "not_covered", 3, 1)]


def test_frozen_rows(spark):
    stored = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y"), (None, "d", "z"), (4, "e", None)], "k int, f string, g string")
    frozen = spark.createDataFrame([(1, "a", None), (2, "B", None), (4, "e", "w"), (4, "e", None), (9, "q", "q")], "k int, f string, g string")
    got = {tuple(x) for x in relations.frozen_differences(stored, frozen, "k", ["f", "g"]).collect()}
    assert got == {(2, "differs", "f"), (2, "differs", "g"), (3, "not_frozen", None), (None, "not_frozen", None), (4, "repeated", None)}


def test_quotes_are_cut_once(spark):
    """Quotes were cut in Python once for their places and once more for their ids."""
    c = spark.createDataFrame([("p", "ab  cd\n é x"), ("q", None)], "k string, t string")
    found = structure.quote_violations(structure.split_quotes(c, "k", "t"), c, "k", "t")
    assert found.count() == 0
    assert "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
