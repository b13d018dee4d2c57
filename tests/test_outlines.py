"""Outlines and hierarchies of any depth against plain Python."""

import random

from litspark.operators import outlines, structure


def test_sums_over_all_below(spark):
    r = random.Random(3)
    nodes = {d: {n: None if n % 17 == 0 or n == 0 else r.randrange(n) for n in range(60)} for d in range(4)}
    places = {(d, n): r.randrange(5) for d in nodes for n in nodes[d]}
    rows = [(d, n, p, places[d, n], r.choice(["body", "front_matter", "references"]), 1, r.random(), r.choice([None, [], ["level_jump"], ["x"]])) for d in nodes for n, p in nodes[d].items()]
    rows += [(9, 1, 2, 0, "body", 1, 0.9, None), (9, 2, 1, 0, "body", 1, 0.9, None), (9, 3, None, 0, None, 1, None, None)]
    df = spark.createDataFrame(rows, "doc int, node int, parent int, at int, role string, level int, confidence double, markers array<string>")
    low = {(x[0], x[1]): (x[6] is not None and x[6] < 0.7) or "level_jump" in (x[7] or []) for x in rows}

    def walk(d, n):
        return [n, *[y for _, c in sorted((places[d, c], c) for c, p in nodes[d].items() if p == n) for y in walk(d, c)]]

    want = {}
    for d in nodes:
        order = [x for _, n in sorted((places[d, n], n) for n, p in nodes[d].items() if p is None) for x in walk(d, n)]
        for n in nodes[d]:
            mine = walk(d, n)
            first = order.index(n) + 1
            want[d, n] = (first, first + len(mine) - 1, sum(p == n for p in nodes[d].values()), len(mine), sum(low[d, x] for x in mine))
    outline = outlines.build_outline(df, "doc").cache()
    got = {(x.doc, x.node): (x.first, x.last, x.child_count, x.n_nodes, x.n_low) for x in outline.collect()}
    assert {k: v for k, v in got.items() if k[0] != 9} == want
    assert got[9, 1] == (None, None, 1, None, None) and got[9, 3] == (1, 1, 0, 1, 0)
    notes = outlines.review_notes(outline, "doc", 2).collect()
    assert sorted(x.node for x in notes if x.kind == "watchlist" and x.doc == 1) == sorted(n for d, n in low if d == 1 and low[d, n])
    assert max(x.place for x in notes if x.kind == "subsection") == 2
    stats = {x.doc: x for x in outlines.outline_stats(outline, "doc").collect()}
    assert stats[2].n_nodes == 60 and sum(stats[2].role_counts.values()) == 60 and stats[9].role_counts[""] == 1
    assert outlines.build_outline(df.limit(0), "doc").count() == 0


def test_parents_of_any_level(spark):
    r = random.Random(4)
    rows = [(d, n, r.randrange(1, 12), f"t{n}") for d in range(20) for n in range(30)]
    df = spark.createDataFrame(rows, "doc int, n int, level int, title string")
    got = {(x.doc, x.n): x.parent for x in structure.resolve_hierarchy(df, "doc", "n", "level").collect()}
    level = {(d, n): lv for d, n, lv, _ in rows}
    assert got == {(d, n): max((m for m in range(n) if level[d, m] < level[d, n]), default=None) for d, n in level}
    chain = spark.createDataFrame([("d", i, i, f"t{i}") for i in range(1, 9)], "doc string, n int, level int, title string")
    assert {x.n: x.path for x in structure.flat_heading_paths(chain, "doc", "n", "level", "title").collect()}[8] == [f"t{i}" for i in range(1, 9)]
    assert structure.flat_heading_paths(chain.limit(0), "doc", "n", "level", "title").count() == 0
