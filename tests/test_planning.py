"""Trees, chains and plans of batches against plain Python."""

import random

import pytest

from litspark.operators import planning, trees


def test_paths_of_a_forest(spark):
    r = random.Random(1)
    parent = {i: (None if i % 40 == 0 else r.randrange(i) if i < 200 else i - 1) for i in range(400)}  # a chain at the end
    parent |= {500: 501, 501: 502, 502: 500, 503: 500, 504: 504, 505: 999}
    rows = [(k, n, p) for k in ("x", "y") for n, p in parent.items()]
    got = {(x.k, x.n): (x.path, x.cyclic) for x in trees.tree_paths(spark.createDataFrame(rows, "k string, n int, p int"), ["k"], "n", "p").collect()}

    def path(n):
        out = [n]
        while parent.get(out[0]) in parent:
            out.insert(0, parent[out[0]])
        return out

    lost = {500, 501, 502, 503, 504}
    assert got == {(k, n): (None, True) if n in lost else (path(n), False) for k in ("x", "y") for n in parent}
    tops = trees.descendants(trees.tree_paths(spark.createDataFrame(rows[:50], "k string, n int, p int"), ["k"], "n", "p"), ["k"], "n")
    want = {("x", a, n, len(path(n)) - 1 - i) for n in list(parent)[:50] for i, a in enumerate(path(n))}
    assert {tuple(x) for x in tops.collect()} == want


def test_chains(spark):
    links = {i: i + 1 for i in range(100)} | {200: 7, 300: 301, 301: 302, 302: 300, 303: 300, 400: 400}
    got = {x.a: (x.end, x.hops) for x in trees.chain_ends(spark.createDataFrame(list(links.items()), "a int, b int"), "a", "b").collect()}
    want = {i: (100, 100 - i) for i in range(100)} | {200: (100, 94)} | {i: (None, None) for i in (300, 301, 302, 303, 400)}
    assert got == want
    assert trees.chain_ends(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def brute_plan(cards, sections, budget, deepest=3):
    """cards: (id, section, tokens) in order; sections: name -> (parent, level). Batches as lists of ids, and their modes."""
    children = {s: [c for c, (p, _) in sections.items() if p == s] for s in sections}
    fits = lambda group: budget.fits(len(group), sum(c[2] for c in group))

    def packed(group):
        out = [[]]
        for c in group:
            if out[-1] and not fits([*out[-1], c]):
                out.append([])
            out[-1].append(c)
        return out

    def below(s):
        return {s}.union(*[below(c) for c in children[s]])

    def plan(s, group):
        if fits(group):
            return [(group, "whole")]
        if sections[s][1] in (0, *range(deepest, 9)) or not children[s]:
            return [(g, "packed") for g in packed(group)]
        own = [c for c in group if c[1] == s]
        out = [(own, "direct")] if own and fits(own) else [(g, "direct_packed") for g in packed(own)] if own else []
        for child in children[s]:
            if mine := [c for c in group if c[1] in below(child)]:
                out += plan(child, mine)
        return out

    if fits(cards):
        return [([c[0] for c in cards], "paper")]
    out = []
    for s, (p, _) in sections.items():
        if p is None and (mine := [c for c in cards if c[1] in below(s)]):
            out += plan(s, mine)
    return sorted(([c[0] for c in g], m) for g, m in out)


@pytest.mark.parametrize("budget", [planning.Budget(100, 10, 5, 3, 2), planning.Budget(60, 0, 0, 0, 0, cards_most=3), planning.Budget(400, answer_per_card=10, answer_most=45)])
def test_plans_against_recursion(spark, budget):
    papers, rows, tree = {}, [], []
    for k in range(12):
        r = random.Random(k)
        sections = {}
        for i in range(r.randrange(1, 14)):
            parent = r.choice([None, *[s for s, (_, level) in sections.items() if level]])
            sections[f"s{i:02}"] = (parent, r.choice([0, 1, 1, 1]) if parent is None else sections[parent][1] + 1)
        cards = [(i, r.choice(list(sections)), r.choice([1, 5, 9, 30, 70])) for i in range(r.randrange(1, 40))]
        papers[k] = cards, sections
        rows += [(k, i, s, i, t) for i, s, t in cards]
        tree += [(k, s, p, level) for s, (p, level) in sections.items()]
    cards = spark.createDataFrame(rows, "paper int, card int, section string, at int, tokens int")
    plan, bad = planning.plan_batches(cards, spark.createDataFrame(tree, "paper int, section string, parent string, level int"), budget, "paper", "card", "section", "at", "tokens")
    got = {}
    for x in plan.collect():
        got.setdefault(x.paper, {}).setdefault((x.batch, x.mode), []).append(x.card)
    for k, (mine, sections) in papers.items():
        assert sorted((sorted(ids), m) for (_, m), ids in got[k].items()) == brute_plan(mine, sections, budget)
        firsts = [min(ids) for _, ids in sorted(got[k].items())]
        assert firsts == sorted(firsts) and sorted(b for b, _ in got[k]) == list(range(len(got[k])))
    alone = {(k, s) for k, i, s, _, t in rows if not budget.fits(1, t)}
    assert {(x.paper, x.section) for x in bad.filter("code = 'card_over_budget'").collect()} == alone
    codes = {x.code for x in planning.audit_plan(plan, cards, budget, "paper", "card", "at", "tokens")[0].collect()}
    assert codes <= {"out_of_order"}  # sections may interleave


def test_cards_of_one_section_are_packed_within_the_window(spark):
    cards = spark.createDataFrame([("p", i, "s", i, 60) for i in range(4)], "paper string, card int, section string, at int, tokens int")
    tree = spark.createDataFrame([("p", "s", None, 1)], "paper string, section string, parent string, level int")
    plan, bad = planning.plan_batches(cards, tree, planning.Budget(100), "paper", "card", "section", "at", "tokens")
    assert sorted((x.card, x.batch, x.mode) for x in plan.collect()) == [(i, i, "packed") for i in range(4)]
    assert [tuple(x) for x in bad.collect()] == [("p", "s", "no_finer_section")]


def test_sections_that_are_missing_or_go_in_circles(spark):
    cards = spark.createDataFrame([("p", i, s, i, 60) for i, s in enumerate(["lost", None, "a", "b", "a"])] + [("q", 0, "lost", 0, None)], "paper string, card int, section string, at int, tokens int")
    tree = spark.createDataFrame([("p", "a", "b", 1), ("p", "b", "a", 2)], "paper string, section string, parent string, level int")
    plan, _ = planning.plan_batches(cards.filter("section IS NOT NULL"), tree, planning.Budget(130), "paper", "card", "section", "at", "tokens")
    assert sorted((x.paper, x.card) for x in plan.collect()) == [("p", 0), ("p", 2), ("p", 3), ("p", 4), ("q", 0)]
    empty = cards.limit(0)
    assert planning.plan_batches(empty, tree, planning.Budget(130), "paper", "card", "section", "at", "tokens")[0].count() == 0
