"""Corrections, owners of facts, cached requests and the small operators without SQL, on inline tables."""

import random
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from litspark.functions import text
from litspark.operators import audits, evidence, structure


def found(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def found_rows(rows):
    return sorted(rows, key=str)


def test_corrections(spark):
    units = spark.createDataFrame([(i, "成本下降5%，趋势明显", "成本可能下降5%") for i in range(9)], "k int, claim string, quote string")
    given = [(0, "keep", None), (1, "replace", "成本下降5%"), (2, "replace", "成本下降6%"), (3, "replace", "成本下降5%，趋势明显" + "很" * 17), (4, "replace", "成本可能下降5%"), (5, "replace", "成本预计下降5%"), (6, "replace", "完全不同的说法"), (7, "shorten", "x"), (7, "keep", None)]
    kept, bad = evidence.apply_correction(units, spark.createDataFrame(given, "k int, action string, replacement string"), ["k"])
    assert found(bad) == [(2, "new_numbers"), (3, "too_long"), (5, "hedge_not_quoted"), (6, "low_overlap"), (7, "repeated"), (8, "missing")]
    assert found(kept) == [(0, "成本下降5%，趋势明显"), (1, "成本下降5%"), (4, "成本可能下降5%")]


def test_corrections_align_each_pair_once(spark, monkeypatch):
    """Replacements that hold the claim, or share too few characters with it, aren't aligned; before, each row was, twice."""
    seen, plain = spark.sparkContext.accumulator(0), text.char_overlap.func

    @F.pandas_udf("double")
    def counted(a, b):
        seen.add(len(a))
        return plain(a, b)

    monkeypatch.setattr(text, "char_overlap", counted)
    rows = [(i, *[("abcdef", "abcdef new"), ("abcdef", "xyz"), ("abcdef", "fedcba"), ("abcdef", "abc xyz"), ("", "abc"), (None, "abc")][i % 6]) for i in range(600)]
    units = spark.createDataFrame([(i, a, None) for i, a, _ in rows], "k int, claim string, quote string")
    kept, bad = evidence.apply_correction(units, spark.createDataFrame([(i, "replace", b) for i, _, b in rows], "k int, action string, replacement string"), ["k"])
    good = {i: a is not None and a != "" and plain(pd.Series([a]), pd.Series([b]))[0] >= 0.5 for i, a, b in rows}
    assert found(bad) == found_rows((i, "low_overlap") for i in good if not good[i])
    assert found(kept) == found_rows((i, b) for i, _, b in rows if good[i])
    assert seen.value == 3


def test_owners_of_facts(spark):
    facts = [(1, "h", "r", 0, "5%", "甲"), (2, "h", "r", 0, "5%", "甲"), (3, "h", "r", 0, "5%", "甲"), (3, "h", "r", 1, "6%", "甲"), (4, "h", "r", 0, "5%", "甲"), (5, "h", "r", 2, "5%", "甲"), (6, "", "r", 0, "5%", "甲"), (7, "", "r", 0, "5%", "甲")]
    units = [(1, "甲 最高 5%"), (2, "无 5%"), (3, "甲 为 5%"), (4, "（甲）为 5%"), (5, "甲"), (6, "甲"), (7, "甲")]
    owners, delegated = evidence.fact_owner(spark.createDataFrame(facts, "unit int, header string, row string, column int, fact string, row_label string"), spark.createDataFrame(units, "unit int, claim string"))
    assert found(owners) == [("h", "r", 0, "5%", 4, 4)]
    assert sorted(x.unit for x in delegated.collect()) == [1, 2, 3]


def test_owners_of_facts_sort_no_rows(spark):
    """All facts were sorted to find the least struct, and sorted and joined anew for those that are delegated."""
    r = random.Random(4)
    claims = [None, "a", "a 最高", "b", "b 最低", ""]
    facts = [(r.randrange(40), r.choice("hk"), r.choice(["r", "s", None]), r.randrange(-1, 2), r.choice("56"), r.choice(["a", "b", None])) for _ in range(600)]
    units = [(u, r.choice(claims)) for u in range(38)]
    owners, delegated = evidence.fact_owner(spark.createDataFrame(facts, "unit int, header string, row string, column int, fact string, row_label string"), spark.createDataFrame(units, "unit int, claim string"))
    n, claim, best = Counter(f[0] for f in facts), dict(units), {}
    for u, *key, label in facts:
        if u in claim and None not in key and key[2] >= 0:
            ranks = -1 if claim[u] is None else int("最" in claim[u])
            unnamed = int((label or "") not in (claim[u] or ""))
            best.setdefault(tuple(key), {}).setdefault(u, []).append((ranks, unnamed, n[u], u))
    want = {k: min(min(x) for x in by.values())[3] for k, by in best.items() if len(by) > 1}
    assert found(owners) == found_rows((*k, o, len(best[k])) for k, o in want.items())
    assert found(delegated.select("unit", "header", "row", "column", "fact", "owner")) == found_rows((u, *k, o) for k, o in want.items() for u in best[k] if u != o)
    for df in (owners, delegated):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "Window" not in plan and plan.count("Scan") <= 2


def test_requests_found_in_parent_runs(spark):
    runs = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "run string, parent string")
    cache = spark.createDataFrame([("a", 1, "p", "m"), ("b", 1, "p", "old"), ("a", 2, "q", None), ("c", 3, "r", "m"), ("y", 4, "s", "m"), ("b", 5, "t", "m"), ("a", 5, "u", "m")], "run string, key int, prompt string, model string")
    asked = [("c", 1, "p", "m"), ("b", 1, "z", "m"), ("c", 2, "q", None), ("b", 3, "r", "m"), ("x", 4, "s", "m"), ("c", 5, "z", "m"), ("c", 1, "p", "m")]
    requests = spark.createDataFrame([(*x, i) for i, x in enumerate(asked)], "run string, key int, prompt string, model string, n int")
    got = {x.n: (x.status, x.source, x.distance, x.stale) for x in evidence.split_cached(requests, cache, runs, ["prompt", "model"]).collect()}
    hit = ("hit", "a", 2, "")
    assert got == {0: hit, 1: ("stale", "b", 0, "prompt,model"), 2: hit, 3: ("miss", None, None, None), 4: ("miss", None, None, None), 5: ("stale", "b", 1, "prompt"), 6: hit}


def test_labels_and_replacements(spark):
    claims = spark.createDataFrame([("p", "the north bridge fell"), ("p", "nothing"), ("q", "the north")], "paper string, claim string")
    labels = spark.createDataFrame([("p", "north"), ("p", "north bridge"), ("p", "xx"), ("q", "bridge")], "paper string, label string")
    assert found(evidence.match_labels(claims, labels, "paper", "claim", "label")) == [("p", "the north bridge fell", "north bridge")]
    repeated = claims.unionByName(claims).unionByName(claims.limit(1).withColumn("claim", F.lit(None).cast("string")))
    best = evidence.match_labels(repeated, labels, "paper", "claim", "label")
    assert found(best) == [("p", "the north bridge fell", "north bridge")]
    assert "SortAggregate" not in best._jdf.queryExecution().executedPlan().toString()  # claims were sorted once for each label
    rows = lambda *x: spark.createDataFrame(x, "paper string, unit string, text string, at int")
    blocked = rows(("p", "b", "rivers rise fast", 3))
    supported = rows(("p", "near", "rivers rise", 2), ("p", "far", "rivers rise fast", 5), ("q", "other", "rivers rise fast", 2), ("p", "unlike", "xyz", 4))
    got = found(evidence.replacement_candidates(blocked, supported, "paper", "unit", "text", "at"))
    grams = lambda s: {s.replace(" ", "")[i : i + 2] for i in range(len(s.replace(" ", "")) - 1)}
    a, b = grams("rivers rise fast"), grams("rivers rise")
    assert got == [("b", "near", round(len(a & b) / len(a | b), 6))]


def test_excerpts(spark):
    value = "One. Two is here! Three? " + "Four " * 80
    df = spark.createDataFrame([(value,), ("short",), ("",), (None,)], "t string")
    lead = [x.x for x in df.select(text.lead_excerpt(F.col("t")).alias("x")).collect()]
    assert lead[0] == "One. Two is here!" and lead[1] == "short"
    summary = [x.x for x in df.select(text.extractive_summary(F.col("t"), 10).alias("x")).collect()]
    assert summary[0] == "One. Two is here!" and summary[1] == "short" and summary[2] == ""


def test_samples_by_rules(spark):
    rows = [(f"d{i:02}", i, i % 3 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "item string, size int, odd boolean")
    got = audits.sample_by_rules(df, [("largest", F.lit(True), [F.col("size").desc()]), ("odd", F.col("odd"), [F.col("size").asc()]), ("none", F.col("size") > 99, [F.col("size").asc()])], "item", 2)
    assert got == [("largest", "d19"), ("odd", "d00")]  # one for each rule that has any


def test_pieces_of_long_lines_join_again(spark):
    r = random.Random(2)
    lines = [(i, "".join(r.choice("ab。. 。\n") for _ in range(r.randrange(0, 400)))) for i in range(40)]
    got = {}
    for x in structure.split_long_texts(spark.createDataFrame(lines, "id int, t string"), "id", "t", 60).collect():
        got.setdefault(x.id, []).append((x.part, x.piece))
    for i, t in lines:
        pieces = [p for _, p in sorted(got.get(i, []))]
        assert "".join(pieces) == t and all(len(p) <= 60 for p in pieces)


def test_stop_rules_in_order(spark):
    rows = [("preflight", i, "done" if i else "parse", "x", False) for i in range(3)]
    rows += [("low", i, "done" if i < 7 else "parse", "x", False) for i in range(10)]
    rows += [("repeats", i, "done", None, True) for i in range(20)] + [("repeats", 30 + i, s, k, False) for i, (s, k) in enumerate([("parse", "late"), ("convert", "b"), ("convert", "b"), ("parse", "late")])]
    rows += [("blocks", i, "done", None, i < 3) for i in range(9)] + [("fine", 1, "done", None, True)]
    df = spark.createDataFrame(rows, "phase string, n int, stage string, kind string, blocks boolean")
    got = dict(map(tuple, audits.stop_reason(df, "phase", "n", "stage", "kind", "done", [("never", F.lit(False)), ("depends", F.col("blocks"))], repeats=2).collect()))
    assert got == {"preflight": "preflight_failed", "low": "success_rate_below_threshold:0.70", "repeats": "repeated_failure:parse:late", "blocks": "blocking_check:depends", "fine": None}
