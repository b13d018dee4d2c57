"""Revisions and automatic resolutions on small cases, and against plain Python."""

import hashlib
import random

from litspark.operators import revisions as rv

ST = "statement_id string, field string, pos long, single boolean, statement string, units array<string>"
DISPOSITION = "unit string, disposition string, reason string"


def found(df):
    return sorted(tuple(x) for x in df.collect())


def test_revision_releases_evidence(spark):
    st = [("a", "f", 0, False, "A", ["1", "2"]), ("b", "f", 1, False, "B", ["3"]), ("c", "f", 2, False, "C", ["4", "5"]), ("t", "title", 0, True, "T", ["1"])]
    statements = spark.createDataFrame(st, ST)
    evidence = spark.createDataFrame([(str(i),) for i in range(1, 8)], "unit string")
    old = spark.createDataFrame([(str(i), "used", "supports_claim") for i in range(1, 6)] + [("6", "excluded", "off_topic"), ("7", "peripheral", "background_only")], DISPOSITION)
    blocked = spark.createDataFrame([("a",), ("b",), ("c",)], "statement_id string")
    items = "statement_id string, action string, items array<struct<statement:string,units:array<string>>>"
    revisions = spark.createDataFrame([("a", "replace", [("A1", ["1"]), ("A2", ["1"])]), ("b", "delete", []), ("c", "replace", [("C", ["4", "5"])])], items)
    released = spark.createDataFrame([("2", "redundant", "duplicate_support"), ("3", "excluded", "off_topic")], DISPOSITION)
    revised, final, bad = rv.apply_revision(statements, blocked, revisions, evidence, old, released)
    assert found(bad) == [("unchanged", "c")]
    assert found(revised.select("field", "pos", "statement", "units")) == [("f", 0, "A1", ["1"]), ("f", 1, "A2", ["1"]), ("f", 2, "C", ["4", "5"]), ("title", 0, "T", ["1"])]
    want = {"1": "used", "2": "redundant", "3": "excluded", "4": "used", "5": "used", "6": "excluded", "7": "peripheral"}
    assert {x.unit: x.disposition for x in final.collect()} == want
    wrong = spark.createDataFrame([("2", "used", "supports_claim"), ("2", "redundant", "duplicate_support"), ("1", "excluded", "off_topic")], DISPOSITION)
    assert {("released_missing", "3"), ("released_repeated", "2"), ("released_unknown", "1")} <= set(found(rv.apply_revision(statements, blocked, revisions, evidence, old, wrong)[2]))


def test_dispositions_need_no_joins(spark):
    """The violations were seven joins, all of which sorted the units in one task; a null id answers nothing."""
    units = lambda ids: spark.createDataFrame([(i,) for i in ids], "unit string")
    fine, off = ("excluded", "off_topic"), ("redundant", "off_topic")
    given = [("a", *fine), ("b", *fine), ("b", *fine), ("c", *off), ("d", "used", "supports_claim"), ("e", *fine), ("x", *fine), (None, *fine), ("g", None, None)]
    good, bad = rv.finalize_dispositions(units(["a", "a", "y", None]), units(["a", "b", "c", "d", "e", "f", "g", None]), spark.createDataFrame(given, "unit string, disposition string, reason string"))
    want = [("classified_though_used", "a"), ("missing", "None"), ("missing", "f"), ("reason_not_allowed", "c"), ("reason_not_allowed", "g"), ("repeated", "b"), ("unknown", "None"), ("unknown", "x"), ("used_but_not_cited", "d")]
    assert sorted((x.code, str(x.item)) for x in bad.collect()) == want
    assert sorted(tuple(x) for x in good.collect()) == [("a", "used", "supports_claim"), ("e", *fine)]
    assert "Join " not in bad._jdf.queryExecution().optimizedPlan().toString()


def test_rules_of_statement_revisions(spark):
    st = [(x, "f", i, x == "one", x.upper(), ["1", "2"]) for i, x in enumerate(["one", "two", "three", "four", "five", "six", "seven", "eight", "nine"])]
    items = "statement_id string, action string, items array<struct<statement:string,units:array<string>>>"
    given = [
        ("one", "delete", None), ("two", "replace", [(str(i), ["1"]) for i in range(5)]), ("three", "replace", None), ("four", "replace", [("", ["1"])]), ("five", "replace", [("x", ["9"])]),
        ("six", "shorten", None), ("seven", "replace", [("x", ["1"]), ("x", ["1"])]), ("eight", "replace", [("y" * 321, ["2"])]), ("ghost", "delete", None), ("nine", "delete", None), ("nine", "delete", None),
    ]
    statements = spark.createDataFrame(st, ST)
    out, bad = rv.revise_statements(statements, statements, spark.createDataFrame(given, items))
    want = [("item_count", "three"), ("item_count", "two"), ("item_empty", "four"), ("item_repeated", "seven"), ("item_too_long", "eight"), ("new_evidence", "five"), ("repeated", "nine"), ("single_deleted", "one"), ("unknown", "ghost"), ("unknown_action", "six")]
    assert found(bad) == want
    assert sorted(x.statement for x in out.collect()) == sorted(s[4] for s in st)


def test_revised_evidence_gets_new_ids(spark):
    df = spark.createDataFrame([("u1", "a", "old", ["c"]), ("u2", "b", "same", None), ("u3", "a", "gone", []), ("u4", "a", "x", []), ("u5", "a", "y", []), ("u6", "z", "stay", [])], "unit string, anchor_id string, claim string, caveats array<string>")
    given = [("u1", "replace", " new ", ["c"]), ("u2", "replace", "same ", []), ("u3", "delete", None, None), ("u4", "replace", "both", []), ("u5", "replace", "both", []), ("u9", "delete", None, None)]
    blocked = df.filter("unit <> 'u6'")
    kept, mapping, bad = rv.revise_evidence(df, blocked, spark.createDataFrame(given, "unit string, action string, claim string, caveats array<string>"))
    new = "unit_" + hashlib.sha256(b"a\x1fnew").hexdigest()[:24]
    assert found(mapping) == [("u1", "replace", new), ("u3", "delete", None)]
    assert found(bad) == [("id_repeated", "u4"), ("id_repeated", "u5"), ("unchanged", "u2"), ("unknown", "u9")]
    assert sorted((x.unit, x.claim) for x in kept.collect()) == sorted([(new, "new"), ("u2", "same"), ("u4", "x"), ("u5", "y"), ("u6", "stay")])


def unit_id(citations, claim):
    h = lambda *x: hashlib.sha256("\x1f".join(x).encode()).hexdigest()[:24]
    return "unit_" + h("anchor_" + h("g", "k", "\x1e".join(sorted(citations))), claim)


def test_auto_resolution_against_plain_python(spark):
    r = random.Random(7)
    units = [f"u{i:02}" for i in range(60)]
    claims = {u: f"claim {u}" for u in units}
    acts = {u: r.choice(["human_required", "keep_gate_override", "replace", "replace", "replace", "repair", None]) for u in units}
    target = {u: r.choice([*units, "lost"]) for u in units}
    acts |= {"u58": "replace", "u59": "replace"}  # a circle
    target |= {"u58": "u59", "u59": "u58"}
    statements = {f"s{i}": [r.choice(units) for _ in range(r.randrange(5))] for i in range(30)}
    old = {u: r.choice([("used", "supports_claim"), ("excluded", "off_topic"), ("peripheral", "low_confidence")]) for u in units}

    links = {u: target[u] for u, a in acts.items() if a == "replace" and target[u] in claims and target[u] != u} | {u: unit_id([u], claims[u]) for u, a in acts.items() if a == "repair"}

    def end(u):
        seen = set()
        while u in links:
            if u in seen:
                return None
            seen.add(u)
            u = links[u]
        return u

    mapping = {u: end(u) for u in links if end(u)}
    left = {s: list(dict.fromkeys(mapping.get(u, u) for u in ids)) for s, ids in statements.items() if s not in ("s1", "s2")}
    cited = {u for ids in left.values() for u in ids}
    final = {}
    for u in units:
        gone = acts[u] == "replace" and u in mapping
        now = links[u] if acts[u] == "repair" else u
        if not gone:
            final[now] = ("used", "supports_claim") if now in cited else old[u] if old[u][0] != "used" else ("redundant", "duplicate_support")

    full = {"replace": "replace_with_supported_evidence", "repair": "repair_citations"}
    evidence = spark.createDataFrame([(u, "g", "k", "", claims[u], ["q"]) for u in units], "unit string, generation string, kind string, anchor_id string, claim string, citations array<string>")
    issues = spark.createDataFrame([(u, "partially_supported", ["wording"]) for u in units if acts[u]], "unit string, verdict string, fragments array<string>")
    actions = spark.createDataFrame([(u, full.get(a, a), target[u], [u]) for u, a in acts.items() if a], "unit string, action string, replacement string, selected array<string>")
    quotes = spark.createDataFrame([(u, u) for u in units], "unit string, quote_id string")
    st = spark.createDataFrame([(s, "f", i, s == "s3", s, ids) for i, (s, ids) in enumerate(statements.items())], ST)
    wanted = spark.createDataFrame([("s1", "delete_misplaced", "s4"), ("s2", "delete_misplaced", "s5"), ("s3", "delete_misplaced", "s4"), ("s6", "delete_misplaced", "s6"), ("s7", "human_required", None)], "statement_id string, action string, canonical string")
    out = rv.auto_resolve(evidence, issues, actions, quotes, st, wanted, spark.createDataFrame([(u, *d) for u, d in old.items()], DISPOSITION))
    assert {x.unit: x.result for x in out["mapping"].collect()} == mapping and max(x.hops for x in out["mapping"].collect()) >= 3
    assert {x.statement_id: x.units for x in out["statements"].collect()} == left
    assert {x.unit: (x.disposition, x.reason) for x in out["dispositions"].collect()} == final
    assert sorted(x.unit for x in out["evidence"].collect()) == sorted(final)
    bad = [("mapping_cycle", u) for u in links if u not in mapping] + [("replacement_missing", u) for u, a in acts.items() if a == "replace" and u not in links]
    assert found(out["violations"]) == sorted([*bad, ("delete_not_allowed", "s3"), ("canonical_invalid", "s6")]) and any(u not in mapping for u in links)
    applied = {x.id: x.applied for x in out["log"].filter("kind = 'evidence'").collect()}
    assert applied == {u: a != "human_required" and (a == "keep_gate_override" or u in mapping) for u, a in acts.items() if a}


def test_overrides_need_harmless_fragments(spark):
    rows = [("partially_supported", ["wording"], True), ("partially_supported", [], True), ("partially_supported", None, True), ("partially_supported", ["增长"], False), ("partially_supported", ["a", "5"], False), ("unsupported", ["a"], False)]
    df = spark.createDataFrame(rows, "v string, f array<string>, want boolean")
    assert all(x.got == x.want for x in df.withColumn("got", rv.override_allowed(df.v, df.f)).collect())


def test_revision_judges_units_in_one_aggregate(spark):
    """Units went through a dozen joins, and each field was numbered in one task."""
    r = random.Random(3)
    st = [(str(i), "fg"[i % 2], i * 31 % 900 * 50, False, f"s{i}", [str(u) for u in r.sample(range(40), 2)]) for i in range(60)]
    statements = spark.createDataFrame(st, ST)
    blocked = spark.createDataFrame([(x[0],) for x in st[::3]], "statement_id string")
    given = [(x[0], "delete", []) if i % 2 else (x[0], "replace", [(f"n{i}", x[5][:1]), (f"m{i}", x[5][:1])]) for i, x in enumerate(st[::3])]
    revisions = spark.createDataFrame(given, "statement_id string, action string, items array<struct<statement:string,units:array<string>>>")
    evidence = spark.createDataFrame([(str(u),) for u in range(45)], "unit string")
    old = spark.createDataFrame([(str(u), "excluded", "off_topic") for u in range(38, 45)], DISPOSITION)
    new = spark.createDataFrame([("1", "excluded", "off_topic"), ("x", "used", "supports_claim")], DISPOSITION)
    revised, _, bad = rv.apply_revision(statements, blocked, revisions, evidence, old, new)
    after = [(f, p, 0, s, u) for i, f, p, _, s, u in st if int(i) % 3]
    after += [(x[1], x[2], n, y[0], y[1]) for x, g in zip(st[::3], given, strict=True) for n, y in enumerate(g[2])]
    by = {f: sorted(x for x in after if x[0] == f) for f in "fg"}
    assert found(revised.select("field", "pos", "statement", "units")) == sorted((f, i, x[3], x[4]) for f in by for i, x in enumerate(by[f]))
    before, cited = ({u for x in rows for u in x[-1]} for rows in (st, after))  # old dispositions of cited units are left out
    freed = before - cited
    want = [("released_missing", u) for u in freed - {"1"}] + [("released_unknown", u) for u in {"1", "x"} - freed]
    want += [("missing", str(u)) for u in range(38) if str(u) not in before]
    assert found(bad) == sorted(want)
    assert "Join" not in bad.filter("code LIKE 'released%'")._jdf.queryExecution().optimizedPlan().toString().split("Union")[-1]
    plan = revised._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(field#" in plan and "__block" in plan
