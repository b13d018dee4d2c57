"""The evidence contract on planted faults."""

from litspark.operators import contracts

TABLE = "指标 | 甲 | 乙\nx | 1 | 2\ny | 3 | 4\n\nname | 值 (%)\nz | 50\n"


def frames(spark, units, citations, extract=TABLE):
    lines, at, quotes = extract.split("\n"), 0, []
    for i, line in enumerate(lines):
        if line.strip():
            quotes.append((f"q{i}", "m", at, at + len(line), line))
        at += len(line) + 1
    materials = spark.createDataFrame([("m", "table", extract), ("p", "text", "成本预计降低5%，产量约为3吨。")], "material string, kind string, extract string")
    quotes += [("t0", "p", 0, 8, "成本预计降低5%"), ("t1", "p", 9, 14, "产量约为3吨"[:5])]
    q = spark.createDataFrame(quotes, "quote_id string, material string, start_char int, end_char int, text string")
    u = spark.createDataFrame(units, "unit string, material string, claim string")
    c = spark.createDataFrame(citations, "unit string, quote_id string")
    return u, c, q, materials


def found(df):
    return sorted(tuple(x) for x in df.collect())


def test_scopes_of_tables(spark):
    _, _, q, m = frames(spark, [("u", "m", "")], [("u", "q0")])
    got = {tuple(x) for x in contracts.scope_rows(m, q).collect()}
    assert got == {("m", 0, "header", "q0"), ("m", 0, "data", "q1"), ("m", 0, "data", "q2"), ("m", 1, "header", "q4"), ("m", 1, "data", "q5")}
    wide = "组 | 组\na | b | c | d\nx | 1 | 2 | 3 | 4\n--- | --- | --- | --- | ---\ny | 5 | 6 | 7 | 8\nz | 9\n"
    _, _, q, m = frames(spark, [("u", "m", "")], [("u", "q0")], wide)
    assert {x.quote_id for x in contracts.scope_rows(m, q).collect()} == {"q0", "q1", "q2", "q4"}
    for bad in ("a | b | c\nx | 1 | 2 | 3 | 4", "1 | 2\nx | 1", "a | b\n", "a | b | c\nx | y | z"):
        _, _, q, m = frames(spark, [("u", "m", "")], [("u", "q0")], bad)
        assert contracts.scope_rows(m, q).count() == 0, bad


def test_claims_on_tables(spark):
    units = [(u, "m", claim) for u, claim in (("all", "y 最高"), ("part", "y 最高"), ("two", "y 最高"), ("none", "y 最高"), ("small", "z 最高"), ("num", "x 为 1"), ("nohead", "x 为 1"), ("words", "x"))]
    cites = {"all": "q0 q1 q2", "part": "q0 q2", "two": "q0 q1 q2 q4", "none": "t0", "small": "q4 q5", "num": "q0 q1", "nohead": "q1", "words": "q1"}
    u, c, q, m = frames(spark, units, [(k, x) for k, v in cites.items() for x in v.split()])
    got = found(contracts.check_scopes(u, c, m, contracts.scope_rows(m, q)))
    assert got == sorted([("ranking_scope_incomplete", "part", "1"), ("ranking_scope_unprovable", "none", "0"), ("ranking_scope_unprovable", "small", "0"), ("number_header_missing", "nohead", "1")])
    # the second table has one row of data and can't rank, so "two" touches one scope only


def test_claims_and_citations(spark):
    units = [("ok", "p", "成本预计降低5%"), ("lost", "p", "成本降低5%"), ("number", "p", "成本预计降低6%"), ("held", "p", "产量约为3吨"), ("bare", "p", None)]
    cites = [("ok", "t0"), ("lost", "t0"), ("number", "t0"), ("held", "t1"), ("bare", "t0"), ("ok", "q0"), ("held", "zz"), ("ghost", "t0")]
    u, c, q, m = frames(spark, units, cites)
    assert found(contracts.claim_violations(u, c, q)) == sorted([("qualifier_dropped", "lost", "预计"), ("number_not_in_quotes", "number", "6%")])
    more = spark.createDataFrame([("number", "6%")], "unit string, fact string")
    assert found(contracts.claim_violations(u, c, q, more)) == [("qualifier_dropped", "lost", "预计")]
    assert found(contracts.citation_violations(u, c, q)) == [("quote_of_other_material", "ghost", "t0"), ("quote_of_other_material", "ok", "q0"), ("unknown_quote", "held", "zz")]


def test_results_and_candidates(spark):
    _, _, q, m = frames(spark, [("u", "m", "")], [("u", "q0")])
    rows = [("m", "evidence", "direct_evidence"), ("m", "unusable", "off_topic"), ("x", "context", None), (None, None, None)]
    results = spark.createDataFrame(rows, "material string, disposition string, reason string")
    codes = sorted((x.code, x.item) for x in contracts.result_violations(results, m).collect() if x.item)
    assert codes == [("reason_not_allowed", "m"), ("reason_not_allowed", "x"), ("result_missing", "p"), ("result_repeated", "m"), ("result_unknown", "x")]
    bad = q.unionByName(spark.createDataFrame([("q0", "m", 0, 2, "指标"), ("new", "m", 0, 1, "absent"), ("", "m", 0, 2, "指标"), ("e", "m", 0, 0, ""), ("far", "zz", 0, 1, "a")], q.schema))
    assert found(contracts.candidate_violations(bad, m)) == sorted([("quote_id_invalid", "q0", "2"), ("quote_id_invalid", "", "1"), ("quote_not_exact", "new", "m"), ("quote_invalid", "e", "m"), ("quote_invalid", "far", "zz")])
    nothing = m.limit(0)
    assert contracts.validate_evidence(results.limit(0), spark.createDataFrame([], "unit string, material string, claim string"), spark.createDataFrame([], "unit string, quote_id string"), q.limit(0), nothing).count() == 0
