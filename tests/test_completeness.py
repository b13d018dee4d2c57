"""The full audits on inline tables, and the record source."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from litspark.functions import numeric, text
from litspark.operators import completeness as full
from litspark.operators import structure
from litspark.sources import readers, record_source


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_layers_of_empty_and_doubled_papers(spark):
    ledger = spark.createDataFrame([("p", 1, 1, "body"), ("p", 2, 1, "body"), ("p", 3, 0, None), ("p", 4, 2, "body"), ("q", 1, 1, "keywords")], "k string, n int, assignment_count int, role string")
    blocks = spark.createDataFrame([("p", "b1", 1, 1), ("p", "b2", 9, 9)], "k string, block string, start_line int, end_line int")
    members = spark.createDataFrame([("p", "c1", "b1"), ("p", "c2", "b1")], "k string, card string, block string")
    got = {r.k: r for r in full.layered_coverage(ledger, blocks, members, "k", "n").collect()}
    p, q = got["p"], got["q"]
    assert (p.source_to_region_ratio, p.region_to_block_ratio, p.block_to_card_ratio) == (0.5, 0.5, 0.5)
    assert (p.unassigned_lines, p.multiple_lines, p.unblocked_lines, p.missing_blocks, p.multiple_blocks) == ([3], [4], [2], ["b2"], ["b1"])
    assert (q.source_to_region_ratio, q.region_to_block_ratio, q.block_to_card_ratio, q.missing_blocks) == (1.0, 0.0, 0.0, [])
    assert full.layered_coverage(ledger.limit(0), blocks.limit(0), members.limit(0), "k", "n").count() == 0


def test_ledger_repeats_and_unknown_roles(spark):
    lines = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "k string, n int")
    ledger = spark.createDataFrame([("a", 1, 1, "body"), ("b", 1, 1, "body"), ("b", 1, 1, "body"), ("c", 1, 1, "index"), ("d", 1, 1, "body"), ("d", 2, 1, "body")], "k string, n int, assignment_count int, role string")
    assert rows(full.ledger_mismatches(lines, ledger, "k", "n"), "k") == [("b",), ("c",), ("d",)]


def test_card_records_with_nulls(spark):
    schema = "id int, schema_version string, material_type string, summary string, extract string, clean_title string, raw_title string, quality_flags array<string>, span_lines int, source_text string"
    df = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, None), (2, "material.v2", "evidence_card", "<b>方法</b> 如下", "x" * 1401, None, "方法", ["table.row_too_long"], 5, None), (3, None, "evidence_chunk", "方法是", None, "方法", None, [], 5, "short")], schema)
    assert rows(full.audit_card_records(df, "id"), "id", "code") == [(1, "summary.empty"), (1, "title.empty"), (2, "summary.contains_markup"), (2, "table.row_too_long"), (3, "chunk.too_short"), (3, "summary.repeats_title")]


def test_percent_claims_in_compatibility_form(spark):
    card = "| 船型 | 占比（％） | 数量 |\n|---|---|---|\n| 油轮 | 12.5 | 3 |\n| 大型油轮 | 12.5 | 4 |"
    cells = full.percent_cells(spark.createDataFrame([(1, card)], "c int, t string"), "c", "t")
    assert rows(cells, "row_label") == [(1, "大型油轮", "占比", "12.5%"), (1, "油轮", "占比", "12.5%")]
    claims = spark.createDataFrame([(1, "a", "大型油轮的占 比为１２.5％"), (1, "b", "12.5% 是油轮占比"), (1, "c", "油轮占比 12.5%，又 12.5%"), (1, "d", None)], "c int, id string, claim string")
    compact = lambda c: F.lower(text.compact_nfkc(c))
    assert rows(full.match_percent_claims(claims, cells, "c", "id", "claim", compact), "id") == [("a", "12.5%", "占比", "大型油轮")]


def test_replacements_need_cards_numbers_and_likeness(spark):
    cards = spark.createDataFrame([("p", i, i) for i in range(5)], "p string, card int, o int")
    blocked = spark.createDataFrame([("p", "u", "fuel use fell by 5%", [1], ["5%"])], "p string, unit string, t string, cards array<int>, needed array<string>")
    given = [("near", "fuel use fell by 5%", [0, 2], "fell 5%"), ("far", "fuel use fell by 5%", [2, 3], "5%"), ("no number", "fuel use fell by 5%", [1], "fell"), ("unlike", "zzz", [1], "5%"), ("no card", "fuel use fell by 5%", [], "5%")]
    supported = spark.createDataFrame([("p", *g) for g in given], "p string, unit string, t string, cards array<int>, support string")
    assert rows(full.supported_replacements(blocked, supported, cards, "p", "unit", "t", "o", numeric.numeric_facts)) == [("u", "near", 1.0)]


def test_first_ids_are_the_least(spark):
    df = spark.range(100).selectExpr("id", "'convert' AS failure_stage", "'xl' AS bucket", "'x' AS category", "cast(null AS string) AS duplicate_key", "map('a', true) AS checks")
    assert rows(full.sample_patterns(df, "id")) == [("large_convert", 100, [0, 1, 2])]


@pytest.mark.parametrize("a,b", [("abcdef", "abXdef"), ("", "x"), ("同样的话", "话同样的"), ("aaaa", "aa")])
def test_overlap_and_ratio_against_difflib(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    share, ratio = df.select(text.char_overlap("a", "b").alias("x"), text.matcher_ratio("a", "b").alias("y")).first()
    kept = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    assert share == (kept / len(a) if a else 0.0) and ratio == difflib.SequenceMatcher(None, a, b).ratio()


def test_record_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Title: One\nYear: 2001\n<R>\nYear: 2002\n<R> \n<R>Title: Two\nYear: ")
    (tmp_path / "in/b.txt").write_text("")
    record_source.register(spark)
    read = lambda path: spark.read.format("tagged_records").option("separator", "<R>").option("field.title", r"Title: (.+)").option("field.year", r"Year: *(\d*)").load(str(path))
    got = rows(read(tmp_path / "in").select("pos", "title", "year"), "pos")
    assert got == [(0, "One", "2001"), (1, None, "2002"), (2, "Two", None)] == rows(read(f"file://{tmp_path}/in/a.txt").select("pos", "title", "year"), "pos")
    (tmp_path / "none").mkdir()
    assert read(tmp_path / "none").count() == 0
    assert list(record_source.pieces(iter([b"a<", b"R>b<R", b">", b"c"]), b"<R>")) == [b"a", b"b", b"c"]


def test_other_readers(spark, tmp_path):
    (tmp_path / "b.txt").write_text("T: a\nmore\n\nno tag\n\nT: c\n")
    got = readers.read_blank_separated(spark, str(tmp_path / "b.txt"), "T:", {"t": r"(?s)T: (.+)"})
    assert sorted(r.t for r in got.collect()) == ["a\nmore", "c"]
    md = spark.createDataFrame([("# A title\n**Author**: X Y\nType： review\n",)], "md string")
    found = readers.read_article_md(md, "md", {"author": "Author", "kind": "Type", "none": "Number"}).first()
    assert (found.title, found.author, found.kind, found.none) == ("A title", "X Y", "review", None)
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.pdf").write_bytes(b"12345")
    (tmp_path / "d/x.txt").write_bytes(b"1")
    assert [r.size_bytes for r in readers.scan_inventory(spark, str(tmp_path / "d")).collect()] == [5]
    (tmp_path / "c.csv").write_text("unit,decision\nu1,accept\n")
    assert rows(readers.read_decisions(spark, str(tmp_path / "c.csv"), "unit STRING, decision STRING")) == [("u1", "accept")]
    (tmp_path / "w.csv").write_text("unit,other\nu1,accept\n")
    with pytest.raises(Exception, match="header|Header|CSV"):
        readers.read_decisions(spark, str(tmp_path / "w.csv"), "unit STRING, decision STRING").collect()


def hierarchy_of(rows, profile):
    """Parents and levels of one document, heading by heading."""
    done, out = [], {}
    for at, family, path, depth in rows:
        parent = None
        for b_at, b_family, b_path, b_depth in reversed(done):
            if family == "plain":
                fits = b_depth < depth
            elif family == "decimal_path" and len(path) > 2:
                fits = b_family == "decimal_path" and b_path == path[:-1]
            else:
                rules = structure.PARENTS.get(family, {})
                fits = b_family in rules.get(profile, rules.get("", []))
            if fits:
                parent = b_at
                break
        fallback = False
        if parent is None and not (family in structure.ROOTS):
            fallback = True
            parent = next((b[0] for b in reversed(done) if out[b[0]][1] == 1), None)
        out[at] = (parent, 1 if parent is None else out[parent][1] + 1, fallback)
        done.append((at, family, path, depth))
    return out


def test_family_hierarchy_against_plain_python(spark):
    kinds = ["chapter_cn", "cn_main", "cn_paren", "arabic_main", "arabic_paren", "circled", "decimal_path", "plain"]
    draw = random.Random(7)
    docs = {}
    for d in range(60):
        some = draw.sample(kinds, draw.randint(1, 8))
        docs[d] = [(i * 3, f, [draw.randint(1, 2) for _ in range(draw.randint(2, 4))] if f == "decimal_path" else [1], draw.randint(1, 4)) for i, f in enumerate(draw.choices(some, k=draw.randint(1, 14)))]
    df = spark.createDataFrame([(d, *r) for d, rs in docs.items() for r in rs], "doc int, n int, family string, path array<int>, depth int").repartition(5)
    profiles = structure.numbering_profile(df, "doc", "n", "family", 0.15)
    known = {r.doc: r.profile for r in profiles.collect()}
    assert set(known.values()) == {"chapter_decimal", "journal_mixed_cn", "decimal_only", "mixed_unknown"}
    got = {(r.doc, r.n): (r.parent, r.level, r.fallback) for r in structure.family_hierarchy(df, profiles, "doc", "n").collect()}
    assert got == {(d, n): v for d, rs in docs.items() for n, v in hierarchy_of(rs, known[d]).items()}
    assert structure.family_hierarchy(df.limit(0), profiles, "doc", "n").count() == 0


def test_profile_of_first_headings(spark):
    rows_ = [("a", i, "plain") for i in range(5)] + [("a", 9, "arabic_main")] + [("b", 1, "cn_main"), ("b", 2, "arabic_main")] + [("c", i, "plain") for i in range(30)] + [("c", 40, "arabic_main")]
    df = spark.createDataFrame(rows_, "doc string, n int, family string")
    assert rows(structure.numbering_profile(df, "doc", "n", "family", 0.15), "doc") == [("a", "decimal_only"), ("b", "journal_mixed_cn"), ("c", "mixed_unknown")]
