"""Operators on small inline tables."""

from pyspark.sql import functions as F

from litspark.operators import bib, cards, evidence, relations, structure
from litspark.sources import readers, sinks
from litspark.streaming import corpus


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_clean_records_counts_every_reason(spark):
    df = spark.createDataFrame([(None, "s", "k"), ("a", "", "k"), ("a", "s", " "), ("a", "<正>x", "k"), ("a", "s", "k")], "author string, summary string, keyword string")
    counts = dict(bib.reason_counts(bib.clean_records(df, bib.record_rules("author", "summary", "keyword"))).collect())
    assert counts == {"no_author": 1, "no_summary": 1, "no_keyword": 1, "short_notice": 1, "kept": 1}


def test_dedup_hits_prefers_source_only_for_titles(spark):
    hits = spark.createDataFrame([(1, "10.1/a", "T", "low"), (2, "doi:10.1/A", "T", "high"), (3, None, "A title!", "low"), (4, None, "a Title", "high"), (5, None, "", "high")], "pos int, doi string, title string, source string")
    assert rows(bib.dedup_hits(hits, "doi", "title", "source", "pos", {"high": 3}).select("pos"), "pos") == [(1,), (4,)]


def test_stale_papers_leave_as_a_whole(spark):
    runs = spark.createDataFrame([("p", 1), ("q", 1)], "paper string, gen int")
    found = spark.createDataFrame([("p", 1, 1), ("p", 2, 0), ("q", 1, 1)], "paper string, card int, gen int")
    kept, stale = relations.rebuild_corpus(runs, found, "paper", "gen")
    assert rows(kept.select("paper", "card"), "paper") == [("q", 1)] and rows(stale, "paper") == [("p",)]


def test_stale_papers_are_found_without_a_second_copy_of_cards(spark):
    """Cards were joined twice, so that a task sorted them twice at a time."""
    cards = spark.range(9).selectExpr("id AS paper", "id % 2 AS gen")
    kept, _ = relations.rebuild_corpus(cards.filter("paper > 3"), cards, "paper", "gen")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_packing(spark):
    sizes = [500, 500, 300, 900, 150, 1300, 100]
    blocks = spark.createDataFrame([("d", i, chr(97 + i) * n) for i, n in enumerate(sizes)], "doc string, o int, t string")
    packed = cards.pack_cards(blocks, "doc", "o", "t").orderBy("first").collect()
    assert "\n\n".join(r.extract for r in packed) == "\n\n".join(chr(97 + i) * n for i, n in enumerate(sizes))
    assert sum(r.n_blocks for r in packed) == len(sizes)
    assert [(r.first, r.last) for r in packed] == [(0, 1), (2, 2), (3, 4), (5, 6)] or packed[-1].short_tail
    assert cards.pack_cards(blocks.limit(0), "doc", "o", "t").count() == 0


def test_heading_paths_reset_on_jumps(spark):
    h = spark.createDataFrame([("d", 1, 1, "a"), ("d", 2, 2, "b"), ("d", 3, 4, "c"), ("d", 4, 1, "e")], "doc string, line int, depth int, title string")
    got = dict(structure.heading_paths(h, "doc", "line", "depth", "title").select("title", F.array_join("path", ">")).collect())
    assert got == {"a": "a", "b": "a>b", "c": "c", "e": "e"}


def test_plain_headings_need_a_neighbour(spark):
    lines = ["", "1 Intro", "", "text", "", "2 Methods", "", "2000 people", "", "9 Alone", "", "# Title", "x"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines, 1)], "doc string, n int, t string")
    assert {r.title for r in structure.extract_headings(df, "doc", "n", "t").collect()} == {"1 Intro", "2 Methods", "Title"}


def test_noise_and_blanks(spark):
    lines = ["Head", "Head", "12", "[3]", "Figure 2 x", "----", "", "", "", "body"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc string, n int, t string")
    assert [r.t for r in structure.clean_lines(df, "doc", "n", "t").orderBy("n").collect()] == ["Head", "", "", "", "body"]
    assert structure.collapse_blanks(df, "doc", "n", "t").filter("t = ''").count() == 2


def test_gate_order(spark):
    first = spark.createDataFrame([(i, v) for i, v in enumerate(["directly_supported", "partial", "partial", "partial", "partial", "partial"])], "u int, verdict string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "u int")
    confirm = spark.createDataFrame([(4, "directly_supported"), (5, "unsupported")], "u int, verdict string")
    got = rows(evidence.gate_decisions(first, confirm, ids(1, 2), ids(1), "u").select("u", "decision"), "u")
    assert [d for _, d in got] == ["passed_first_pass", "passed_quote_containment", "accepted_human_override", "confirmation_missing", "gate_disagreement", "confirmed_blocker"]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Title: One\nYear: 2001\n<R>\nYear: 2002\n<R>\nTitle: Two\n")
    got = readers.read_tagged_export(spark, str(tmp_path / "a.txt"), "<R>", {"title": r"Title: (.+)", "year": r"Year: (\d+)"})
    assert {(r.title, r.year) for r in got.collect()} == {("One", "2001"), ("Two", None)}
    (tmp_path / "v.jsonl").write_text('{"schema_version": "1", "x": 2}\n\n{"schema_version": "0"}\n{bad\n')
    good, bad = readers.read_versioned(spark, str(tmp_path / "v.jsonl"), "schema_version STRING, x INT", "1")
    assert good.count() == 1 and {r.reason for r in bad.collect()} == {"wrong_version", "malformed"}
    (tmp_path / "md/p1/normalized").mkdir(parents=True)
    (tmp_path / "md/p1/normalized/document.md").write_text("# T\nx")
    (tmp_path / "md/_x/normalized").mkdir(parents=True)
    (tmp_path / "md/_x/normalized/document.md").write_text("no")
    assert [r.paper_id for r in readers.read_markdown_corpus(spark, str(tmp_path / "md")).collect()] == ["p1"]
    df = spark.createDataFrame([("A/b", "body")], "title string, body string")
    sinks.write_articles(df, "title", "body", str(tmp_path / "out"))
    assert list((tmp_path / "out").glob("file_name=A_b.md/*.txt"))
    (tmp_path / "c.json").write_text('{"topic": "t", "papers": [{"paper_id": "a", "source": "s"}, {"paper_id": "a", "source": "u/v"}]}')
    assert {r.code for r in readers.read_collection(spark, str(tmp_path / "c.json"))[1].collect()} == {"repeated_paper_id"}
    payload = spark.createDataFrame([('{"title": "T", "publication_date": "1999-01-02", "authorships": [{"author": {"display_name": "N"}}], "counts_by_year": [{"year": 1, "cited_by_count": 2}, {"cited_by_count": 3}]}',)], "j string")
    hit = readers.parse_search_payload(payload, "j").first()
    assert (hit.year, hit.citation, hit.authors) == (1999, 5, ["N"])


def test_quotes_without_a_key(spark):
    quotes = spark.createDataFrame([(1, "nd the longestword of al"), (2, "absent words here")], "q int, quote string")
    texts = spark.createDataFrame([(1, "and the longestword of all"), (2, "the longestword")], "d int, text string")
    assert rows(relations.find_quotes(quotes, texts, "quote", "text").select("q", "d"), "q") == [(1, 1)]


def test_quotes_are_found_where_contains_holds(spark):
    given = ["alpha - beta", "x | y", "lpha", "gamma", "a", "", "one two", "cut line\nwith break her", "nd the longestword of al", " ", "ß", "no such quote here", "0123456789abcdef", None, "lpha"]
    held = ["alpha gamma", "alpha - beta", "x | y", "a", "", "the cut line\nwith break here", "one two three", "and the longestword of all", "x0123456789abcdefg", "weiß", None, "alpha gamma"]
    quotes = spark.createDataFrame(list(enumerate(given)), "q int, quote string")
    texts = spark.createDataFrame(list(enumerate(held)), "d int, text string")
    want = [(i, j) for i, q in enumerate(given) for j, t in enumerate(held) if q is not None and t is not None and q in t]
    assert rows(relations.find_quotes(quotes, texts, "quote", "text").select("q", "d"), "q", "d") == want
