"""Full audits: coverage in three layers, structure of papers, records of cards and samples, snapshots, replays and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.functions.arrays import is_separator_row, pipe_cells
from litspark.functions.text import KNOWN_TAGS, strip
from litspark.operators.evidence import evidence_violations
from litspark.operators.relations import overlapping

#: Limits of cards, roles of lines, titles that nobody wrote, and how a whole summary ends.
SUMMARY_MOST, SUMMARY_CUT, EXTRACT_MOST, CHUNK, CHAPTER = 500, 300, 1400, (80, 1600), (3, 700)
LINE_ROLES = ["scope_marker", "front_matter", "abstract", "keywords", "body", "back_matter"]
GENERIC_TITLE, POLLUTED_TITLE = r"(?i)^Evidence chunk \d+$", "Record|�|[A-Za-z]{2,}$"
WHOLE_END = r"[。！？!?；;.)）\]】]$"
#: Flags of cards that are issues by themselves.
FLAG_ISSUES = ["title.weak_inferred", "card.short_tail", "table.parse_failed", "table.row_too_long", "media.image_omitted"]
MARKUP = r"(?i)</?(?:" + "|".join(KNOWN_TAGS) + r")\b[^>]*>"


def codes(rules: list[tuple[str, Column]]) -> Column:
    """The codes whose condition holds, as an array."""
    return F.array_compact(F.array(*[F.when(found, F.lit(code)) for code, found in rules]))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def listed(condition: Column, item: str) -> Column:
    """Sorted items with a condition, of one document."""
    return F.array_sort(F.collect_list(F.when(condition, F.col(item))))


def layered_coverage(ledger: DataFrame, blocks: DataFrame, members: DataFrame, by: str, number: str) -> DataFrame:
    """Per document the shares of lines in one region, of wanted lines in blocks, and of blocks in cards, with lists of the others.

    ledger: by, number, assignment_count, role, one row for each line that isn't blank; blocks: by, block, start_line,
    end_line; members: by, card, block. Wanted lines are those of the abstract and the body. A document without lines or
    blocks has a share of 0; lists hold ids of one document only.
    """
    wanted = (F.col("assignment_count") == 1) & F.col("role").isin("abstract", "body")
    spans = blocks.select(F.col(by).alias("__by"), "start_line", "end_line")
    held = ledger.join(spans, (F.col(by) == F.col("__by")) & F.col(number).between(F.col("start_line"), F.col("end_line")), "left")
    held = held.groupBy(by, number).agg(F.first("assignment_count").alias("assignment_count"), F.first("role").alias("role"), F.count("start_line").alias("n_blocks"))
    n, in_block = F.col("assignment_count"), F.col("n_blocks") > 0
    lines = held.groupBy(by).agg(
        ratio(F.count_if((n == 1) & F.col("role").isNotNull()), F.count(F.lit(1))).alias("source_to_region_ratio"),
        ratio(F.count_if(wanted & in_block), F.count_if(wanted)).alias("region_to_block_ratio"),
        listed(n == 0, number).alias("unassigned_lines"),
        listed(n > 1, number).alias("multiple_lines"),
        listed(wanted & ~in_block, number).alias("unblocked_lines"),
    )
    cards = members.groupBy(by, "block").agg(F.count(F.lit(1)).alias("n_cards"))
    placed = blocks.select(by, "block").distinct().join(cards, [by, "block"], "left")
    in_cards = placed.groupBy(by).agg(
        ratio(F.count("n_cards"), F.count(F.lit(1))).alias("block_to_card_ratio"),
        listed(F.col("n_cards").isNull(), "block").alias("missing_blocks"),
        listed(F.col("n_cards") > 1, "block").alias("multiple_blocks"),
    )
    none = F.array().cast(blocks.select(F.array("block").alias("b")).schema["b"].dataType)
    out = lines.join(in_cards, by, "left").withColumn("block_to_card_ratio", F.coalesce("block_to_card_ratio", F.lit(0.0)))
    return out.withColumns({c: F.coalesce(c, none) for c in ("missing_blocks", "multiple_blocks")})


def ledger_mismatches(expected: DataFrame, ledger: DataFrame, by: str, number: str) -> DataFrame:
    """Documents whose ledger lacks, adds or repeats a line, or has one without exactly one known role."""
    e = expected.select(by, number).distinct().withColumn("__e", F.lit(True))
    good = (F.col("assignment_count") == 1) & F.col("role").isin(LINE_ROLES)
    found = ledger.groupBy(by, number).agg(F.count(F.lit(1)).alias("__n"), F.bool_and(F.coalesce(good, F.lit(False))).alias("__ok"))
    met = e.join(found, [by, number], "full_outer")
    fine = F.col("__e") & (F.col("__n") == 1) & F.col("__ok")
    return met.filter(~F.coalesce(fine, F.lit(False))).select(by).distinct()


def audit_structure(papers: DataFrame, runs: DataFrame, current: DataFrame, coverage: DataFrame, cards: DataFrame, regions: DataFrame, lines: DataFrame, ledger: DataFrame, by: str, number: str) -> DataFrame:
    """(by, code) of the issues of each paper's run, generation, coverage, regions and ledger.

    papers: by; runs: by, status, generation; current: by, generation of the cards in use; coverage: of
    ``layered_coverage``; cards and regions: by, start_line, end_line, regions with role; lines: those that aren't blank.
    A paper without a row of coverage has no proof of it; papers without a run have no issues of runs.
    """
    mark = lambda df, name: df.select(by).distinct().withColumn(name, F.lit(True))
    df = papers.select(by).distinct().join(runs.select(by, "status", F.col("generation").alias("__run")), by, "left")
    df = df.join(current.select(by, F.col("generation").alias("__cards"), F.lit(True).alias("__current")), by, "left").join(coverage.withColumn("__proof", F.lit(True)), by, "left")
    back = overlapping(cards, regions.filter("role = 'back_matter'"), by)
    for name, found in (("__any", cards), ("__back", back), ("__ledger", ledger), ("__off", ledger_mismatches(lines, ledger, by, number))):
        df = df.join(mark(found, name), by, "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    some = lambda c: F.size(c) > 0
    done, proof = F.coalesce(F.col("status") == "completed", F.lit(False)), has("__proof")
    rules = [
        ("run.latest_failed", F.col("status") == "failed"),
        ("material.no_current_cards", done & ~has("__any")),
        ("coverage.missing", ~proof),
        ("coverage.unassigned_source_line", proof & ((F.col("source_to_region_ratio") < 1) | some("unassigned_lines"))),
        ("coverage.overlapping_source_line", proof & some("multiple_lines")),
        ("coverage.unblocked_source_line", proof & ((F.col("region_to_block_ratio") < 1) | some("unblocked_lines"))),
        ("coverage.missing_body_content", proof & ((F.col("block_to_card_ratio") < 1) | some("missing_blocks"))),
        ("coverage.unexpected_overlap", proof & some("multiple_blocks")),
        ("region.back_matter_in_material", has("__back")),
        ("material.current_generation_missing", done & ~has("__current")),
        ("material.current_generation_mismatch", done & has("__current") & ~F.col("__cards").eqNullSafe(F.col("__run"))),
        ("coverage.line_ledger_missing", ~has("__ledger")),
        ("coverage.line_ledger_mismatch", has("__ledger") & has("__off")),
    ]
    return df.select(by, F.explode(codes(rules)).alias("code"))


def audit_card_records(cards: DataFrame, key: str) -> DataFrame:
    """(key, code) of the issues of each card's summary, extract, title, flags and span.

    cards: schema_version, material_type, summary, extract, clean_title, raw_title, quality_flags, span_lines, source_text.
    Nulls count as empty. An empty summary, title or extract has no other issue of that part.
    """
    value = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    summary, extract, clean, raw = value("summary"), value("extract"), value("clean_title"), value("raw_title")
    title = F.when(clean != "", clean).otherwise(raw)
    flags = F.coalesce("quality_flags", F.array().cast("array<string>"))
    second, long_row = F.col("schema_version").eqNullSafe(F.lit("material.v2")), F.array_contains(flags, "table.row_too_long")
    whole = F.when(F.coalesce("extract", F.lit("")) != "", F.col("extract")).otherwise(F.coalesce("source_text", F.lit("")))
    n_chars, n_lines, kind = F.length(whole), F.coalesce("span_lines", F.lit(0)), F.col("material_type")
    repeats = ((clean != "") & F.startswith(summary, clean)) | ((raw != "") & F.startswith(summary, raw))
    rules = [
        ("summary.empty", summary == ""),
        ("summary.contains_markup", summary.rlike(MARKUP)),
        ("summary.too_long", F.length(summary) > SUMMARY_MOST),
        ("summary.possibly_truncated", (F.length(summary) >= SUMMARY_CUT) & ~summary.rlike(WHOLE_END)),
        ("summary.repeats_title", (summary != "") & repeats),
        ("extract.empty", second & (extract == "")),
        ("extract.contains_markup", second & extract.rlike(MARKUP)),
        ("extract.too_long", second & (F.length(extract) > EXTRACT_MOST) & ~long_row),
        ("title.empty", title == ""),
        ("title.generic", title.rlike(GENERIC_TITLE)),
        ("title.polluted", title.rlike(POLLUTED_TITLE)),
        *[(flag, F.array_contains(flags, flag)) for flag in FLAG_ISSUES],
        ("chapter.too_short", (kind == "chapter") & (n_lines < CHAPTER[0])),
        ("chapter.too_long", (kind == "chapter") & (n_lines > CHAPTER[1])),
        ("chunk.too_short", (kind == "evidence_chunk") & (n_chars < CHUNK[0])),
        ("chunk.too_long", (kind == "evidence_chunk") & (n_chars > CHUNK[1])),
        ("card.too_long", second & (kind == "evidence_card") & (n_chars > EXTRACT_MOST) & ~long_row),
    ]
    return cards.select(key, F.explode(codes(rules)).alias("code"))


def sample_issues(records: DataFrame, key: str) -> DataFrame:
    """(key, code) of the issues of each sampled run, by the stage that failed and its checks.

    records: failure_stage, stage_reached, exception, checks (map of name to boolean; a check that wasn't made is absent).
    """
    text = F.lower(F.coalesce("exception", F.lit("")))
    check = lambda name: F.try_element_at(F.col("checks"), F.lit(name))
    yes = lambda name: F.coalesce(check(name), F.lit(False))
    no = lambda name: F.coalesce(~check(name), F.lit(False))
    at = lambda stage: F.col("failure_stage").eqNullSafe(F.lit(stage))
    late = F.contains(text, F.lit("timeout")) | F.contains(text, F.lit("超时"))
    plain = F.contains(text, F.lit("no headings found"))
    tree = yes("summary_tree_exists")
    rules = [
        ("convert_timeout", at("convert") & late),
        ("convert_failed", at("convert") & ~late),
        ("parse_no_headings", at("parse") & plain),
        ("parse_failed", at("parse") & ~plain),
        ("summary_failed", at("summarize")),
        ("convert_missing_full_md", no("convert_full_md_exists")),
        ("convert_markdown_short", yes("convert_markdown_too_short")),
        *[(f"parse_{part}_missing", no(f"parse_{part}_exists") & ~at("parse")) for part in ("structure", "diagnostics", "outline")],
        ("parse_no_body_nodes", yes("parse_no_body_nodes")),
        ("parse_outline_mismatch", no("parse_outline_matches_structure") & yes("parse_structure_exists")),
        ("parse_low_confidence_high", yes("parse_low_confidence_abnormal")),
        ("parse_refinement_fallback_not_recorded", no("parse_refinement_fallback_recorded")),
        ("summary_artifacts_missing", no("summary_artifacts_complete") & ~at("summarize") & F.col("stage_reached").isin("summarized", "failed")),
        ("summary_version_mismatch", no("summary_version_ok") & tree),
        ("summary_root_mismatch", no("summary_root_count_match") & tree),
        ("summary_depends_on_sections", no("summary_independent_of_sections")),
        ("summary_stage_missing", no("summary_stage_recorded") & tree),
        ("slow_processing", yes("slow_processing")),
    ]
    return records.select(key, F.explode(codes(rules)).alias("code"))


def sample_patterns(records: DataFrame, key: str, n: int = 3, salts: int = 16) -> DataFrame:
    """Per recurring pattern of sampled runs its count and its first ids: large files that fail to convert, theses without
    a body, long documents whose summary fails, tiny files with little text, and groups of duplicates (without ids).

    records: also bucket, category, duplicate_key. First ids are cut in salted parts before a pattern's rows meet.
    """
    failed = lambda stage: F.col("failure_stage").eqNullSafe(F.lit(stage))
    check = lambda name: F.try_element_at(F.col("checks"), F.lit(name))
    large = F.col("bucket").isin("l", "xl")
    rules = [
        ("large_convert", failed("convert") & large),
        ("thesis_without_body", (F.col("category") == "thesis_like") & check("parse_no_body_nodes")),
        ("long_summary", large & (failed("summarize") | F.coalesce(~check("summary_root_count_match"), F.lit(False)))),
        ("tiny_markdown", (F.col("bucket") == "xs") & check("convert_markdown_too_short")),
    ]
    long = records.select(key, F.explode(codes(rules)).alias("pattern"))
    nth = lambda d, *by: d.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(key))).filter(F.col("__k") <= n).drop("__k")
    few = nth(nth(long.withColumn("__s", F.pmod(F.xxhash64(key), F.lit(salts))), "pattern", "__s").drop("__s"), "pattern")
    ids = few.groupBy("pattern").agg(F.array_sort(F.collect_list(key)).alias("first_ids"))  # n a pattern
    found = long.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).join(ids, "pattern")
    groups = records.filter("duplicate_key IS NOT NULL").groupBy("duplicate_key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    groups = groups.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("duplicate_files").alias("pattern"), "n")
    return found.unionByName(groups.withColumn("first_ids", F.array().cast(found.schema["first_ids"].dataType)))


def snapshot_violations(wanted: DataFrame, papers: DataFrame, cards: DataFrame, paper: str, card: str, generation: str, fingerprint: str) -> DataFrame:
    """(paper, code): why the cards of a wanted paper can't be a snapshot.

    papers: paper, status, generation. A paper needs one row, a completed run with a generation, and cards with different
    ids, that generation and fingerprints.
    """
    p = papers.groupBy(paper).agg(F.count(F.lit(1)).alias("__rows"), F.min("status").alias("__status"), F.min(generation).alias("__now"))
    df = wanted.select(paper).distinct().join(p, paper, "left")
    ids = cards.groupBy(paper, card).agg(F.count(F.lit(1)).alias("__c"), F.count_if(F.coalesce(F.col(fingerprint), F.lit("")) == "").alias("__f"), F.min(generation).alias("__g0"), F.max(generation).alias("__g1"), F.count_if(F.col(generation).isNull()).alias("__gn"))
    empty = F.coalesce(F.col(card).cast("string"), F.lit("")) == ""
    held = ids.groupBy(paper).agg(F.sum("__c").alias("__n"), F.bool_or(empty).alias("__empty"), F.bool_or(~empty & (F.col("__c") > 1)).alias("__twice"), F.sum("__f").alias("__bare"), F.min("__g0").alias("__low"), F.max("__g1").alias("__high"), F.sum("__gn").alias("__none"))
    df = df.join(held, paper, "left")
    one, any_card = F.coalesce(F.col("__rows") == 1, F.lit(False)), F.col("__n").isNotNull()
    mixed = (F.col("__none") > 0) | ~F.col("__low").eqNullSafe(F.col("__now")) | ~F.col("__high").eqNullSafe(F.col("__now"))
    rules = [
        ("not_one_paper", ~one),
        ("not_completed", one & ~F.col("__status").eqNullSafe(F.lit("completed"))),
        ("no_generation", one & (F.coalesce(F.col("__now").cast("string"), F.lit("")) == "")),
        ("no_cards", ~any_card),
        ("empty_id", F.col("__empty")),
        ("repeated_id", F.col("__twice")),
        ("generation_mismatch", any_card & mixed),
        ("fingerprint_missing", F.col("__bare") > 0),
    ]
    return df.select(paper, F.explode(codes(rules)).alias("code"))


def replay_contract(batches: DataFrame, units: DataFrame, batch: str, passed_before: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """Stored batches validated again: per code the batches that break it and those of them that had passed, and under
    code null the batches that break none."""
    broken = evidence_violations(units, batch, rules).distinct()
    met = batches.select(batch, F.coalesce(F.col(passed_before), F.lit(False)).alias("__before")).join(broken, batch, "left")
    return met.groupBy("code").agg(F.count(F.lit(1)).alias("n_batches"), F.count_if(F.col("code").isNotNull() & F.col("__before")).alias("newly_failed"))


def percent_cells(cards: DataFrame, card: str, text: str) -> DataFrame:
    """(card, row_label, column_label, fact): numbers below a column whose label names percent; the label of a row is its
    first cell. The first row of a card that has pipes is the header."""
    lines = cards.select(card, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("__line", "__t")).filter(F.contains("__t", F.lit("|")))
    rows = lines.withColumn("__cells", pipe_cells(F.col("__t"))).filter(~is_separator_row(F.col("__cells")))
    head = rows.groupBy(card).agg(F.min_by("__cells", "__line").alias("__head"), F.min("__line").alias("__first"))
    met = rows.join(head, card).filter("__line > __first").filter(F.size("__cells") == F.size("__head"))
    pairs = F.transform(F.col("__cells"), lambda x, i: F.struct(F.get("__head", i).alias("label"), x.alias("value")))
    pairs = met.select(card, F.get("__cells", F.lit(0)).alias("row_label"), F.posexplode(pairs).alias("__i", "__c")).filter("__i > 0")
    label, value = F.col("__c.label"), F.trim("__c.value")
    named = label.rlike("[%％]") & value.rlike(r"^[0-9]+(\.[0-9]+)?$")
    bare = F.trim(F.regexp_replace(label, r"[(（]?\s*[%％]\s*[)）]?", ""))
    return pairs.filter(named).select(card, "row_label", bare.alias("column_label"), F.concat(value, F.lit("%")).alias("fact"))


def audit_tables(cards: DataFrame, card: str, text: str) -> DataFrame:
    """(card, status) of each card that is a table: no_percent, recognised if a number belongs to a column of percent, else rejected."""
    tables = cards.filter(F.contains(F.col(text), F.lit("|"))).select(card, F.col(text).rlike("[%％]").alias("__percent"))
    found = percent_cells(cards, card, text).select(card).distinct().withColumn("__found", F.lit(True))
    status = F.when(F.col("__found"), "recognised").when(F.col("__percent"), "rejected").otherwise("no_percent")
    return tables.join(found, card, "left").select(card, status.alias("status"))


def match_percent_claims(claims: DataFrame, cells: DataFrame, card: str, claim_id: str, claim: str, compact) -> DataFrame:
    """(claim_id, fact, column_label, row_label): cells that a claim names.

    The fact has to stand in the claim exactly once; of the labels of columns with that fact the nearest before it counts;
    the row's label has to be in the claim, and of several the longest ones. ``compact`` is the form in which they are compared.
    """
    c = claims.select(claim_id, card, compact(F.col(claim)).alias("__c"))
    t = cells.withColumns({"__f": compact(F.col("fact")), "__col": compact(F.col("column_label")), "__row": compact(F.col("row_label"))})
    met = c.join(t, card).filter((F.col("__f") != "") & (F.col("__col") != ""))
    met = met.filter(F.length("__c") - F.length(F.replace("__c", F.col("__f"), F.lit(""))) == F.length("__f"))
    before = F.call_function("substring_index", F.col("__c"), F.col("__f"), F.lit(1))
    behind = F.call_function("instr", F.reverse(before), F.reverse("__col"))
    met = met.withColumn("__at", F.when(behind > 0, F.length(before) - behind - F.length("__col") + 1))
    w = Window.partitionBy(claim_id, "fact")
    met = met.withColumn("__near", F.max("__at").over(w)).filter((F.col("__at") == F.col("__near")) & (F.col("__row") != "") & F.contains("__c", F.col("__row")))
    met = met.withColumn("__long", F.max(F.length("__row")).over(w)).filter(F.length("__row") == F.col("__long"))
    return met.select(claim_id, "fact", "column_label", "row_label").distinct()


def supported_replacements(blocked: DataFrame, supported: DataFrame, cards: DataFrame, paper: str, unit: str, text: str, order: str, facts, least: float = 0.35) -> DataFrame:
    """(blocked, candidate, similarity): supported units that may stand in for a blocked one.

    blocked: paper, unit, text, cards (cited), needed (numbers of the statements that rest on it); supported: paper, unit,
    text, cards, support (claim and quotations); cards: paper, card, order. All cards of a candidate are cited by the
    blocked unit or next to one it cites, the texts resemble each other by bigrams, and the support holds all numbers
    needed (``facts`` reads them). Units meet on a candidate's least card only, not on the paper.
    """
    from litspark.functions.text import bigram_jaccard, bigrams

    placed = cards.select(paper, "card", F.row_number().over(Window.partitionBy(paper).orderBy(order, "card")).alias("__p"))
    cited = blocked.select(paper, unit, F.explode(F.array_distinct("cards")).alias("card")).join(placed, [paper, "card"])
    near = cited.select(paper, unit, F.explode(F.sequence(F.col("__p") - 1, F.col("__p") + 1)).alias("__p")).distinct().join(placed, [paper, "__p"])
    allowed = near.groupBy(paper, unit).agg(F.collect_set("card").alias("__allowed"))  # three a cited card
    b = blocked.join(allowed, [paper, unit]).select(paper, F.col(unit).alias("blocked"), bigrams(F.col(text)).alias("__b"), "needed", "__allowed", F.explode("__allowed").alias("__meet"))
    s = supported.filter(F.size("cards") > 0).select(paper, F.col(unit).alias("candidate"), bigrams(F.col(text)).alias("__s"), "cards", facts(F.col("support")).alias("__facts"), F.array_min("cards").alias("__meet"))
    met = b.join(s, [paper, "__meet"]).filter((F.size(F.array_except("cards", "__allowed")) == 0) & (F.size(F.array_except("needed", "__facts")) == 0))
    met = met.withColumn("similarity", bigram_jaccard(F.col("__b"), F.col("__s"))).filter(F.col("similarity") >= least)
    return met.select("blocked", "candidate", F.round("similarity", 4).alias("similarity"))


def theme_members(assigned: DataFrame, items: DataFrame, themes: DataFrame, key: str, theme: str) -> DataFrame:
    """(kind, id): items in no theme, items in several, and themes without items, one row each."""
    pairs = assigned.select(key, theme).distinct()
    many = pairs.groupBy(key).count().filter("count > 1").select(F.lit("multi_theme").alias("kind"), F.col(key).alias("id"))
    none = items.select(key).distinct().join(pairs, key, "left_anti").select(F.lit("unassigned").alias("kind"), F.col(key).alias("id"))
    unused = themes.select(theme).distinct().join(pairs, theme, "left_anti").select(F.lit("unused").alias("kind"), F.col(theme).alias("id"))
    return none.unionByName(many).unionByName(unused)
