"""The contract of extracted evidence: coverage, reasons, quotes, citations, numbers, qualifiers and scopes of tables.

Tables: materials (material, kind, extract); quotes (quote_id, material, start_char, end_char, text); results (material,
disposition, reason), what came back for each material; units (unit, material, claim); citations (unit, quote_id).
Violations are rows (code, item, detail): the material, quote or unit at fault, and what is wrong with it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.functions.arrays import is_separator_row, pipe_cells
from litspark.functions.numeric import numeric_facts
from litspark.functions.text import qualifiers_dropped
from litspark.operators.trees import written

#: Which reasons go with which disposition, and words by which a claim ranks the rows of a table.
REASONS = {"evidence": ["direct_evidence"], "context": ["context_only"], "not_relevant": ["off_topic"], "unusable": ["parse_damage", "empty_or_nontext", "duplicate_content"]}
RANKING = "最高|最低|最大|最小|居首|居末|排名第一|排名最后"


def violations(df: DataFrame, item: Column, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """(code, item, detail) for each rule (code, whether it is broken, detail); a null condition isn't broken."""
    found = [F.when(bad, F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail"))) for code, bad, detail in rules]
    return df.select(item.cast("string").alias("item"), F.explode(F.array_compact(F.array(*found))).alias("v")).select("v.code", "item", "v.detail")


def result_violations(results: DataFrame, materials: DataFrame) -> DataFrame:
    """Every material has exactly one result, with a reason that its disposition allows."""
    seen = results.groupBy("material").agg(F.count(F.lit(1)).alias("n"))
    met = materials.select("material", F.lit(True).alias("known")).join(seen, "material", "full_outer")
    none = F.lit(None)
    covered = violations(met, F.col("material"), [("result_missing", F.col("n").isNull(), none), ("result_unknown", F.col("known").isNull(), none), ("result_repeated", F.col("n") > 1, F.col("n"))])
    allowed = F.create_map(*[x for d, rs in REASONS.items() for x in (F.lit(d), F.array(*[F.lit(r) for r in rs]))])
    fits = F.array_contains(F.coalesce(F.try_element_at(allowed, F.col("disposition")), F.array().cast("array<string>")), F.col("reason"))
    return covered.unionByName(violations(results, F.col("material"), [("reason_not_allowed", ~F.coalesce(fits, F.lit(False)), F.concat_ws(":", "disposition", "reason"))]))


def candidate_violations(quotes: DataFrame, materials: DataFrame) -> DataFrame:
    """Quotes have unique ids and are parts of the text of a known material."""
    times = quotes.groupBy("quote_id").agg(F.count(F.lit(1)).alias("n")).filter("quote_id IS NULL OR quote_id = '' OR n > 1")
    ids = violations(times, F.col("quote_id"), [("quote_id_invalid", F.lit(True), F.col("n"))])
    met = quotes.join(materials.select("material", F.col("extract").alias("extract"), F.lit(True).alias("known")), "material", "left")
    empty = F.coalesce(F.length("text"), F.lit(0)) == 0
    wrong = F.col("known").isNull() | empty
    return ids.unionByName(violations(met, F.col("quote_id"), [("quote_invalid", wrong, F.col("material")), ("quote_not_exact", ~wrong & ~F.coalesce(F.contains("extract", F.col("text")), F.lit(False)), F.col("material"))]))


def cited(units: DataFrame, citations: DataFrame, quotes: DataFrame) -> DataFrame:
    """units with ``texts``, the quotes of their own material that they cite; at most as many as a unit has citations."""
    own = units.select("unit", "material").join(citations.distinct(), "unit").join(quotes.select("quote_id", "material", "text").dropDuplicates(["quote_id"]), ["quote_id", "material"])
    texts = own.groupBy("unit").agg(F.array_sort(F.collect_set("text")).alias("texts"))
    return units.join(texts, "unit", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))


def citation_violations(units: DataFrame, citations: DataFrame, quotes: DataFrame) -> DataFrame:
    """Cited quotes are known and belong to the material of the unit."""
    met = citations.join(units.select("unit", F.col("material").alias("own")), "unit", "left").join(quotes.select("quote_id", "material", F.lit(True).alias("known")).dropDuplicates(["quote_id"]), "quote_id", "left")
    foreign = F.col("known") & ~F.col("material").eqNullSafe(F.col("own"))
    return violations(met, F.col("unit"), [("unknown_quote", F.col("known").isNull(), F.col("quote_id")), ("quote_of_other_material", foreign, F.col("quote_id"))])


def claim_violations(units: DataFrame, citations: DataFrame, quotes: DataFrame, supported: DataFrame | None = None) -> DataFrame:
    """Numbers of a claim are in its quotes, or in ``supported`` (unit, fact), and no qualifier of a quote is left out."""
    df = cited(units, citations, quotes)
    more = None if supported is None else supported.groupBy("unit").agg(F.collect_set("fact").alias("more"))
    df = df.withColumn("more", F.array().cast("array<string>")) if more is None else df.join(more, "unit", "left")
    facts = F.array_except(numeric_facts(F.coalesce("claim", F.lit(""))), F.concat(numeric_facts(F.array_join("texts", "\n\n")), F.coalesce("more", F.array().cast("array<string>"))))
    df = df.withColumns({"lost": F.array_join(F.array_sort(facts), ","), "qualifier": qualifiers_dropped(F.coalesce("claim", F.lit("")), F.col("texts"))})
    return violations(df, F.col("unit"), [("number_not_in_quotes", F.col("lost") != "", F.col("lost")), ("qualifier_dropped", F.col("qualifier").isNotNull(), F.col("qualifier"))])


def scope_rows(materials: DataFrame, quotes: DataFrame) -> DataFrame:
    """(material, scope, role, quote_id): header and data rows of each table that can prove something.

    A table ends at a blank line. Its header is the run of leading rows of which two cells or more have letters; its data
    are the later rows of the usual width that start with a label and have a digit behind it. The last header must be as
    wide as the data or one cell narrower, those above it too unless they divide the columns evenly. Rows count only
    where one quote is the whole row.
    """
    lines = materials.filter("kind = 'table'").select("material", F.posexplode(F.split(F.coalesce("extract", F.lit("")), "\n")).alias("line", "t"))
    before = Window.partitionBy("material").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("offset", F.coalesce(F.sum(F.length("t") + 1).over(before), F.lit(0).cast("long")))
    blank = F.trim("t") == ""
    running = Window.partitionBy("material").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("scope", F.sum(blank.cast("int")).over(running)).filter(~blank)
    start = F.col("offset") + F.length("t") - F.length(F.ltrim("t"))
    lines = lines.select("material", "scope", start.alias("start_char"), (start + F.length(F.trim("t"))).alias("end_char"))
    spans = quotes.select("material", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"), "quote_id", "text")
    rows = lines.join(spans, ["material", "start_char", "end_char"]).filter(F.contains("text", F.lit("|")) & ~F.contains("text", F.lit("`")))
    cells = F.col("cells")
    rows = rows.withColumn("cells", pipe_cells(F.col("text"))).filter(~is_separator_row(cells))
    rows = rows.withColumns({"width": F.size("cells"), "named": (F.size(F.filter(cells, lambda c: c.rlike(r"\p{L}"))) >= 2), "figures": (F.size(cells) >= 2) & (F.get(cells, 0) != "") & F.exists(F.slice(cells, 2, 1 << 20), lambda c: c.rlike("[0-9]"))})
    leading = Window.partitionBy("material", "scope").orderBy("start_char").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("head", F.min(F.col("named")).over(leading))
    counts = rows.filter(~F.col("head") & F.col("figures")).groupBy("material", "scope", "width").agg(F.count(F.lit(1)).alias("n"))
    modal = counts.groupBy("material", "scope").agg(F.max(F.struct("n", "width")).alias("m")).select("material", "scope", F.col("m.width").alias("usual"))
    met = rows.join(modal, ["material", "scope"])
    near = F.col("width").isin(0) | (F.col("width") == F.col("usual")) | (F.col("width") == F.col("usual") - 1)
    even = (F.col("width") >= 2) & ((F.col("usual") - 1) % F.col("width") == 0)
    last = met.filter("head").groupBy("material", "scope").agg(F.max_by(near, F.col("start_char")).alias("fits"), F.bool_and(near | even).alias("all_fit"))
    good = last.filter("fits AND all_fit").select("material", "scope")
    role = F.when(F.col("head"), "header").when(F.col("figures") & (F.col("width") == F.col("usual")), "data")
    out = met.filter("usual >= 2").join(good, ["material", "scope"]).select("material", "scope", role.alias("role"), "quote_id").filter("role IS NOT NULL")
    return out


def check_scopes(units: DataFrame, citations: DataFrame, materials: DataFrame, scopes: DataFrame) -> DataFrame:
    """Claims on tables cite what proves them: exactly one table is touched; of it rankings cite every header and data row,
    and numbers every header. This is a division of the citations of a unit by the rows of the table."""
    claims = units.join(materials.filter("kind = 'table'").select("material"), "material").select("unit", "material", "claim")
    needs = F.array_compact(F.array(F.when(F.col("claim").rlike(RANKING), "ranking"), F.when(F.size(numeric_facts(F.coalesce("claim", F.lit("")))) > 0, "number")))
    claims = written(claims.select("unit", "material", F.explode(needs).alias("need")), "claims")
    size = scopes.groupBy("material", "scope").agg(F.count_if(F.col("role") == "header").alias("headers"), F.count_if(F.col("role") == "data").alias("data"))
    held = claims.join(citations.distinct(), "unit").join(scopes, ["material", "quote_id"]).groupBy("unit", "need", "material", "scope")
    held = held.agg(F.count_if(F.col("role") == "header").alias("cited_headers"), F.count_if(F.col("role") == "data").alias("cited_data")).join(size, ["material", "scope"])
    held = held.filter((F.col("need") == "number") | (F.col("data") >= 2))
    short = F.when(F.col("need") == "ranking", F.col("headers") + F.col("data") - F.col("cited_headers") - F.col("cited_data")).otherwise(F.col("headers") - F.col("cited_headers"))
    touched = held.groupBy("unit", "need").agg(F.count(F.lit(1)).alias("n"), F.sum(short).alias("short"))
    met = claims.join(touched, ["unit", "need"], "left")
    ranking, unproven = F.col("need") == "ranking", F.coalesce("n", F.lit(0)) != 1
    n = F.coalesce("n", F.lit(0).cast("long"))
    return violations(met, F.col("unit"), [("ranking_scope_unprovable", ranking & unproven, n), ("ranking_scope_incomplete", ranking & ~unproven & (F.col("short") > 0), F.col("short")), ("number_scope_unprovable", ~ranking & unproven, n), ("number_header_missing", ~ranking & ~unproven & (F.col("short") > 0), F.col("short"))])


def validate_evidence(results: DataFrame, units: DataFrame, citations: DataFrame, quotes: DataFrame, materials: DataFrame, supported: DataFrame | None = None) -> DataFrame:
    """All violations of the contract: code, item, detail."""
    parts = [
        result_violations(results, materials),
        candidate_violations(quotes, materials),
        citation_violations(units, citations, quotes),
        claim_violations(units, citations, quotes, supported),
        check_scopes(units, citations, materials, scope_rows(materials, quotes)),
    ]
    return reduce(DataFrame.unionByName, parts)
