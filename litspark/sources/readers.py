"""Readers of record files and checks of what they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litspark.functions.text import strip


def read_records(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    """(src_file, pos, value): the records of text files between separators.

    pos grows within a file, in order of the file's offsets.
    """
    raw = spark.read.option("lineSep", separator).text(paths)
    return raw.select(F.input_file_name().alias("src_file"), F.monotonically_increasing_id().alias("pos"), "value")


def extract_fields(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """df with a column for each pattern's first group in ``value``, null where it doesn't match."""
    return df.withColumns({name: F.nullif(strip(F.regexp_extract("value", pattern, 1)), F.lit("")) for name, pattern in fields.items()})


def read_tagged_export(spark: SparkSession, paths: str | list[str], marker: str, fields: dict[str, str], title: str = "title") -> DataFrame:
    """Records of a tagged export; those without a title are dropped."""
    return extract_fields(read_records(spark, paths, marker), fields).filter(F.col(title).isNotNull()).drop("value")


def read_blank_separated(spark: SparkSession, paths: str | list[str], tag: str, fields: dict[str, str]) -> DataFrame:
    """Records between blank lines that contain the tag."""
    return extract_fields(read_records(spark, paths, "\n\n").filter(F.col("value").contains(tag)), fields).drop("value")


def listing_groups(lines: DataFrame, by: str, number: str, is_head: Column, wanted: Column, reach: int = 9) -> DataFrame:
    """Per numbered entry of a listing: its start, and the first wanted line within ``reach`` lines before the next entry."""
    order = Window.partitionBy(by).orderBy(number)
    df = lines.withColumn("listing", F.sum(is_head.cast("int")).over(order)).withColumn("__wanted", wanted).filter("listing > 0")
    df = df.withColumn("start_line", F.min(number).over(Window.partitionBy(by, "listing")))
    near = (F.col(number) - F.col("start_line")).between(1, reach) & F.col("__wanted")
    return df.groupBy(by, "listing").agg(F.min("start_line").alias("start_line"), F.min(F.when(near, F.col(number))).alias("found_line"))


def read_markdown_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(paper_id, path, text) of root/<paper>/normalized/document.md; folders with a leading underscore are skipped."""
    raw = spark.read.text(f"{root}/*/normalized/document.md", wholetext=True).withColumn("path", F.input_file_name())
    paper = F.regexp_extract("path", r"([^/]+)/normalized/document\.md$", 1)
    return raw.select(paper.alias("paper_id"), "path", F.col("value").alias("text")).filter(~F.col("paper_id").startswith("_"))


def read_article_md(df: DataFrame, text: str, labels: dict[str, str]) -> DataFrame:
    """df with title (first heading) and the labelled fields of a rendered article."""
    out = {"title": F.nullif(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1), F.lit(""))}
    out |= {name: F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^\**{label}\**\s*[:：]\s*(.+)$", 1)), F.lit("")) for name, label in labels.items()}
    return df.withColumns(out)


def parse_versioned(df: DataFrame, col: str, schema: str, required: list[str]) -> DataFrame:
    """df with ``record`` from JSON by a fixed schema and ``valid``: parsed, with all required fields."""
    parsed = F.from_json(col, schema, {"mode": "PERMISSIVE"})
    ok = F.col("record").isNotNull()
    for name in required:
        ok = ok & F.col(f"record.{name}").isNotNull()
    return df.withColumn("record", parsed).withColumn("valid", ok)


def read_versioned(spark: SparkSession, path: str, schema: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Records of a JSON-lines file with the wanted schema_version, and the lines that were rejected with their reason."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    df = raw.withColumn("r", F.from_json("value", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    reason = F.when(F.col("r._bad").isNotNull(), "malformed").when(~F.col("r.schema_version").eqNullSafe(F.lit(version)), "wrong_version")
    df = df.withColumn("reason", reason)
    return df.filter("reason IS NULL").select("r.*").drop("_bad"), df.filter("reason IS NOT NULL").select("value", "reason")


def parse_search_payload(df: DataFrame, col: str) -> DataFrame:
    """Search hits of nested provider records: authors by name, year by date or field, citations as the sum over years."""
    schema = "title STRING, doi STRING, publication_year INT, publication_date STRING, authorships ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>, counts_by_year ARRAY<STRUCT<year: INT, cited_by_count: INT>>, cited_by_count INT"
    r = F.from_json(col, schema)
    cited = F.aggregate("r.counts_by_year", F.lit(0), lambda a, x: a + F.coalesce(x["cited_by_count"], F.lit(0)))
    return df.withColumn("r", r).select(
        *df.columns,
        F.col("r.title").alias("title"),
        F.col("r.doi").alias("doi"),
        F.filter(F.transform("r.authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull()).alias("authors"),
        F.coalesce(F.col("r.publication_year"), F.substring("r.publication_date", 1, 4).try_cast("int")).alias("year"),
        F.coalesce(F.col("r.cited_by_count"), cited, F.lit(0)).alias("citation"),
    )


def scan_inventory(spark: SparkSession, root: str, glob: str = "*.pdf") -> DataFrame:
    """(path, size_bytes) of files below root; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("length").alias("size_bytes"))


def unique_violations(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def read_collection(spark: SparkSession, path: str, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Papers of a collection file and its violations: too few, repeated ids or sources, path separators in ids."""
    papers = spark.read.schema("topic STRING, papers ARRAY<STRUCT<paper_id: STRING, source: STRING>>").option("multiLine", True).json(path).select("topic", F.explode("papers").alias("p")).select("topic", "p.*")
    few = papers.groupBy().agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < least).select(F.lit("too_few").alias("code"), F.col("n").cast("string").alias("value"))
    repeated = [unique_violations(papers, c).select(F.lit(f"repeated_{c}").alias("code"), F.col("key").alias("value")) for c in ("paper_id", "source")]
    unsafe = papers.filter(F.col("paper_id").rlike(r"[/\\]")).select(F.lit("unsafe_id").alias("code"), F.col("paper_id").alias("value"))
    return papers, few.unionByName(repeated[0]).unionByName(repeated[1]).unionByName(unsafe)


def read_decisions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Decisions from CSV whose header must equal the schema's names."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def check_import(df: DataFrame, key: str, content: str, known_kind: Column) -> DataFrame:
    """(key, violation): the first import rule that a row breaks, null for none.

    Repeats are counted by aggregation and joined back, so a frequent content isn't gathered in one task.
    """
    hashed = df.withColumn("__hash", F.sha2(content, 256))
    ids = df.groupBy(key).agg(F.count(F.lit(1)).alias("__ids"))
    contents = hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("__copies"))
    found = hashed.select(key, "__hash", (~known_kind).alias("bad"), (F.length(content) == 0).alias("empty")).join(ids, key).join(contents, "__hash")
    violation = F.when(F.col("bad"), "bad_suffix").when(F.col("empty"), "empty").when(F.col("__ids") > 1, "duplicate_id").when(F.col("__copies") > 1, "duplicate_content")
    return found.select(key, violation.alias("violation"))
