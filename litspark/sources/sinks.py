"""Sinks: tables, article files and review exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.functions.text import safe_filename


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write a table; the output committer makes it appear as a whole. An existing run isn't overwritten unless asked for."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).format(kind).save(path)


def render_articles(df: DataFrame, title: str, body: str) -> DataFrame:
    """(file_name, text) of one Markdown document per record."""
    return df.select(F.concat(safe_filename(F.col(title)), F.lit(".md")).alias("file_name"), F.concat(F.lit("# "), F.col(title), F.lit("\n\n"), F.col(body)).alias("text"))


def write_articles(df: DataFrame, title: str, body: str, path: str) -> None:
    """One folder per article, named by its file name."""
    render_articles(df, title, body).select("text", "file_name").write.partitionBy("file_name").text(path)


def export_review(cards: DataFrame, paper: str, order: str, path: str) -> None:
    """CSV per paper in card order."""
    cards.repartitionByRange(paper, order).sortWithinPartitions(paper, order).write.partitionBy(paper).csv(path, header=True)


def export_decisions(issues: DataFrame, keys: list[str], path: str) -> None:
    """Template for human decisions: open issues with empty decision columns."""
    empty = {c: F.lit(None).cast("string") for c in ("decision", "revised_claim", "note")}
    issues.select(*keys).withColumns(empty).write.csv(path, header=True)
