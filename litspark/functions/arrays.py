"""Arrays, maps and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_distinct(col: Column) -> Column:
    """Different elements in order of first occurrence, without empty ones."""
    return F.array_distinct(F.filter(col, lambda x: x.isNotNull() & (x != "")))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def path_text(col: Column) -> Column:
    return F.array_join(col, " > ")


def counts_map(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Per group a map from key to count, keys in order."""
    each = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias("counts"))


def nested_get(col: Column, path: str, default) -> Column:
    return F.coalesce(F.get_json_object(col, path), F.lit(default))


def pipe_cells(col: Column) -> Column:
    """Cells of a pipe-separated row; an escaped bar doesn't separate."""
    inner = F.regexp_replace(F.trim(col), r"^\||\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda x: F.replace(F.trim(x), F.lit("\\|"), F.lit("|")))


def is_separator_row(cells: Column) -> Column:
    return (F.size(cells) > 0) & F.forall(cells, lambda x: x.rlike("^:?-{1,}:?$"))


def check_contract(df: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(key, code, path): one row for each rule that a record breaks. A rule is a code, a path and a condition that must hold."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"))) for code, path, ok in rules]))
    return df.select(key, F.explode(broken).alias("v")).select(key, "v.code", "v.path")
