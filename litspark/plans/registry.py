"""All queries of the library's own operators, with the same question as DuckDB SQL where it can be put so."""

from __future__ import annotations

from litspark.plans import audit, bibliography, completeness, contracts, evidence, joins, outlines, planning, revisions, structure, summaries, synthesis  # noqa: F401  they register their queries
from litspark.plans.query import FOUND


def queries() -> dict:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
