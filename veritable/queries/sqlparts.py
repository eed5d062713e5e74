"""Small builders for oracle SQL text shared by several registered queries."""

from __future__ import annotations


def histogram_sql(table: str, columns: list[str]) -> str:
    """DuckDB (column_name, value, cnt) histogram with NULLs kept."""
    casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)
    on = ", ".join(columns)
    return (
        f"SELECT column_name, value, count(*) AS cnt FROM "
        f"(SELECT {casts} FROM {table}) UNPIVOT INCLUDE NULLS (value FOR column_name IN ({on})) "
        f"GROUP BY 1, 2"
    )


def kinds_sql(kinds: dict[str, str]) -> str:
    rows = ", ".join(f"('{c}', '{k}', {i})" for i, (c, k) in enumerate(kinds.items()))
    return f"SELECT * FROM (VALUES {rows}) AS t(column_name, kind, position)"


def quote_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
