"""Small helpers for the checking SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanframe.standins import standin_sql


def r(expr: str, places: int = 6) -> str:
    """Rounded double without negative zero, to match ``rounded``."""
    return f"(round(CAST({expr} AS DOUBLE), {places}) + CAST(0 AS DOUBLE))"


def rounded(column: Column | str, places: int = 6) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), places) + F.lit(0.0)


def with_standins(names: list[str], body: str) -> str:
    """``body`` with the stand-ins as leading CTEs."""
    ctes = ",\n".join(f"{n} AS {standin_sql(n)}" for n in names)
    body = body.strip()
    for lead in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(lead):
            return f"{lead}{ctes},\n{body[len(lead):]}"
    return f"WITH {ctes}\n{body}"
