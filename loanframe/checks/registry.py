"""All registered queries and their SQL."""

from __future__ import annotations

from loanframe.checks import cases, growth, loans, models, records, statements

QUERIES = {}
ORACLE = {}
for part in (statements, loans, cases, records, models, growth):
    QUERIES.update(part.QUERIES)
    ORACLE.update(part.ORACLE)
