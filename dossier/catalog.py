"""All registered queries of the audit operators and their SQL."""

from __future__ import annotations

from .plans import audit_checks, compare_checks, extraction_checks, match_checks, price_checks, rule_checks, rule_table_checks, source_checks, table_checks, text_checks  # noqa: F401
from .plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
