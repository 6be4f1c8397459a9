"""Compositions of operators: the audit with its scorecard."""

from slicewise.plans.audit import audit, audit_table, audit_text, issues, recommendations

__all__ = ["audit", "audit_table", "audit_text", "issues", "recommendations"]
