"""Findings and advice as arrays in a score row, as SQL text for ``selectExpr``.

A finding carries a severity code: ``critical`` findings block the verdict, ``warning`` findings do
not, ``info`` rows say that nothing was found and never count. Severity is a code and is not searched
for in the message, so a reassuring sentence cannot block a clean table.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from slicewise.functions.exprs import text_sql

ISSUE_TYPE = (
    "array<struct<code:string,severity:string,subject:string,value:double,message:string>>"
)
NO_ISSUES = f"CAST(array() AS {ISSUE_TYPE})"
NO_ADVICE = "CAST(array() AS array<string>)"


class Issue(NamedTuple):
    """A finding: the condition, ``value`` and ``subject`` are SQL expressions of the row."""

    when: str
    code: str
    severity: str
    value: str
    message: str
    subject: str = "NULL"


def issue_sql(issue: Issue) -> str:
    severity = issue.severity if " " in issue.severity else text_sql(issue.severity)
    return (
        f"CASE WHEN {issue.when} THEN named_struct('code', {text_sql(issue.code)}, "
        f"'severity', {severity}, 'subject', CAST({issue.subject} AS STRING), "
        f"'value', CAST({issue.value} AS DOUBLE), 'message', {text_sql(issue.message)}) END"
    )


def issues_sql(issues: Sequence[Issue], more: str | None = None, clean: tuple[str, str] | None = None) -> str:
    """The findings that apply, and those of the array ``more``.

    ``clean`` is the (code, message) of the info row that stands for an empty list.
    """
    found = "filter(array(" + ", ".join(issue_sql(i) for i in issues) + "), i -> i IS NOT NULL)"
    found = f"CAST({found} AS {ISSUE_TYPE})"
    if more is not None:
        found = f"concat({found}, coalesce({more}, {NO_ISSUES}))"
    if clean is None:
        return found
    nothing = issue_sql(Issue("true", clean[0], "info", "NULL", clean[1]))
    return f"CASE WHEN size({found}) = 0 THEN CAST(array({nothing}) AS {ISSUE_TYPE}) ELSE {found} END"


def advice_sql(*items: tuple[str, str]) -> str:
    """The recommendations whose condition holds, in order."""
    if not items:
        return NO_ADVICE
    texts = ", ".join(f"CASE WHEN {cond} THEN {text_sql(text)} END" for cond, text in items)
    return f"filter(array({texts}), t -> t IS NOT NULL)"


def count_sql(issues: str, severity: str) -> str:
    return f"size(filter({issues}, i -> i.severity = '{severity}'))"
