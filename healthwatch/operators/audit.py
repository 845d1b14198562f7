"""SQL statement audit, statement cleaning and log-text cleanup over text
columns (built-in regex functions, evaluated per row inside codegen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from healthwatch.functions import fields as fd

APPROVED_REASON = "Passed all security checks"
EMPTY_REASON = "Empty SQL command rejected"


def audit_reason(sql: Column, enforce_prefixes: bool = False) -> Column:
    """NULL when the statement passes, else the first matching reason.
    Patterns match case-insensitively; ``.`` stops at a line feed only, so a DELETE
    whose WHERE sits on the next line is blocked.  With ``enforce_prefixes``
    the statement must also start with an allowed verb."""
    expr = F.lit(None).cast("string")
    if enforce_prefixes:
        ok = None
        for p in fd.ALLOWED_SQL_PREFIXES:
            c = F.upper(F.trim(sql)).startswith(p)
            ok = c if ok is None else (ok | c)
        expr = F.when(~ok, F.lit("Statement type is not allowed")).otherwise(expr)
    for pattern, reason in reversed(fd.BLOCKED_SQL):
        expr = F.when(sql.rlike("(?id)" + pattern), F.lit(reason)).otherwise(expr)
    return F.when(sql.isNull() | sql.rlike(r"^\s*$"), F.lit(EMPTY_REASON)).otherwise(expr)


def audit_sql(df: DataFrame, col: str = "sql", agent_id: str = "remediation-agent",
              enforce_prefixes: bool = False) -> DataFrame:
    """Add ``approved``, ``reason`` (the pass message or the block reason) and
    ``agent_id`` to every statement row."""
    r = audit_reason(F.col(col), enforce_prefixes)
    return df.withColumns({"approved": r.isNull(),
                           "reason": F.coalesce(r, F.lit(APPROVED_REASON)),
                           "agent_id": F.lit(agent_id)})


def clean_statement(c: Column, fence: str = "sql") -> Column:
    """Remove ```<fence> and ``` code fences and backticks, trim whitespace,
    strip trailing semicolons."""
    s = F.regexp_replace(c, r"```" + fence + r"\s*", "")
    s = F.regexp_replace(s, r"```\s*", "")
    s = F.regexp_replace(s, "`", "")
    s = F.regexp_replace(s, r"^\s+|\s+$", "")
    return F.regexp_replace(s, r";+$", "")


def strip_ansi(c: Column) -> Column:
    """Remove ANSI colour escape sequences."""
    return F.regexp_replace(c, "\x1b\\[[0-9;]*m", "")
