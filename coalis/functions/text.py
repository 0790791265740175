"""Text functions as plain Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space at either end (Spark's trim only knows U+0020).
#: A run of it is only tried from its start, so a long one inside a text costs linear time.
EDGE_SPACE = r"^[\s\u0085\p{Z}]++|(?<![\s\u0085\p{Z}])[\s\u0085\p{Z}]++$"
#: ASCII letters, for case folding that leaves other letters alone.
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Prefixes of issue ids that are written in upper case.
ISSUE_PREFIX = r"^(CVE|CWE|GHSA|RUSTSEC)-"


def trim_unicode(c: Column) -> Column:
    """``c`` without white space at its ends; a text between two visible ASCII characters does not reach the pattern."""
    visible = lambda at: F.substring(c, at, 1).between("!", "~")
    return F.when(visible(1) & visible(-1), c).otherwise(F.regexp_replace(c, EDGE_SPACE, ""))


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def has_control(c: Column) -> Column:
    return c.rlike(r"\p{Cc}")


def normalize_issue(c: Column) -> Column:
    """Canonical issue id; null for null, blank and ids with control characters inside."""
    t = trim_unicode(c)
    upper = ascii_upper(t)
    return F.when((t != "") & ~has_control(t), F.when(upper.rlike(ISSUE_PREFIX), upper).otherwise(t))


def normalize_issues(c: Column) -> Column:
    """array<string> -> sorted distinct canonical ids; null array gives an empty one."""
    return F.array_sort(
        F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), normalize_issue), lambda x: x.isNotNull()))
    )
