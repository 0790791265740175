"""All core queries by name, their SQL, and the flagship."""

from __future__ import annotations

from . import hot, reference

QUERIES = {**reference.QUERIES, **hot.QUERIES}
SQL = {**reference.SQL, **hot.SQL}
FLAGSHIP = "compare_blocks"
