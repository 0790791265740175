"""Block keys of candidates: canonical issue ids and version-free subject coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coalis.functions.subjects import subject_names
from coalis.functions.text import normalize_issues


def block_keys(candidates: DataFrame, *keep: str) -> DataFrame:
    """(keep..., block_kind, block_key): one row per candidate row and distinct key, without a shuffle.

    Null or empty arrays, blank ids and subjects that do not parse carry no key.
    """
    tagged = lambda kind, c: F.transform(c, lambda k: F.struct(F.lit(kind).alias("block_kind"), k.alias("block_key")))
    subjects = candidates.select(*keep, "issue_ids", subject_names(F.col("subject_ids")).alias("_s"))
    coordinates = F.array_distinct(F.transform("_s", lambda s: s["coordinate"]))
    both = F.concat(tagged("issue", normalize_issues(F.col("issue_ids"))), tagged("subject", coordinates))
    return subjects.select(*keep, F.explode(both).alias("_k")).select(*keep, "_k.block_kind", "_k.block_key")
