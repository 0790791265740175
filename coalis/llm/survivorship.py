"""Field-by-field survivorship: one aggregation of maximum composite structs.

Input: ``groups`` (group id, member keys), ``records`` (key, id and fields), ``sources``
(source, trust rank).  Each attribute's winner is the maximum of
``struct(usable, -rank, timestamp, -id)``; a maximum is associative, so it is taken per
key before anything is joined and again per group after.  A key or a group that holds a
third of all rows is therefore reduced on the map side and never gathered.  The winners of a
key that very many groups list reach them by broadcast (see skew.py), all others by shuffle.

What stands in for a missing value is a parameter, ``stand_ins``: words as :data:`STAND_INS` has
them, which is the default.

Defined cases: null and blank values, and values that only stand in for a missing one
(``N/A``, ``{{title}}``, ``--``), are unusable; an unlisted or null source ranks last; a
null timestamp ranks last; ties go to the smallest id; repeated members and rows count
once; member keys match regardless of letter case; null keys match nothing; empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coalis.functions.text import trim_unicode
from coalis.operators.skew import attach
from coalis.sources.scratch import Scratch, small_or_shuffled

#: A key with at least this part of all listings is attached by broadcast.
HOT_PARTS = 2000
#: Words (after case, punctuation and spacing are removed) that stand for a missing value by default.
STAND_INS = (
    "na", "nan", "nil", "none", "null", "nul", "void", "missing", "absent", "empty", "blank",
    "unknown", "unspecified", "undefined", "undetermined", "unavailable", "unset", "untitled",
    "untitled finding", "untitled issue", "no title", "no version", "no name", "no value", "no data",
    "title missing", "version missing", "missing title", "missing version", "unknown version", "unknown title",
    "version unknown", "title unknown", "not available", "not applicable", "not specified", "not set",
    "not known", "not given", "not provided", "not defined", "not found", "n a", "t b d", "tbd", "tba", "tbc",
    "todo", "fixme", "to be filled in", "to be determined", "to be defined", "to be done", "to be announced",
    "placeholder", "dummy", "default", "title", "version", "x y z",
)
_TEMPLATE = r"^\s*(\$?\{+[^{}]*\}+|%+\w+%+|<+[^<>]*>+|\[+\s*(title|version|name|value|text)\s*\]+)\s*$"


def usable(value: Column, stand_ins: tuple[str, ...] = STAND_INS) -> Column:
    """True unless the value is null, blank, bare punctuation or a stand-in for a missing one."""
    words = F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " "))
    return F.coalesce(
        (words != "") & ~words.isin(*stand_ins) & ~words.rlike("^x{2,}$") & ~F.lower(value).rlike(_TEMPLATE),
        F.lit(False),
    )


def source_key(value: Column) -> Column:
    """A source name regardless of case, blanks, hyphens and underscores."""
    return F.trim(F.regexp_replace(F.lower(value), r"[\s\u0085\p{Z}_\-]+", " "))


def survivors(
    groups: DataFrame,
    records: DataFrame,
    sources: DataFrame,
    fields: dict[str, Column | None],
    *,
    group_id: str = "cluster_id",
    members: str = "members",
    key: str = "occurrence_key",
    source: Column | None = None,
    at: str = "seen_at",
    record_id: str = "cand_id",
    stand_ins: tuple[str, ...] = STAND_INS,
) -> DataFrame:
    """(group id, field_name, record id): the record that supplies each field of each group of two or more members.

    ``fields`` maps a field name to the value that must be usable, or to None for a field
    that always is.
    """
    source = F.col("origin.source") if source is None else source
    ranks = (
        sources.select(source_key(F.col("source")).alias("_src"), F.col("trust_rank").cast("long").alias("_rank"))
        .groupBy("_src")
        .agg(F.min("_rank").alias("_rank"))
    )
    values = records.select(
        F.lower(F.col(key)).alias("_key"),
        source_key(source).alias("_src"),
        F.col(at).alias("_at"),
        F.col(record_id).alias("_id"),
        *[(F.lit(True) if v is None else usable(v, stand_ins)).alias(f"_u_{f}") for f, v in fields.items()],
    ).where("_key is not null")
    ranked = values.join(small_or_shuffled(ranks), "_src", "left")
    best = [
        F.max(F.when(F.col(f"_u_{f}"), F.struct((-F.coalesce(F.col("_rank"), F.lit(2**62))).alias("r"), F.col("_at").alias("t"), (-F.col("_id")).alias("i")))).alias(f)
        for f in fields
    ]
    per_key = ranked.groupBy("_key").agg(*best)
    listed = (
        groups.select(F.col(group_id).alias("_g"), F.array_distinct(F.filter(F.transform(members, F.lower), lambda m: m.isNotNull())).alias("_m"))
        .where(F.size("_m") > 1)
        .select("_g", F.explode("_m").alias("_key"))
    )
    scratch = Scratch(records.sparkSession, "survivorship")
    known = scratch.write(per_key.join(listed.groupBy("_key").agg(F.count("*").alias("n")), "_key"), "known")
    limit = max((known.agg(F.sum("n")).first()[0] or 0) // HOT_PARTS, 1000)
    per_group = attach(listed, ["_key"], known, limit).groupBy("_g").agg(*[F.max(f).alias(f) for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field_name"), (-F.col(f)["i"]).alias(record_id)) for f in fields])
    return (
        per_group.select("_g", F.explode(rows).alias("_r"))
        .select(F.col("_g").alias(group_id), "_r.field_name", f"_r.{record_id}")
        .where(F.col(record_id).isNotNull())
    )


def golden_records(groups: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """One surviving record per cluster: the best title, version and source with the ids they come from."""
    chosen = survivors(groups, records, sources, {"title": F.col("title"), "affected_version": F.col("affected_version"), "source": None})
    supplied = chosen.join(records.select("cand_id", "title", "affected_version", F.trim(F.col("origin.source")).alias("source")), "cand_id")
    pick = lambda f: F.max(F.when(F.col("field_name") == f, F.struct("cand_id", f)))
    out = supplied.groupBy("cluster_id").agg(*[pick(f).alias(f"_{f}") for f in ("title", "affected_version", "source")])
    return out.select(
        "cluster_id",
        *[c.alias(a) for f in ("title", "affected_version", "source") for c, a in ((F.col(f"_{f}")[f], f), (F.col(f"_{f}")["cand_id"], f"{f}_from"))],
    )
