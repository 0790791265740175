"""Raw findings to validated candidates.

Every row comes out with either ``error`` null or the first error a row-by-row builder would
raise: identifiers first, then the fields in a fixed order, then missing evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coalis.config import Config
from coalis.functions.keys import correlation_keys, occurrence_key
from coalis.functions.similarity import normal_text
from coalis.functions.subjects import canonical_subject, is_canonical, parse_subjects
from coalis.functions.text import has_control, normalize_issue, trim_unicode
from coalis.schema import RAW

_ERROR = "struct<code:string,field:string,position:int,component:int>"


def _error(code: str, field: str | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(field).cast("string").alias("field"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("int").alias("component"))


def text_error(value: Column, field: str) -> Column:
    """The error of a present text: blank after trimming, or a control character anywhere."""
    return F.when(trim_unicode(value) == "", _error("EmptyField", field)).when(has_control(value), _error("ControlCharacter", field))


def _required(value: Column, field: str) -> Column:
    return F.when(value.isNull(), _error("EmptyField", field)).otherwise(text_error(value, field))


def _optional(value: Column, field: str) -> Column:
    return F.when(value.isNotNull(), text_error(value, field))


def _issue_error(issue: Column) -> Column:
    trimmed = trim_unicode(F.coalesce(issue, F.lit("")))
    return F.when(trimmed == "", _error("EmptyIssueId")).when(has_control(trimmed), _error("ControlCharacter", "issue_id"))


def _first(errors: Column) -> Column:
    return F.try_element_at(F.filter(errors, lambda e: e.isNotNull()), F.lit(1))


def with_columns(raw: DataFrame, mapping: dict[str, Column] | None = None) -> DataFrame:
    """``raw`` with exactly the columns of the raw schema; ``mapping`` renames or computes them, missing ones are null."""
    mapping = mapping or {}
    have = set(raw.columns)
    return raw.select(*[(mapping[f.name] if f.name in mapping else F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW.fields])


def build(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Candidates and rejected rows in one frame; ``error`` tells which.

    Candidate columns: origin, partition, kind, issue_ids, subjects, subject_names, title,
    location, affected_version.  A missing kind is a vulnerability.  Nothing is shuffled.
    """
    keep = keep or []
    empty = F.array().cast("array<string>")
    lists = {c: F.coalesce(F.col(c), empty) for c in ("issues", "purls", "cpes", "subject_names")}
    # rows of one canonical PURL need neither Python nor functions over lists
    one = F.get("purls", F.lit(0))
    plain = (F.size(lists["purls"]) == 1) & (F.size(lists["cpes"]) == 0) & is_canonical(one)
    first, rest = raw.where(plain), raw.where(~plain)
    rest = rest.select("*", parse_subjects(F.concat(lists["purls"], lists["cpes"])).alias("_parsed"), F.size(lists["purls"]).alias("_purls"))
    return _built(first.select("*", F.array(canonical_subject(one)).alias("_parsed")), keep, lists, True).unionByName(_built(rest, keep, lists, False))


def _built(parsed: DataFrame, keep: list[str], lists: dict[str, Column], canonical: bool) -> DataFrame:
    """:func:`build` of rows with their ``_parsed`` subjects; ``canonical`` ones are single and without errors."""
    tag = F.coalesce(F.col("kind.tag"), F.lit("vulnerability"))
    wrong_kind = lambda s, i: F.when(i < F.col("_purls"), F.coalesce(s["kind"], F.lit("purl")) != "purl").otherwise(F.coalesce(s["kind"], F.lit("cpe")) != "cpe")
    # purls must parse as purls and cpes as cpes
    subject_errors = F.transform(
        "_parsed",
        lambda s, i: F.when(
            s["error_code"].isNotNull() | wrong_kind(s, i),
            F.struct(
                F.when(i < F.col("_purls"), F.when(wrong_kind(s, i) | (s["error_code"] == "UnsupportedSubjectId"), "InvalidPurl").otherwise(s["error_code"]))
                .otherwise(F.when(wrong_kind(s, i) | (s["error_code"] == "UnsupportedSubjectId"), "UnsupportedCpeBinding").otherwise(s["error_code"]))
                .alias("code"),
                s["error_detail"].alias("field"),
                s["error_position"].alias("position"),
                s["error_component"].alias("component"),
            ),
        ),
    )
    evidence = (F.size(lists["issues"]) > 0) | (F.size("_parsed") > 0) | (F.size(lists["subject_names"]) > 0) | F.col("title").isNotNull()
    error = F.coalesce(
        *([] if canonical else [_first(subject_errors)]),
        _required(F.col("source"), "source"),
        _required(F.col("native_id"), "native_id"),
        _required(F.col("partition"), "partition"),
        _optional(F.col("subtype"), "subtype"),
        _optional(F.col("title"), "title"),
        _optional(F.col("location"), "location"),
        _optional(F.col("affected_version"), "affected_version"),
        F.when(tag == "other", _required(F.col("kind.value"), "kind")),
        _first(F.transform(lists["issues"], _issue_error)),
        _first(F.transform(lists["subject_names"], lambda n: _required(n, "subject_name"))),
        F.when(~evidence, _error("NoEvidence")),
    )
    subjects = F.array_sort(
        F.array_distinct("_parsed"),
        lambda a, b: F.when(a["kind"] != b["kind"], F.when(a["kind"] == "purl", -1).otherwise(1)).when(a["canonical"] < b["canonical"], -1).when(a["canonical"] > b["canonical"], 1).otherwise(0),
    )
    text = lambda c: trim_unicode(F.col(c)).alias(c.rsplit(".")[-1])
    return parsed.select(
        *keep,
        F.struct(text("source"), text("subtype"), text("native_id")).alias("origin"),
        text("partition"),
        F.struct(tag.alias("tag"), F.when(tag == "other", trim_unicode(F.col("kind.value"))).alias("value")).alias("kind"),
        F.array_sort(F.array_distinct(F.transform(lists["issues"], normalize_issue))).alias("issue_ids"),
        (F.col("_parsed") if canonical else subjects).alias("subjects"),
        F.array_sort(F.array_distinct(F.transform(lists["subject_names"], trim_unicode))).alias("subject_names"),
        text("title"),
        text("location"),
        text("affected_version"),
        error.cast(_ERROR).alias("error"),
    )


def accepted(built: DataFrame) -> DataFrame:
    return built.where("error is null").drop("error")


def quarantine(built: DataFrame) -> DataFrame:
    return built.where("error is not null")


def with_keys(candidates: DataFrame, config: Config = Config(), key: Column | None = None) -> DataFrame:
    """Candidates with occurrence_key and correlation_keys.  ``key`` replaces the digest (a readable unique id)."""
    o = F.col("origin")
    occurrence = occurrence_key(F.col("partition"), F.col("kind"), o["source"], o["subtype"], o["native_id"]) if key is None else key
    identities = F.transform("subjects", lambda s: s["full_identity"])
    return candidates.withColumn("occurrence_key", occurrence).withColumn(
        "correlation_keys", correlation_keys(F.col("partition"), F.col("kind"), F.col("issue_ids"), identities, config.issue_only_exact)
    )


def prepared(candidates: DataFrame) -> DataFrame:
    """The columns comparison needs, each computed once per candidate instead of once per pair."""
    names = F.filter(F.concat("subject_names", F.transform("subjects", lambda s: F.coalesce(s["name"], F.lit("")))), lambda n: n != "")
    versions = F.array_distinct(F.array_compact(F.concat(F.array("affected_version"), F.transform("subjects", lambda s: s["version"]))))
    details = F.transform(
        "subjects",
        lambda s: F.struct(s["kind"].alias("kind"), s["coordinate"].alias("coordinate"), s["version"].alias("version"), s["qualifiers"].alias("qualifiers"), s["subpath"].alias("subpath"), s["cpe_tokens"].alias("cpe_tokens")),
    )
    return candidates.select(
        F.col("occurrence_key").alias("key"),
        F.col("origin.source").alias("source"),
        "partition",
        "kind",
        "issue_ids",
        "correlation_keys",
        F.transform("subjects", lambda s: F.concat(s["kind"], F.lit(":"), s["canonical"])).alias("canonicals"),
        F.transform("subjects", lambda s: F.concat(s["kind"], F.lit(":"), s["coordinate"])).alias("coordinates"),
        F.array_distinct(F.transform("subjects", lambda s: s["kind"])).alias("subject_kinds"),
        details.alias("details"),
        versions.alias("versions"),
        F.transform(names, normal_text).alias("names"),
        normal_text(F.col("title")).alias("title"),
        normal_text(F.col("location")).alias("location"),
    )
