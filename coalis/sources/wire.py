"""Strict JSON in and out, and the invariants of stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coalis.functions.keys import valid_key
from coalis.schema import DECISIONS, MAX_SCORE, METHODS, SIGNAL_FIELDS, SIGNAL_KINDS

_CANDIDATE = "struct<origin:struct<source:string,subtype:string,native_id:string>,partition:string,kind:string,issue_ids:array<string>,subject_ids:array<string>,subject_names:array<string>,title:string,location:string,affected_version:string>"
_TOP = ("origin", "partition", "kind", "issue_ids", "subject_ids", "subject_names", "title", "location", "affected_version")
_LISTS = ("issue_ids", "subject_ids", "subject_names")
_ORIGIN = ("source", "subtype", "native_id")
_PLAIN_KINDS = ("vulnerability", "misconfiguration", "secret", "code")


def unknown_keys(json: Column, allowed: tuple[str, ...]) -> Column:
    """Keys of a JSON object beyond ``allowed``; null if it is no object."""
    return F.array_except(F.json_object_keys(json), F.array(*[F.lit(a) for a in allowed]))


def _kind(text: Column) -> Column:
    """'"code"' or '{"other": "x"}' as struct<tag, value>; null if malformed."""
    other = F.get_json_object(text, "$.other")
    alone = F.json_object_keys(text)
    return (
        F.when(text.isNull(), F.struct(F.lit("vulnerability").alias("tag"), F.lit(None).cast("string").alias("value")))
        .when(text.isin(*_PLAIN_KINDS), F.struct(text.alias("tag"), F.lit(None).cast("string").alias("value")))
        .when((F.size(alone) == 1) & other.isNotNull(), F.struct(F.lit("other").alias("tag"), other.alias("value")))
    )


def read_candidates(lines: DataFrame, column: str = "json") -> DataFrame:
    """JSON candidates as raw findings plus ``wire_error``; rows then go through the builder like any other.

    Unknown or repeated keys at either level, missing origin or partition, malformed kinds, values of
    another JSON type and nulls where a value or a list must stand are errors.
    """
    json = F.col(column)
    variant = F.try_parse_json(json)
    type_of = lambda path: F.schema_of_variant(F.try_variant_get(variant, f"$.{path}", "variant"))
    absent = lambda path: type_of(path).isNull()
    text = lambda *paths: F.greatest(F.lit(False), *[~F.coalesce(type_of(p) == "STRING", F.lit(False)) for p in paths])
    maybe = lambda *paths: F.greatest(F.lit(False), *[~(absent(p) | type_of(p).isin("STRING", "VOID")) for p in paths])
    origin = F.get_json_object(json, "$.origin")
    parsed = F.from_json(json, _CANDIDATE)
    kind = _kind(F.get_json_object(json, "$.kind"))
    keys = unknown_keys(json, _TOP)
    error = (
        F.when(keys.isNull() | variant.isNull(), "malformed")
        .when(F.size(keys) > 0, "unknown field")
        .when(unknown_keys(origin, _ORIGIN).isNull(), "missing origin")
        .when(F.size(unknown_keys(origin, _ORIGIN)) > 0, "unknown field")
        .when(parsed["origin"]["source"].isNull() | parsed["origin"]["native_id"].isNull() | parsed["partition"].isNull(), "missing field")
        .when(kind.isNull() | (type_of("kind") == "VOID"), "unknown kind")
        .when(text("origin.source", "origin.native_id", "partition") | maybe("origin.subtype", "title", "location", "affected_version"), "wrong type")
        .when(F.greatest(F.lit(False), *[~(absent(p) | type_of(p).isin("ARRAY<STRING>", "ARRAY<VOID>")) | F.coalesce(F.exists(parsed[p], lambda x: x.isNull()), F.lit(False)) for p in _LISTS]), "wrong type")
    )
    rows = lines.select("*", parsed.alias("_c"), kind.alias("_kind"), error.alias("wire_error"))
    subjects = F.coalesce(F.col("_c.subject_ids"), F.array().cast("array<string>"))
    return rows.select(
        *lines.columns,
        "wire_error",
        F.col("_c.origin.source").alias("source"),
        F.col("_c.origin.subtype").alias("subtype"),
        F.col("_c.origin.native_id").alias("native_id"),
        F.col("_c.partition").alias("partition"),
        F.col("_kind").alias("kind"),
        F.coalesce(F.col("_c.issue_ids"), F.array().cast("array<string>")).alias("issues"),
        F.filter(subjects, lambda s: F.startswith(s, F.lit("pkg:"))).alias("purls"),
        F.filter(subjects, lambda s: ~F.startswith(s, F.lit("pkg:"))).alias("cpes"),
        F.coalesce(F.col("_c.subject_names"), F.array().cast("array<string>")).alias("subject_names"),
        F.col("_c.title").alias("title"),
        F.col("_c.location").alias("location"),
        F.col("_c.affected_version").alias("affected_version"),
    )


def candidate_json() -> Column:
    """Canonical JSON of a candidate row; nulls are written."""
    plain = {"ignoreNullFields": "false"}
    fixed = F.to_json(F.struct("origin", "partition"), plain)
    kind = F.when(F.col("kind.tag") == "other", F.to_json(F.struct(F.col("kind.value").alias("other")))).otherwise(F.concat(F.lit('"'), F.col("kind.tag"), F.lit('"')))
    rest = F.to_json(F.struct("issue_ids", F.transform("subjects", lambda s: s["canonical"]).alias("subject_ids"), "subject_names", "title", "location", "affected_version"), plain)
    return F.concat(F.regexp_replace(fixed, r"\}$", ""), F.lit(',"kind":'), kind, F.lit(","), F.regexp_replace(rest, r"^\{", ""))


def comparison_json() -> Column:
    return F.to_json(F.struct("left", "right", "decision", "score", "method", "signals"), {"ignoreNullFields": "false"})


def signal_valid(s: Column) -> Column:
    """A signal's score fits its relationship."""
    score, kind = s["score"], s["kind"]
    return (
        F.when(~s["field"].isin(*SIGNAL_FIELDS) | ~kind.isin(*SIGNAL_KINDS), False)
        .when((kind == "exact") | ((s["field"] == "subject") & (kind == "similar")), score.eqNullSafe(F.lit(MAX_SCORE)))
        .when(kind == "similar", F.coalesce((score >= 0) & (score < MAX_SCORE), F.lit(False)))
        .otherwise(score.isNull())
    )


def comparison_error(row: Column | None = None) -> Column:
    """The first broken invariant of a stored comparison (columns, or a struct); null if it is sound."""
    at = F.col if row is None else lambda name: row[name]
    order = F.array(*[F.lit(f) for f in SIGNAL_FIELDS])
    signals = at("signals")
    places = F.transform(signals, lambda s: F.array_position(order, s["field"]))
    rising = F.forall(F.sequence(F.lit(1), F.size(signals) - 1), lambda i: F.get(places, i) > F.get(places, i - 1))
    l, r, d, s, m = (at(c) for c in ("left", "right", "decision", "score", "method"))
    full = s.eqNullSafe(F.lit(MAX_SCORE))
    legal = (
        F.when(m == "same_occurrence", (l == r) & (d == "duplicate") & full)
        .when(l >= r, False)
        .when(m == "exact_correlation", (d == "duplicate") & full)
        .when(m == "fuzzy", (d != "not_comparable") & F.coalesce((s >= 0) & (s < MAX_SCORE), F.lit(False)))
        .when(m == "blocked", ((d == "not_comparable") & s.isNull()) | ((d == "distinct") & s.eqNullSafe(F.lit(0))))
    )
    return (
        F.when(~F.coalesce(valid_key(l) & valid_key(r), F.lit(False)), "key")
        .when(~F.coalesce(d.isin(*DECISIONS) & m.isin(*METHODS), F.lit(False)), "name")
        .when(l > r, "order")
        .when(F.coalesce(F.size(signals), F.lit(0)) < 1, "signals")
        .when((F.size(signals) > 1) & ~F.coalesce(rising, F.lit(False)), "signals")
        .when(~F.forall(signals, signal_valid), "signal")
        .when(~F.coalesce(legal, F.lit(False)), "state")
    )


def warning_valid(size: Column, limit: Column) -> Column:
    return F.coalesce((limit >= 2) & (size > limit), F.lit(False))


_COUNTERS = ("candidate_count", "candidate_pair_count", "comparison_count", "exact_merge_count", "fuzzy_merge_count", "cluster_count")


def stats_valid(row: Column | None = None) -> Column:
    """Invariants of the six counters (columns, or a struct)."""
    n, p, q, e, f, k = (F.col(c) if row is None else row[c] for c in _COUNTERS)
    most = n.cast("decimal(38,0)") * F.greatest(n - 1, F.lit(0)) / 2
    return (F.least(n, p, q, e, f, k) >= 0) & (k <= n) & (p <= most) & (p <= q) & (q <= most) & (e + f == n - k)


def members_valid(members: Column) -> Column:
    """Strictly sorted and not empty."""
    return F.coalesce((F.size(members) > 0) & (members == F.array_sort(F.array_distinct(members))), F.lit(False))


# ---------------------------------------------------------------- results as JSON

_SIGNAL_TYPE = r"OBJECT<field: STRING, kind: STRING(, score: (BIGINT|VOID))?>"
_COMPARISON_TYPE = rf"OBJECT<decision: STRING, left: STRING, method: STRING, right: STRING(, score: (BIGINT|VOID))?, signals: ARRAY<({_SIGNAL_TYPE}|VOID)>>"
_STATS_TYPE = "OBJECT<" + ", ".join(f"{c}: BIGINT" for c in sorted(_COUNTERS)) + ">"
_WARNING_TYPE = "OBJECT<OversizedBlock: OBJECT<kind: STRING, limit: BIGINT, size: BIGINT>>"
_CLUSTER_TYPE = "OBJECT<members: ARRAY<(STRING|VOID)>>"
_RESULT_TYPE = f"OBJECT<clusters: ARRAY<({_CLUSTER_TYPE}|VOID)>, review_pairs: ARRAY<({_COMPARISON_TYPE}|VOID)>, stats: {_STATS_TYPE}, warnings: ARRAY<({_WARNING_TYPE}|VOID)>>"

_COMPARISON = "struct<left:string,right:string,decision:string,score:int,method:string,signals:array<struct<field:string,kind:string,score:int>>>"
_STATS = "struct<" + ",".join(f"{c}:bigint" for c in _COUNTERS) + ">"
_WARNING = "struct<OversizedBlock:struct<kind:string,size:bigint,`limit`:bigint>>"
_CLUSTER = "struct<members:array<string>>"
_RESULT = f"struct<clusters:array<{_CLUSTER}>,review_pairs:array<{_COMPARISON}>,warnings:array<{_WARNING}>,stats:{_STATS}>"


def _warning_error(row: Column) -> Column:
    block = row["OversizedBlock"]
    return F.when(~F.coalesce(block["kind"].isin("issue", "subject"), F.lit(False)), "name").when(~warning_valid(block["size"], block["limit"]), "warning")


def _cluster_error(row: Column) -> Column:
    members = row["members"]
    keyed = F.forall(members, lambda m: F.coalesce(valid_key(m), F.lit(False)))
    return F.when(~F.coalesce(keyed, F.lit(False)), "key").when(~members_valid(F.transform(members, F.lower)), "members")


def _stats_error(row: Column) -> Column:
    return F.when(~F.coalesce(stats_valid(row), F.lit(False)), "stats")


def _result_error(row: Column) -> Column:
    clusters, reviews, warnings, stats = (row[c] for c in ("clusters", "review_pairs", "warnings", "stats"))
    first = F.transform(clusters, lambda c: F.lower(F.get(c["members"], F.lit(0))))
    everyone = F.transform(F.flatten(F.transform(clusters, lambda c: c["members"])), F.lower)
    places = F.flatten(F.transform(clusters, lambda c, i: F.transform(c["members"], lambda m: F.struct(F.lower(m).alias("m"), i.alias("i")))))
    home = F.map_from_entries(places)
    pair = F.transform(reviews, lambda r: F.struct(F.lower(r["left"]).alias("l"), F.lower(r["right"]).alias("r")))
    apart = F.forall(pair, lambda p: F.coalesce(home[p["l"]] != home[p["r"]], F.lit(False)))
    sound = lambda items, error: F.coalesce(F.forall(items, lambda x: error(x).isNull()), F.lit(False))
    return (
        F.when(~sound(clusters, _cluster_error), "cluster")
        .when(~sound(warnings, _warning_error), "warning")
        .when(~sound(reviews, comparison_error), "comparison")
        .when(_stats_error(stats).isNotNull(), "stats")
        .when(first != F.array_sort(F.array_distinct(first)), "cluster order")
        .when(F.size(everyone) != F.size(F.array_distinct(everyone)), "shared member")
        .when((F.size(everyone) != stats["candidate_count"]) | (F.size(clusters) != stats["cluster_count"]), "counts")
        .when(~F.forall(reviews, lambda r: r["decision"] == "review") | (pair != F.array_sort(F.array_distinct(pair))) | ~apart, "review pairs")
    )


SHAPES = {
    "comparison": (_COMPARISON_TYPE, _COMPARISON, comparison_error),
    "warning": (_WARNING_TYPE, _WARNING, _warning_error),
    "stats": (_STATS_TYPE, _STATS, _stats_error),
    "cluster": (_CLUSTER_TYPE, _CLUSTER, _cluster_error),
    "result": (_RESULT_TYPE, _RESULT, _result_error),
}


def read_results(lines: DataFrame, shape: str, column: str = "json") -> DataFrame:
    """The JSON documents of one ``shape`` (comparison, warning, stats, cluster, result) as a struct of that name plus ``wire_error``.

    Malformed documents, unknown or missing keys, other JSON types and broken invariants are errors,
    and the struct is null then.  A result's parts are also checked against each other: clusters in
    order of their first members, no member twice, counts that match the statistics, review pairs in
    order between different clusters.
    """
    kind, schema, check = SHAPES[shape]
    variant = F.schema_of_variant(F.try_parse_json(column))
    rows = lines.withColumn("_w", F.from_json(column, schema))
    shaped = F.coalesce(variant.rlike(f"^{kind}$"), F.lit(False))
    rows = rows.withColumn("wire_error", F.when(variant.isNull(), "malformed").when(~shaped, "shape").otherwise(check(F.col("_w"))))
    return rows.withColumn(shape, F.when(F.col("wire_error").isNull(), F.col("_w"))).drop("_w")


def cluster_json() -> Column:
    return F.to_json(F.struct("members"))


def warning_json() -> Column:
    """Of a row of the engine's warnings (kind, size, limit)."""
    return F.to_json(F.struct(F.struct("kind", "size", "limit").alias("OversizedBlock")))


def stats_json() -> Column:
    return F.to_json(F.struct(*_COUNTERS))
