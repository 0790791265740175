"""Explainable comparison of candidate pairs as one projection.

Rules in order: same occurrence, partition, kind, same source, shared exact key, conflict,
score.  Only pairs that reach the evidence stage go through the similarity function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coalis.config import Config
from coalis.functions.similarity import contribution, pair_similarities
from coalis.schema import MAX_SCORE, SIGNAL


def _signal(field: str, kind: Column | str, score: Column | int | None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    score = F.lit(score) if score is None or isinstance(score, int) else score
    return F.struct(F.lit(field).alias("field"), kind.alias("kind"), score.cast("int").alias("score")).cast(SIGNAL)


def details_compatible(a: Column, b: Column) -> Column:
    """Same coordinate and no concrete detail of one contradicts the other."""
    agree = lambda x, y: F.coalesce(x == y, F.lit(True))
    qualifiers = F.forall(F.coalesce(a["qualifiers"], F.array().cast("array<struct<k:string,v:string>>")), lambda q: ~F.exists(F.coalesce(b["qualifiers"], F.array().cast("array<struct<k:string,v:string>>")), lambda p: (p["k"] == q["k"]) & (p["v"] != q["v"])))
    tokens = F.forall(F.zip_with(F.slice(a["cpe_tokens"], 4, 8), F.slice(b["cpe_tokens"], 4, 8), lambda x, y: (x == "*") | (y == "*") | (x == y)), lambda t: t)
    return (a["kind"] == b["kind"]) & (a["coordinate"] == b["coordinate"]) & F.when(a["kind"] == "purl", agree(a["version"], b["version"]) & agree(a["subpath"], b["subpath"]) & qualifiers).otherwise(tokens)


def join_pairs(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """(l, r) structs of both candidates of each (left, right)."""
    whole = F.struct(*prepared.columns)
    return (
        pairs.select("left", "right")
        .join(prepared.select(F.col("key").alias("left"), whole.alias("l")), "left")
        .join(prepared.select(F.col("key").alias("right"), whole.alias("r")), "right")
        .select("l", "r")
    )


def compare(joined: DataFrame, config: Config = Config()) -> DataFrame:
    """(left, right, decision, score, method, signals) of (l, r) rows; left <= right whatever the order given."""
    l, r = F.col("l"), F.col("r")
    overlap = lambda c: F.arrays_overlap(l[c], r[c])
    kinds_equal = (l["kind"]["tag"] == r["kind"]["tag"]) & l["kind"]["value"].eqNullSafe(r["kind"]["value"])
    rule = (
        F.when(l["key"] == r["key"], "same")
        .when(l["partition"] != r["partition"], "partition")
        .when(~kinds_equal, "kind")
        .when(F.lit(config.cross_source_only) & (l["source"] == r["source"]), "source")
        .when(overlap("correlation_keys"), "exact")
        .otherwise("evidence")
    )
    ruled = joined.select("l", "r", rule.alias("rule"))
    keys = [F.least(l["key"], r["key"]).alias("left"), F.greatest(l["key"], r["key"]).alias("right")]
    partition, kind = _signal("partition", "exact", MAX_SCORE), _signal("kind", "exact", MAX_SCORE)
    exact_subject = overlap("canonicals")
    is_ = lambda x: F.col("rule") == x
    # each pair is joined and evaluated once; texts of pairs a rule settles do not reach the similarity, nor do equal ones
    asked = lambda c, x: F.when(is_("evidence") & ~same[c], x[c])
    alike = lambda c: (l[c] == r[c]) & (l[c] != "")
    same = {c: F.coalesce(alike(c), F.lit(False)) for c in ("title", "location")}
    same["names"] = F.exists(l["names"], lambda n: (n != "") & F.array_contains(r["names"], n))
    settled = F.struct(
        F.when(is_("same") | is_("exact"), "duplicate").otherwise("not_comparable").alias("decision"),
        F.when(is_("same") | is_("exact"), MAX_SCORE).cast("int").alias("score"),
        F.when(is_("same"), "same_occurrence").when(is_("exact"), "exact_correlation").otherwise("blocked").alias("method"),
        F.when(is_("same"), F.array(_signal("source", "exact", MAX_SCORE)))
        .when(is_("partition"), F.array(_signal("partition", "different", None)))
        .when(is_("kind"), F.array(partition, _signal("kind", "different", None)))
        .when(is_("source"), F.array(partition, kind, _signal("source", "same_source", None)))
        .otherwise(F.array(partition, kind, _signal("issue", "exact", MAX_SCORE), F.when(exact_subject, _signal("subject", "exact", MAX_SCORE)).otherwise(_signal("subject", "missing", None))))
        .alias("signals"),
    )

    some = lambda x, c: F.size(x[c]) > 0
    shared, both_issues = overlap("issue_ids"), some(l, "issue_ids") & some(r, "issue_ids")
    coordinate = overlap("coordinates")
    comparable = overlap("subject_kinds")
    version = F.when(~some(l, "versions") | ~some(r, "versions"), "missing").when(overlap("versions"), "exact").otherwise("different")
    late = ruled.select(
        *keys,
        F.when(~is_("evidence"), settled).alias("settled"),
        pair_similarities(*[asked(c, x) for c in ("names", "title", "location") for x in (l, r)]).alias("s"),
        *[same[c].alias(f"same_{c}") for c in same],
        shared.alias("shared"),
        (both_issues & ~shared).alias("issue_conflict"),
        exact_subject.alias("exact_subject"),
        coordinate.alias("coordinate"),
        F.exists(l["details"], lambda a: F.exists(r["details"], lambda b: details_compatible(a, b))).alias("compatible"),
        (some(l, "subject_kinds") & some(r, "subject_kinds") & ~comparable).alias("cross_kind"),
        (shared & comparable & ~coordinate & ~exact_subject).alias("subject_conflict"),
        version.alias("version"),
        (some(l, "names") & some(r, "names")).alias("has_name"),
        (l["title"].isNotNull() & r["title"].isNotNull()).alias("has_title"),
        (l["location"].isNotNull() & r["location"].isNotNull()).alias("has_location"),
    )
    c = F.col
    name, title, location = (F.when(c(f"same_{many}"), MAX_SCORE).otherwise(c(f"s.{one}")) for many, one in (("names", "name"), ("title", "title"), ("location", "location")))
    value = (
        F.when(c("shared") & c("coordinate"), 8500 + F.when(c("version") == "exact", 500).otherwise(0) + contribution(title, 300) + contribution(location, 200))
        .when(c("shared"), 5000 + contribution(name, 3000) + contribution(title, 1000) + contribution(location, 500))
        .when(c("exact_subject"), 6000 + contribution(title, 2000) + contribution(location, 1000))
        .when(c("coordinate"), 5500 + contribution(name, 500) + contribution(title, 2000) + contribution(location, 1000))
        .otherwise(F.greatest(name, title) + contribution(location, 500))
    )
    score = F.least(value, F.lit(MAX_SCORE - 1))
    detail_conflict = c("coordinate") & ~c("compatible")
    eligible = (
        c("shared") & ~c("cross_kind") & (c("version") != "different") & ~detail_conflict & (c("compatible") | (c("has_name") & (name > 0) & (name >= config.subject_similarity_threshold)))
    )
    conflict = c("issue_conflict") | c("subject_conflict")
    fuzzy = lambda field, s, has: F.when(~has, _signal(field, "missing", None)).when(s == MAX_SCORE, _signal(field, "exact", MAX_SCORE)).otherwise(_signal(field, "similar", s))
    subject = (
        F.when(c("exact_subject"), "exact")
        .when(detail_conflict, "different")
        .when(c("coordinate"), "similar")
        .when(c("subject_conflict"), "different")
        .when(c("cross_kind"), "incomparable")
        .otherwise("missing")
    )
    evidence = F.struct(
        F.when(conflict, "distinct")
        .when(eligible & (score >= config.duplicate_threshold), "duplicate")
        .when(score >= config.review_threshold, "review")
        .otherwise("distinct")
        .alias("decision"),
        F.when(conflict, 0).otherwise(score).cast("int").alias("score"),
        F.when(conflict, "blocked").otherwise("fuzzy").alias("method"),
        F.array(
            partition,
            kind,
            _signal("issue", F.when(c("shared"), "exact").when(c("issue_conflict"), "different").otherwise("missing"), F.when(c("shared"), MAX_SCORE)),
            _signal("subject", subject, F.when(c("exact_subject") | c("compatible"), MAX_SCORE)),
            _signal("version", c("version"), F.when(c("version") == "exact", MAX_SCORE)),
            fuzzy("subject_name", name, c("has_name")),
            fuzzy("title", title, c("has_title")),
            fuzzy("location", location, c("has_location")),
        ).alias("signals"),
    )
    result = late.select("left", "right", F.when(c("settled").isNotNull(), c("settled")).otherwise(evidence).alias("c"))
    return result.select("left", "right", "c.decision", "c.score", "c.method", "c.signals")
