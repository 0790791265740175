"""The test tables as raw findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coalis.config import Config
from coalis.operators import candidates as C
from coalis.sources.tables import table


def _prepared(raw: DataFrame, config: Config = Config()) -> DataFrame:
    """Accepted findings, prepared, with their native id as a readable key."""
    good = C.accepted(C.build(raw))
    return C.prepared(C.with_keys(good, config, F.col("origin.native_id")))


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one finding per event; the issue is the event's k."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    tag = F.create_map(*[F.lit(x) for pair in (("error", "vulnerability"), ("view", "misconfiguration"), ("purchase", "secret"), ("click", "code"), ("signup", "other")) for x in pair])[F.col("event_type")]
    return C.with_columns(
        e,
        {
            "source": F.concat(F.lit("scanner-"), F.col("event_id") % 4),
            "native_id": F.col("event_id").cast("string"),
            "partition": F.concat(F.lit("tenant:"), F.col("user_id") % 50),
            "kind": F.struct(tag.alias("tag"), F.when(tag == "other", F.col("event_type")).alias("value")),
            "issues": F.array(F.concat(F.lit("cve-2024-"), "k")),
            "title": F.concat_ws(" ", "event_type", F.lit("anomaly"), "k"),
            "affected_version": F.floor(F.col("value") / 100).cast("string"),
        },
    )


def shipment_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one finding per shipped line; the subject is the part as a PURL, its version the line number."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.min("l_shipdate").alias("shipped"))
    j = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("y", F.year("shipped").cast("string"))
    return C.with_columns(
        j,
        {
            "source": F.concat(F.lit("scanner-"), F.col("l_suppkey") % 5),
            "native_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
            "partition": F.concat(F.lit("ship-year:"), "y"),
            "issues": F.array(F.concat_ws("-", F.lit("CVE"), "y", "l_partkey")),
            "purls": F.array(
                F.concat(F.lit("pkg:generic/"), F.lower(F.translate("p_brand", "#", "-")), F.lit("/"), F.translate("p_name", " ", "-"), F.lit("-"), F.col("p_partkey"), F.lit("@"), F.col("l_linenumber"))
            ),
            "subject_names": F.array("p_name"),
            "title": F.concat_ws(" ", "p_name", F.lower("p_type")),
        },
    )


def part_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per part without issue or subject: text evidence only."""
    return C.with_columns(
        table(spark, sf_dir, "part"),
        {
            "source": F.concat(F.lit("scanner-"), F.col("p_partkey") % 5),
            "native_id": F.col("p_partkey").cast("string"),
            "partition": F.lit("catalogue"),
            "subject_names": F.array("p_name"),
            "title": F.concat_ws(" ", "p_name", "p_type"),
            "location": F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")),
        },
    )


def bridge_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four findings per part: a and d share their exact key, b and c are fuzzy duplicates of both but not of each other.

    The title says which of b and c is nearer (b for even parts), and b comes from the source of a
    for every third part, so complete links leave one of them out.
    """
    one = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*[F.lit(x) for x in "abcd"])).alias("w"))
    third, even = F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 2 == 0
    w = F.col("w")
    return C.with_columns(
        one,
        {
            "source": F.when((w == "b") & third, "scanner-a").otherwise(F.concat(F.lit("scanner-"), w)),
            "native_id": F.concat_ws("-", F.col("p_partkey"), w),
            "partition": F.lit("shelf"),
            "issues": F.array(F.concat(F.lit("CVE-1-"), F.col("p_partkey"))),
            "purls": F.array(F.concat(F.lit("pkg:generic/lamp-"), F.col("p_partkey"), F.lit("@1"), F.when(w == "b", "?arch=x").when(w == "c", "?arch=y").otherwise(""))),
            "title": F.when((w == "b") & ~even | (w == "c") & even, "oooo").otherwise("eeee"),
        },
    )


def bridges(spark, sf_dir):
    return _prepared(bridge_findings(spark, sf_dir))


def stored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted candidates, one row per occurrence key (the smallest cand_id), texts that cannot be built left out."""
    c = table(spark, sf_dir, "candidates")
    first = c.groupBy(F.lower("occurrence_key").alias("k")).agg(F.min("cand_id").alias("cand_id"))
    c = c.join(first, "cand_id")
    present = lambda name: F.when(F.trim(F.regexp_replace(name, r"[\p{Z}\p{Cc}]+", " ")) != "", F.regexp_replace(name, r"\p{Cc}", " "))
    strings = lambda name: F.filter(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(F.regexp_replace(x, r"[\p{Z}\p{Cc}]+", " ")) != ""))
    return C.with_columns(
        c,
        {
            "source": F.col("origin.source"),
            "subtype": F.col("origin.subtype"),
            "native_id": F.col("origin.native_id"),
            "issues": strings("issue_ids"),
            "purls": F.filter(strings("subject_ids"), lambda s: F.startswith(s, F.lit("pkg:"))),
            "cpes": F.filter(strings("subject_ids"), lambda s: ~F.startswith(s, F.lit("pkg:"))),
            "subject_names": F.transform(strings("subject_names"), lambda x: F.regexp_replace(x, r"\p{Cc}", " ")),
            "title": present("title"),
            "location": present("location"),
            "affected_version": present("affected_version"),
        },
    )


def events(spark, sf_dir):
    return _prepared(event_findings(spark, sf_dir))


def shipments(spark, sf_dir):
    return _prepared(shipment_findings(spark, sf_dir))


def parts(spark, sf_dir):
    return _prepared(part_findings(spark, sf_dir))
