"""The pN_ queries: each runs its operator over the whole of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coalis.sources.tables import table

from . import components, incremental, mixing, nearcopies, packing, survivorship, truncation


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"title": F.col("title"), "affected_version": F.col("affected_version"), "source": None}
    return survivorship.survivors(table(spark, sf_dir, "clusters"), table(spark, sf_dir, "candidates"), table(spark, sf_dir, "scan_sources"), fields)


def p1_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.golden_records(table(spark, sf_dir, "clusters"), table(spark, sf_dir, "candidates"), table(spark, sf_dir, "scan_sources"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.linked_keys(table(spark, sf_dir, "comparisons"), table(spark, sf_dir, "clusters"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.candidate_copies(table(spark, sf_dir, "candidates"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.candidate_classes(table(spark, sf_dir, "candidates"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.repeated(table(spark, sf_dir, "candidates"), table(spark, sf_dir, "incoming_candidates"))


def p5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.nearly_repeated(table(spark, sf_dir, "candidates"), table(spark, sf_dir, "incoming_candidates"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p6_packed(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p6_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return packing.locality(p6_packed(spark, sf_dir), packing.curve_places(documents))


def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: texts placed, pieces beyond the first, and containers over the capacity, pieces of texts that fit and gaps in pieces (none)."""
    out, kinds = p6_packed(spark, sf_dir), packing.capacities(table(spark, sf_dir, "pack_sizes"))
    texts = out.groupBy("container_kind", "doc_id").agg(F.count("*").alias("pieces"), F.max("piece_no").alias("last"), F.sum("n_tokens").alias("n")).join(F.broadcast(kinds), "container_kind")
    fits = F.greatest(F.ceil(F.col("n") / F.col("capacity")), F.lit(1))
    texts = texts.groupBy("container_kind").agg(
        F.count("*").alias("n_documents"), F.count_if(F.col("pieces") != fits).alias("wrongly_cut"), F.count_if(F.col("last") + 1 != F.col("pieces")).alias("gaps")
    )
    full = out.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(kinds), "container_kind")
    full = full.groupBy("container_kind").agg(F.count_if(F.col("n") > F.col("capacity")).alias("overfull"))
    return texts.join(full, "container_kind")


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: its share, whether the share reached is within half a percent of all tokens or one record, and uses over the cap, uses of another source and repeats of a use (none)."""
    mix, targets = p7_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    uses = mix.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.count_distinct("repeat_no").alias("turns"), F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("longest"))
    uses = uses.join(table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.collect_set("source").alias("of")), "doc_id")
    got = uses.groupBy("source").agg(F.max("uses").alias("most"), F.count_if(F.col("uses") != F.col("turns")).alias("repeated_uses"), F.count_if(~F.array_contains("of", F.col("source"))).alias("foreign"), F.sum("n").alias("n"), F.max("longest").alias("longest"))
    every = Window.partitionBy(F.lit(0))  # one row per target
    near = F.greatest(F.lit(0.005), F.max("longest").over(every) / F.sum("n").over(every))
    share = F.col("n") / F.sum("n").over(every)
    return targets.join(got, "source").select(
        "source", "target_share", (F.abs(share - F.col("target_share")) < near).alias("reached"), (F.col("most") > F.col("max_repeats")).alias("overused"), "repeated_uses", "foreign"
    )


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.share_report(p7_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_golden": p1_golden,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p5_found": p5_found,
    "p5_near": p5_near,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p6_locality": p6_locality,
    "p6_checked": p6_checked,
    "p7_mixed": p7_mixed,
    "p7_checked": p7_checked,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_rates": p8_rates,
}
