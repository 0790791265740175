"""Joins that survive keys holding a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coalis.sources.scratch import Scratch


def attach(rows: DataFrame, on: list[str], looked_up: DataFrame, limit: int, weight: str = "n") -> DataFrame:
    """``rows`` joined with the one ``looked_up`` row of their ``on`` columns.

    ``looked_up`` is a written table whose ``weight`` says how many of ``rows`` each of its
    keys has.  Keys of ``limit`` rows or more are attached by broadcast, all others by
    shuffle.  There are at most ``total / limit`` heavy keys, so with ``limit`` a fixed part
    of the total the broadcast is bounded whatever the input.  Without a heavy key nothing is broadcast.
    The weight is not returned.
    """
    if looked_up.where(F.col(weight) >= limit).limit(1).count() == 0:
        return rows.join(looked_up.drop(weight), on)
    heavy = F.broadcast(looked_up.where(F.col(weight) >= limit).drop(weight))
    light = looked_up.where(F.col(weight) < limit).drop(weight)
    usual = rows.join(heavy.select(*on), on, "left_anti").join(light, on)
    return usual.unionByName(rows.join(heavy, on).select(*usual.columns))


def ranked(rows: DataFrame, group: list[str], order: str, scratch: Scratch, name: str, *, heavy: bool) -> DataFrame:
    """``rows`` with ``rank``: the place of each in its group by ``order``, from 1.

    ``heavy`` groups may hold any part of all rows: the rows are range-sorted, numbered inside of
    each range, and the ranges before are added, so no task holds a group.
    """
    if not heavy:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(order)))
    placed = scratch.write(rows.repartitionByRange(*group, order).withColumn("_range", F.spark_partition_id()), name)
    counts = placed.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(order))
    return placed.withColumn("rank", inside).join(offsets, [*group, "_range"]).withColumn("rank", (F.col("rank") + F.col("_before")).cast("int")).drop("_range", "_before")


def numbered(rows: DataFrame, order: list[Column | str], name: str, scratch: Scratch) -> DataFrame:
    """``rows`` with ``name``: their place in the order of all rows, from 1, without a task that holds them all."""
    keys = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(k) for o, k in zip(order, keys, strict=True)])
    placed = scratch.write(keyed.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), f"numbered-{name}")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = placed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    out = placed.withColumn(name, inside).join(offsets, "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("int"))
    return out.select(*rows.columns, name)
