"""Connected groups by alternating large-star and small-star rewrites.

Keys become longs in key order once (a range sort over the distinct keys), so each round
moves sixteen bytes an edge and the smallest long is the smallest key.

* large-star: every node u links its larger neighbours to m, the smallest of u and its
  neighbours;
* small-star: every node u links its smaller neighbours and itself to the smallest of them.

A group is final once it is one star (its root's neighbours have no other neighbour, which
the per-node degrees tell); its edges leave the loop, so rounds after the first ones only
carry the groups with long chains.

Both rewrites are one grouped minimum and one join back to the edges.  The minimum is combined on
the map side.  For the join back a node of high degree would gather its edges in one task,
so the minima of such nodes are broadcast: a node is hot from 1/``HOT_PARTS`` of the edges
on, which bounds the number of hot nodes by 2 * ``HOT_PARTS`` whatever the input.  All
other nodes shuffle.  Every round is written to the shared folder (no lineage grows, lost
executors cost only their tasks).  The loop ends when no edge is left to change.

Defined cases: null ends and self-links are ignored, repeated links count once, an empty
input gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coalis.operators.skew import attach
from coalis.sources.scratch import Scratch

#: A node with at least this part of all edges is hot; there are at most twice as many.
HOT_PARTS = 2000


def connected(edges: DataFrame, left: str = "left", right: str = "right", name: str = "components") -> DataFrame:
    """(key, group_key) for every key linked to another one; ``group_key`` is the smallest key of its group.

    ``left`` and ``right`` may be strings, binaries or numbers; keys compare as that type does.
    """
    scratch = Scratch(edges.sparkSession, name)
    links = scratch.write(
        edges.select(F.least(left, right).alias("l"), F.greatest(left, right).alias("r"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .distinct(),
        "links",
    )
    keys = links.select(F.explode(F.array("l", "r")).alias("key")).groupBy("key").agg(F.count("*").alias("n")).sort("key")
    keys = scratch.write(keys.select("key", F.monotonically_increasing_id().alias("id"), "n"), "keys")
    open_edges = links.count()
    limit = max(open_edges // HOT_PARTS, 1000)
    lower = attach(links, ["l"], keys.select(F.col("key").alias("l"), F.col("id").alias("m"), "n"), limit)
    both_ids = attach(lower, ["r"], keys.select(F.col("key").alias("r"), F.col("id").alias("a"), "n"), limit)
    current = scratch.write(both_ids.select("a", "m"), "round0")
    scratch.drop("links")
    finished, turn = None, 0
    while open_edges:
        turn += 1
        limit = max(open_edges // HOT_PARTS, 1000)
        # large-star: the minimum runs over u and all its neighbours; only the larger ones are rewritten
        both = current.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("m").alias("v")), F.struct(F.col("m").alias("u"), F.col("a").alias("v")))).alias("e"))
        both = both.select("e.u", "e.v")
        minima = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), f"minima{turn}")
        # a root whose neighbours all have no other neighbour is a whole group: its edges are final
        leaves = minima.where("n = 1 and m < u").groupBy("m").agg(F.count("*").alias("leaves"))
        stars = leaves.join(minima.where("u = m").select(F.col("u").alias("m"), "n"), "m").where("leaves = n").select(F.col("m").alias("u"), F.lit(True).alias("star"))
        flagged = minima.where("n > 1 or u = m").join(stars, "u", "left").select("u", "m", F.coalesce("star", F.lit(False)).alias("star"), "n")
        flagged = scratch.write(flagged, f"flagged{turn}")
        large = attach(both.where("v > u"), ["u"], flagged, limit).select(F.col("v").alias("a"), "m", "star")
        large = scratch.write(large, f"large{turn}")
        final = scratch.write(large.where("star").select("a", "m"), f"final{turn}")
        finished = final if finished is None else finished.unionByName(final)
        # small-star: every row (a, m) of a node a holds one of its smaller neighbours
        rest = large.where("not star").select("a", "m")
        lows = scratch.write(rest.groupBy("a").agg(F.min("m").alias("m"), F.count("*").alias("n")), f"lows{turn}")
        others = attach(rest.withColumnRenamed("m", "x"), ["a"], lows, limit).where("x > m").select(F.col("x").alias("a"), "m")
        current = scratch.write(others.unionByName(lows.select("a", "m")).distinct(), f"round{turn}")
        open_edges = current.count()
        scratch.drop(f"round{turn - 1}", f"minima{turn}", f"flagged{turn}", f"large{turn}", f"lows{turn}")
    if finished is None:
        return keys.select("key", F.col("key").alias("group_key"))
    sizes = finished.groupBy("m").agg(F.count("*").alias("n"))
    roots = scratch.write(sizes.join(keys.select(F.col("id").alias("m"), F.col("key").alias("group_key")), "m"), "roots")
    named = attach(finished, ["m"], roots, max(keys.count() // HOT_PARTS, 1000)).select(F.col("a").alias("id"), "group_key")
    members = keys.join(named, "id").select("key", "group_key")
    return members.unionByName(roots.select(F.col("group_key").alias("key"), "group_key"))


def latest_duplicates(comparisons: DataFrame) -> DataFrame:
    """(left, right) of the pairs whose latest comparison, in either order, says duplicate.

    Decisions count regardless of case and blanks; equal times are settled by the larger
    comparison_id; a null time is the earliest; null keys and self-comparisons give no link.
    """
    a, b = F.lower("left_key"), F.lower("right_key")
    said = F.coalesce(F.lower(F.trim("decision")) == "duplicate", F.lit(False))
    return (
        comparisons.where(a != b)
        .select(compact_key(F.least(a, b)).alias("left"), compact_key(F.greatest(a, b)).alias("right"), F.struct("compared_at", "comparison_id", said.alias("d")).alias("s"))
        .groupBy("left", "right")
        .agg(F.max("s").alias("s"))
        .where("s.d")
        .select("left", "right")
    )


def member_links(clusters: DataFrame) -> DataFrame:
    """(left, right) chaining each list's distinct members to its smallest one: a star, never all pairs."""
    listed = clusters.select(F.array_sort(F.array_distinct(F.filter(F.transform("members", F.lower), lambda m: m.isNotNull()))).alias("m"))
    listed = listed.where(F.size("m") > 1)
    return listed.select(F.col("m")[0].alias("left"), F.explode(F.slice("m", 2, F.size("m") - 1)).alias("right")).select(
        compact_key("left").alias("left"), compact_key("right").alias("right")
    )


# A key of the usual form (fixed prefix, 64 hex digits) is carried as its 32 bytes after a zero
# byte; any other key as its text after a one byte, so it sorts after the usual ones.
_PREFIX = "occ:v1:"


def compact_key(key: Column | str) -> Column:
    """A lower-case key as bytes, about half as long; :func:`key_text` is the inverse."""
    key = F.col(key) if isinstance(key, str) else key
    usual = key.rlike(f"^{_PREFIX}[0-9a-f]{{64}}$")
    return F.when(usual, F.concat(F.unhex(F.lit("00")), F.unhex(F.substring(key, len(_PREFIX) + 1, 64)))).otherwise(F.concat(F.unhex(F.lit("01")), F.encode(key, "UTF-8")))


def key_text(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    body = F.substring(key, 2, 1 << 30)
    return F.when(F.hex(F.substring(key, 1, 1)) == "00", F.concat(F.lit(_PREFIX), F.lower(F.hex(body)))).otherwise(F.decode(body, "UTF-8"))


def linked_keys(comparisons: DataFrame, clusters: DataFrame) -> DataFrame:
    """(occurrence_key, group_key) for every key in a group of two or more."""
    edges = latest_duplicates(comparisons).unionByName(member_links(clusters))
    out = connected(edges, name="linked")
    return out.select(key_text("key").alias("occurrence_key"), key_text("group_key").alias("group_key"))
