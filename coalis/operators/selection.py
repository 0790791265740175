"""Exact selection by refining histograms with mergeable counts: per-key quantiles and heavy keys.

No key's values are ever gathered.  A round splits the open interval of each (key,
quantile) into ``2**bits`` equal bins, adds the counts of the bins (combined on the map
side, so a key with a third of all rows sends one row per bin and map task), and keeps the
bin that holds the wanted rank.  After ``ceil(width / bits)`` rounds the bin is one value.
A key's histogram has at most ``2**bits`` rows in a round, which bounds the running sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coalis.operators.skew import attach
from coalis.sources.scratch import Scratch, small_or_shuffled

#: A (key, bin) with at least this part of the counted values is attached by broadcast.
HEAVY_PARTS = 2000


def key_quantiles(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float], *, min_rows: int = 1, bits: int = 16) -> DataFrame:
    """(keys, n, n_values, one column per quantile) for each key of at least ``min_rows`` rows.

    ``value`` is integral.  The quantile p of m values is the value of rank ``ceil(p * m)``,
    at least 1.  Defined cases: null values count in ``n`` only; a key without values has null
    quantiles; a key with a null part is a key; ties and repeated rows all count; an empty
    input gives an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "selection")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count(value).alias("n_values"), F.min(value).alias("_lo"), F.max(value).alias("_hi")).where(F.col("n") >= min_rows)
    counts = scratch.write(counts, "counts")
    lo, hi, total = counts.agg(F.min("_lo"), F.max("_hi"), F.sum("n_values")).first()
    result = counts.drop("_lo", "_hi")
    if not total or not probs:
        return result.select("*", *[F.lit(None).cast("long").alias(p) for p in probs])
    limit = max(total // HEAVY_PARTS, 1000)
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    key_id = F.xxhash64(*[c for k in keys for c in (F.col(k), F.col(k).isNull())])
    # one row per key and value; the number of its rows is a mergeable count
    wanted = counts.where("n_values > 0").select(*keys)
    kept = rows.where(F.col(value).isNotNull()).select(*keys, (F.col(value) - F.lit(lo)).alias("v"))
    if min_rows > 1:
        small = small_or_shuffled(wanted)
        kept = kept.join(small, same(kept, small), "left_semi")
    base = scratch.write(kept.groupBy(*keys, "v").agg(F.count("*").alias("c")).withColumn("_h", key_id), "values")
    width = max(int(hi - lo).bit_length(), 1)
    shifts = [*range(width - bits, 0, -bits), 0] if width > bits else [0]

    by_key = [*keys, "_h"]
    hist = base.groupBy(*by_key, F.shiftright("v", shifts[0]).alias("b")).agg(F.sum("c").alias("c"))
    ends = hist.withColumn("end", F.sum("c").over(Window.partitionBy(*by_key).orderBy("b"))).withColumn("m", F.sum("c").over(Window.partitionBy(*by_key)))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("p"), F.greatest(F.ceil(F.lit(p) * F.col("m")), F.lit(1)).alias("r")) for name, p in probs.items()]))
    found = (
        ends.select("*", ranks.alias("_t"))
        .where("_t.r <= end and _t.r > end - c")
        .select(*by_key, F.col("_t.p").alias("p"), (F.col("_t.r") - (F.col("end") - F.col("c"))).alias("r"), F.col("b").alias("prefix"), F.col("c").alias("n"))
    )
    found = scratch.write(found, "open0")
    for i, shift in enumerate(shifts[1:], 1):
        # only values inside an open bin are counted again
        bins = scratch.write(found.groupBy(*by_key, "prefix").agg(F.max("n").alias("n")), f"bins{i}")
        inside = base.withColumn("prefix", F.shiftright("v", shifts[i - 1]))
        inside = attach(inside, ["_h", "prefix"], bins.select("_h", "prefix", *[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], "n"), limit)
        inside = inside.where(F.expr(" and ".join(f"{k} <=> _k{j}" for j, k in enumerate(keys))))
        hist = inside.groupBy(*by_key, "prefix", F.shiftright("v", shift).alias("b")).agg(F.sum("c").alias("c"))
        ends = hist.withColumn("end", F.sum("c").over(Window.partitionBy(*by_key, "prefix").orderBy("b")))
        targets = found.select("_h", "prefix", "p", "r", *[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)])
        found = (
            ends.join(targets, ["_h", "prefix"])
            .where(F.expr(" and ".join(f"{k} <=> _k{j}" for j, k in enumerate(keys))))
            .where("r <= end and r > end - c")
            .select(*by_key, "p", (F.col("r") - (F.col("end") - F.col("c"))).alias("r"), F.col("b").alias("prefix"), F.col("c").alias("n"))
        )
        found = scratch.write(found, f"open{i}")
    wide = found.groupBy(*by_key).agg(*[F.max(F.when(F.col("p") == p, F.col("prefix") + F.lit(lo))).alias(p) for p in probs])
    keyed = result.withColumn("_h", key_id)
    out = keyed.join(wide.select("_h", *[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], *probs), [keyed["_h"] == wide["_h"], *[F.expr(f"{k} <=> _k{j}") for j, k in enumerate(keys)]], "left")
    return out.select(*keys, "n", "n_values", *probs)






def heavy_keys(rows: DataFrame, keys: list[str], min_rows: int, *, bits: int = 16) -> DataFrame:
    """(keys, n) of each key with at least ``min_rows`` rows, without counting the other keys one by one.

    The same selection over the order of the keys' hashes: a key with ``min_rows`` rows covers a
    rank that is a multiple of ``min_rows``, so each round keeps the bins that can hold such a
    rank (those with ``min_rows`` rows, at most total / min_rows of them) and splits them into
    ``2**bits`` again, until a bin is one hash.  A map task sends at most one count a bin and
    kept bin, however many keys there are; the many light keys leave after the first round or two.
    The rows of the resolved hashes are then counted by key, which tells keys of one hash apart.

    Defined cases: a null part is a key; repeated rows all count; ``min_rows`` below 1 counts as
    1; an empty input gives an empty result; other columns are ignored.
    """
    scratch = Scratch(rows.sparkSession, "heavy")
    least = max(min_rows, 1)
    hashed = rows.select(*keys, F.xxhash64(*[c for k in keys for c in (F.col(k), F.col(k).isNull())]).alias("_h"))
    hashed = scratch.write(hashed, "hashed")
    prefix = lambda depth: F.shiftrightunsigned("_h", 64 - depth).alias("_bin") if depth < 64 else F.col("_h").alias("_bin")
    kept, inside = None, hashed.select("_h")
    for depth in [*range(bits, 64, bits), 64]:
        if kept is not None:
            inside = hashed.select("_h", prefix(done)).join(small_or_shuffled(kept.select("_bin")), "_bin", "left_semi").select("_h")
        bins = inside.groupBy(prefix(depth)).agg(F.count("*").alias("n"), F.min("_h").alias("lo"), F.max("_h").alias("hi")).where(F.col("n") >= least)
        kept, done = scratch.write(bins, f"bins{depth}"), depth
        if not kept.where("lo <> hi").limit(1).count():
            break
    hot = hashed.join(small_or_shuffled(kept.select(F.col("lo").alias("_h"))), "_h", "left_semi")
    return hot.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
