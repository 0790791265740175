"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every record has a fixed random number; its leading bits give its block, so blocks of a
   source are disjoint random samples of it, and one hot source has proportionally more.
2. The total is the largest that every source can meet with its cap of repeats.  A source's
   quota is filled with whole blocks, pass after pass (a record is used once per pass); what
   is then left, less than any further block, is filled with records of one such block (of
   several where blocks are small) by running sums over their random order, so what stays unmet
   is shorter than any record left there.
3. The exact block quotas of all sources are split over the shards by a binary tree: a node
   with a fixed number of blocks draws how many of each source go left from the multivariate
   hypergeometric distribution, so each shard is a uniform sample of the mix and every quota
   is met exactly.
4. Shards draw disjoint blocks from each source's permuted list, and order their records at
   random locally.

The tree has at most ``tree_shards`` leaves, as the driver holds their blocks: at most
``16 * tree_shards`` totals plus 16 per source and pass, whatever the input.  Where more shards are
needed, each leaf is a power of two of shards: a block is cut by further bits of its records'
random numbers into as many parts, and every shard of the leaf gets one part of each block, in an
order that differs by block.  A shard has about ``shard_tokens`` tokens however large the mix.

Defined cases: a null or unlisted source is not mixed; null texts and texts without tokens
are left out; a listed source with a positive share and no records, or no repeats, gets
nothing and the other shares are scaled up; null or non-positive shares get nothing; repeated
targets of one source count once (largest share); an empty table gives an empty result; a
record longer than what is left of its source's quota is passed over for a shorter one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coalis.sources.scratch import BROADCAST_ROWS, Scratch, small_or_shuffled

from .tokens import VOCABULARY, token_count

BLOCKS_PER_SHARD = 16
#: Rounds of running sums that fill the rest of a quota; each only sees records that still fit.
FILL_ROUNDS = 6
PLAN = "source string, block int, bits int, pass int, shard int, cut long"


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) blocks of each source in each shard; shard sizes differ by at most one."""
    out = np.zeros((shards, len(quotas)), np.int64)
    total = int(quotas.sum())
    sizes = np.full(shards, total // shards)
    sizes[: total % shards] += 1
    ends = np.concatenate([[0], np.cumsum(sizes)])
    stack = [(0, shards, quotas.astype(np.int64))]
    while stack:
        lo, hi, here = stack.pop()
        if hi - lo == 1:
            out[lo] = here
            continue
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(here, int(ends[mid] - ends[lo]), method="marginals")
        stack += [(lo, mid, left), (mid, hi, here - left)]
    return out


def plan_mix(totals: dict[str, dict[int, int]], bits: dict[str, int], shares: dict[str, float], repeats: dict[str, int], shards: int, seed: int, rest_tokens: int = 1 << 20) -> tuple[list[tuple], float]:
    """Rows of :data:`PLAN` from block token totals, and the total number of tokens mixed."""
    able = sorted(s for s in totals if shares.get(s, 0) > 0 and repeats.get(s, 0) > 0 and sum(totals[s].values()) > 0)
    scale = sum(shares[s] for s in able)
    if not able:
        return [], 0.0
    total = min(repeats[s] * sum(totals[s].values()) * scale / shares[s] for s in able)
    rng = np.random.default_rng(seed)
    chosen: list[list[tuple]] = []
    for s in able:
        want, rows, skipped = int(round(total * shares[s] / scale)), [], []
        for turn in range(repeats[s]):
            for block in rng.permutation(sorted(totals[s])).tolist():
                n = totals[s][block]
                if n <= want:
                    rows.append((s, block, bits[s], turn, None))
                    want -= n
                elif want > 0:
                    skipped.append((s, block, bits[s], turn))
            if skipped:
                break
        sizes = np.cumsum([totals[s][r[1]] for r in skipped])
        rows += [(*r, want) for r in skipped[: max(int(np.searchsorted(sizes, rest_tokens, "right")), 1)] if want > 0]
        chosen.append([rows[i] for i in rng.permutation(len(rows))])
    drawn = split_tree(np.array([len(r) for r in chosen]), shards, rng)
    plan = []
    for k, rows in enumerate(chosen):
        at = 0
        for shard, n in enumerate(drawn[:, k].tolist()):
            plan += [(*r[:4], shard, r[4]) for r in rows[at : at + n]]
            at += n
    return plan, total


def _fill(part: DataFrame) -> DataFrame:
    """The records of each source's last blocks that fill ``cut`` tokens: those whose running sum fits, round by round."""
    order = Window.partitionBy("source").orderBy("luck", "doc_id")
    whole = Window.partitionBy("source")
    part = part.withColumn("_taken", F.lit(False)).withColumn("_room", F.col("cut"))
    for _ in range(FILL_ROUNDS):
        fits = F.when(~F.col("_taken") & (F.col("n_tokens") <= F.col("_room")), F.col("n_tokens")).otherwise(0)
        part = part.withColumn("_fits", fits).withColumn("_sum", F.sum("_fits").over(order))
        new = (F.col("_fits") > 0) & (F.col("_sum") <= F.col("_room"))
        part = part.withColumn("_new", new).withColumn("_room", F.col("_room") - F.sum(F.when(F.col("_new"), F.col("_fits")).otherwise(0)).over(whole))
        part = part.withColumn("_taken", F.col("_taken") | F.col("_new"))
    return part.where("_taken").drop("_taken", "_room", "_fits", "_sum", "_new")


def mixed(documents: DataFrame, targets: DataFrame, *, vocabulary: str = VOCABULARY, shard_tokens: int = 1 << 18, tree_shards: int = 4096, seed: int = 11) -> DataFrame:
    """(shard, position, doc_id, source, repeat_no, n_tokens): the mixed records in shard order."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).where("source is not null")
    listed = {r["source"]: r for r in wanted.take(10_001)}
    if len(listed) > 10_000:
        raise ValueError("more than 10000 sources")
    known = documents.select("doc_id", "source", "text").where(F.col("text").isNotNull()).join(small_or_shuffled(wanted.select("source")), "source", "left_semi")
    sized = known.select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("n_tokens"), F.xxhash64(F.lit(seed), "source", "doc_id").alias("luck")).where("n_tokens > 0")
    sized = scratch.write(sized, "sized")
    have = {r[0]: int(r[1]) for r in sized.groupBy("source").agg(F.sum("n_tokens")).collect()}  # one row per listed source
    shares = {s: float(r["share"] or 0) for s, r in listed.items()}
    repeats = {s: int(r["repeats"] or 0) for s, r in listed.items()}
    able = [s for s in have if shares[s] > 0 and repeats[s] > 0]
    scale = sum(shares[s] for s in able)
    total = min((repeats[s] * have[s] * scale / shares[s] for s in able), default=0)
    wanted_shards = max(round(total / shard_tokens), 1)
    parts = max(int(np.ceil(np.log2(wanted_shards / tree_shards))), 0)  # a leaf of the tree is 2**parts shards
    shards = int(min(wanted_shards, tree_shards))
    block_tokens = max(total / (shards * BLOCKS_PER_SHARD), 1)
    bits = {s: int(np.ceil(np.log2(max(have[s] / block_tokens, 16)))) for s in able}
    deepest = max(bits.values(), default=0) + parts
    if deepest > 62:
        raise ValueError("shard_tokens is too small for this much text")
    of = spark.createDataFrame([(s, b) for s, b in bits.items()], "source string, bits int")
    blocks = sized.join(small_or_shuffled(of), "source").withColumn("block", F.expr("cast(shiftrightunsigned(luck, 64 - bits) as int)")).withColumn("piece", F.expr(f"cast(shiftrightunsigned(luck, 64 - bits - {parts}) & {(1 << parts) - 1} as int)"))
    totals: dict[str, dict[int, int]] = {s: {} for s in able}
    for s, b, n in blocks.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).collect():  # bounded, see above
        totals[s][b] = int(n)
    plan, _ = plan_mix(totals, bits, shares, repeats, shards, seed, 4 * shard_tokens)
    dealt = spark.createDataFrame(plan, PLAN).drop("bits")
    dealt = F.broadcast(dealt) if len(plan) <= BROADCAST_ROWS else dealt
    used = blocks.join(dealt, ["source", "block"]).select("doc_id", "source", "n_tokens", "luck", "block", "piece", "pass", "shard", "cut")
    rows = used.where("cut is null").unionByName(_fill(used.where("cut is not null")))  # one block of a source, or several of 4 * shard_tokens in all
    turned = F.pmod(F.col("piece") + F.xxhash64(F.lit(seed), "source", "block", "pass"), F.lit(1 << parts))
    rows = rows.withColumn("shard", (F.col("shard").cast("long") * (1 << parts) + turned).cast("long"))
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "doc_id", "pass"), "doc_id", "pass")
    return rows.select("shard", F.row_number().over(order).alias("position"), "doc_id", "source", (F.col("pass") + 1).alias("repeat_no"), "n_tokens")


def share_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_records, max_used) for every target."""
    uses = mix.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("uses"))
    got = uses.groupBy("source").agg(F.sum("n").alias("n_tokens"), F.sum("uses").alias("n_records"), F.max("uses").alias("max_used"))
    every = Window.partitionBy(F.lit(0))  # one row per target
    return (
        targets.groupBy("source").agg(F.max("target_share").alias("target_share"))
        .join(got, "source", "left")
        .withColumn("all", F.sum("n_tokens").over(every))
        .select(
            "source",
            "target_share",
            (F.coalesce("n_tokens", F.lit(0)) / F.col("all")).alias("actual_share"),
            F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
            F.coalesce("n_records", F.lit(0)).alias("n_records"),
            F.coalesce("max_used", F.lit(0)).alias("max_used"),
        )
    )
