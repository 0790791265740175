"""Text normalisation and Indel similarity in basis points.

``normal_text`` is a Catalyst expression.  Similarity exists twice with one result: a
bit-parallel LCS as a Catalyst expression while the shorter text has at most 62 characters
(:func:`similarity`), and the same recurrence over Python integers for any length, in Arrow
batches (:func:`pair_similarities`).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import trim_unicode


#: ASCII texts that are normal already.
NORMAL = r"\A[a-z0-9]++(?: [a-z0-9]++)*+\z"


def normal_text(c: Column) -> Column:
    """Lower case character by character, letters and digits kept, every other run one space.

    A capital sigma is lowered alone, never to its final form.
    """
    lowered = F.lower(F.replace(trim_unicode(c), F.lit("Σ"), F.lit("σ")))
    return F.when(c.rlike(NORMAL), c).otherwise(F.trim(F.regexp_replace(lowered, r"[^\p{IsAlphabetic}\p{N}]+", " ")))


def to_score(ratio: Column) -> Column:
    return F.floor(F.greatest(F.least(ratio, F.lit(1.0)), F.lit(0.0)) * 10000 + 0.5).cast("int")


def contribution(score: Column, weight: int) -> Column:
    """Integer share of a weight, truncating."""
    product = score * weight
    return ((product - product % 10000) / 10000).cast("int")


def lcs_short(a: Column, b: Column) -> Column:
    """Longest common subsequence; the shorter text must have at most 62 characters."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n = F.length(short)
    full = F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1
    chars = F.split(short, "")
    mask_of = lambda ch: F.aggregate(
        F.transform(chars, lambda x, i: F.when(x == ch, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s + v
    )
    step = lambda v, m: ((v + (v.bitwiseAND(m))).bitwiseOR(v - v.bitwiseAND(m))).bitwiseAND(full)
    last = F.aggregate(F.transform(F.split(long, ""), mask_of), full, step)
    return n - F.bit_count(last)


#: Characters up to which the shorter text fits the bits of one long.
SHORT = 62


def is_short(a: Column, b: Column) -> Column:
    """Whether :func:`similarity` can score the pair."""
    return F.coalesce(F.least(F.length(a), F.length(b)) <= SHORT, F.lit(True))


def similarity(a: Column, b: Column) -> Column:
    """Basis points of two normalised texts; 0 if either is empty, null if either is null.

    The shorter side may have up to :data:`SHORT` characters; a longer pair is an error, see
    :func:`with_similarity` for any length.
    """
    total = F.length(a) + F.length(b)
    ratio = F.lit(1.0) - (total - 2 * lcs_short(a, b)) / total
    long = F.raise_error(F.lit(f"both texts have more than {SHORT} characters")).cast("int")
    return F.when((a == "") | (b == ""), 0).when(~is_short(a, b), long).otherwise(to_score(ratio))


@F.arrow_udf(T.IntegerType())
def _long_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else score_of(min(x, y), max(x, y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


def with_similarity(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``rows`` with the basis points of the normalised texts in ``a`` and ``b``, of any length.

    Only pairs of two long texts go through Python.
    """
    x, y = F.col(a), F.col(b)
    short = rows.where(is_short(x, y)).withColumn(name, similarity(x, y))
    return short.unionByName(rows.where(~is_short(x, y)).withColumn(name, _long_similarity(x, y)))


def lcs(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        if m := masks.get(ch):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@lru_cache(1 << 16)
def score_of(a: str, b: str) -> int:
    """Basis points of two normalised texts of any length."""
    if not a or not b:
        return 0
    total = len(a) + len(b)
    return math.floor((1.0 - (total - 2 * lcs(a, b)) / total) * 10000 + 0.5)


def _scores(function, left: pa.Array, right: pa.Array) -> pa.Array:
    """Scores of the rows that have both sides, 0 elsewhere; only those become Python values."""
    rows = np.flatnonzero(pc.and_(pc.is_valid(left), pc.is_valid(right)).to_numpy(zero_copy_only=False))
    out = np.zeros(len(left), np.int32)
    if len(rows):
        out[rows] = [function(a, b) for a, b in zip(left.take(pa.array(rows)).to_pylist(), right.take(pa.array(rows)).to_pylist(), strict=True)]
    return pa.array(out)


SCORES = T.StructType([T.StructField("name", T.IntegerType()), T.StructField("title", T.IntegerType()), T.StructField("location", T.IntegerType())])


@F.arrow_udf(SCORES)
def pair_similarities(l_names: pa.Array, r_names: pa.Array, l_title: pa.Array, r_title: pa.Array, l_location: pa.Array, r_location: pa.Array) -> pa.Array:
    """Best name, title and location scores of normalised texts; 0 where a side is missing."""
    one = lambda a, b: score_of(a, b) if a <= b else score_of(b, a)
    best = lambda a, b: max((one(x, y) for x in a for y in b), default=0)
    scores = [_scores(one, l_title, r_title), _scores(one, l_location, r_location)]
    return pa.StructArray.from_arrays([_scores(best, l_names, r_names), *scores], ["name", "title", "location"])
