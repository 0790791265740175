"""Near-duplicate records by a binary-trie Hamming self-join.

1. A record's text is its bag of words (case, punctuation, spacing and order are gone).
   Records of one group (partition and kind) with the same bag form one class; everything
   below runs on one representative a class.
2. The fingerprint is a 1-bit minhash over the multiset of the words' padded trigrams (the n-th
   repeat of a trigram is an element of its own): ``TRIES`` blocks of ``BITS`` bits.  A bit differs
   with probability (1 - Jaccard) / 2: about 0.1 at 0.8, 0.45 between unrelated records.
3. Each block is a binary trie.  Node pairs are walked together from the root; every
   differing bit costs one error, and a pair over ``ERRORS`` is pruned with everything below
   it.  What is left must also keep the whole fingerprint within ``TOTAL_ERRORS``.  A pair
   at the threshold survives one trie with probability 0.56 and one of eight with 0.999.
4. Surviving pairs are verified exactly: multiset Jaccard of the words' padded bigrams over
   ``threshold``.  A letter that is wrong changes two bigrams of its word and three trigrams, so
   bigrams weigh a slight misspelling less; their agreement of 0.8 is one of about 0.75 to 0.8 in
   trigrams, which tell unrelated records apart better and so make the fingerprint.

A group of more than ``NODE_ROWS`` classes is cut at the top of each trie: a task is one pair
of subtrees whose paths differ in at most ``ERRORS`` bits, and subtrees that are still too
large are cut into slices by id, so no task sees more than about two slices of rows.

All pairs of records come out, also those within a class and between the classes of a verified
pair, so the result grows with the square of the largest classes.  A class of more than ``SLICE``
records is expanded in pairs of slices, so no row and no task holds a class.  Only where ``SHOWN``
is set does a larger class come out as a star around its smallest record, which then also stands
for it in pairs with other classes; the queries do not set it.

Defined cases: null partition, kind or id: the row is in no pair; null fields and null array
members say nothing; rows whose three fields say nothing at all are in no pair; empty tables
give an empty result; other columns are ignored; very long texts are used whole.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coalis.operators.skew import attach
from coalis.sources.scratch import Scratch, small_or_shuffled

TRIES, BITS, ERRORS, TOTAL_ERRORS = 8, 24, 2, 38
NODE_ROWS = 16384
#: Records of a class in one list; a larger class is expanded in pairs of such lists.
SLICE = 1024
#: Records from which a class comes out as a star; None: all pairs come out.
SHOWN: int | None = None
#: A class with at least this part of all rows is attached by broadcast.
HOT_PARTS = 2000
WORDS = TRIES * BITS // 64


def bag(*texts: Column) -> Column:
    """The sorted words of several texts in one string; empty if they say nothing."""
    text = F.lower(F.concat_ws(" ", *texts))
    text = F.regexp_replace(text, r"\p{Cf}+", "")
    words = F.split(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}\p{M}]+", " ")), " ")
    return F.concat_ws(" ", F.array_sort(words))


@lru_cache(1 << 16)
def _bigrams(word: str) -> tuple[str, ...]:
    padded = f" {word} "
    return tuple(padded[i : i + 2] for i in range(len(padded) - 1))


def features(text: str) -> frozenset:
    """Numbered bigrams of a bag: the n-th repeat of a bigram is a feature of its own."""
    grams = [g for word in text.split(" ") for g in _bigrams(word)]
    once = frozenset(grams)
    if len(once) == len(grams):
        return once
    return once | {(g, i) for g, n in Counter(grams).items() if n > 1 for i in range(1, n)}


def jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    union = len(a) + len(b) - both
    return both / union if union else 0.0


@lru_cache(1)
def _hashes() -> np.ndarray:
    """uint16 (2**16, bits): the value every hash function gives every trigram code."""
    return np.random.default_rng(20240229).integers(0, 1 << 16, (1 << 16, TRIES * BITS), dtype=np.uint16)


def _grouped_minima(table: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Row i: the minimum over ``table[codes[starts[i] : starts[i] + sizes[i]]]``, rows of one size at a time."""
    out = np.empty((len(starts), table.shape[1]), table.dtype)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for alike in np.split(order, cuts):
        for at in range(0, len(alike), 2048):
            rows = alike[at : at + 2048]
            first, size = starts[rows], int(sizes[rows[0]])
            if len(rows) * 64 < size:  # few and long: in steps along each
                for r, f in zip(rows.tolist(), first.tolist(), strict=True):
                    steps = [table[codes[i : min(i + 8192, f + size)]].min(axis=0) for i in range(f, f + size, 8192)]
                    out[r] = np.min(steps, axis=0)
                continue
            least = table[codes[first]]
            for k in range(1, size):
                np.minimum(least, table[codes[first + k]], out=least)
            out[rows] = least
    return out


def _reduced(codes: np.ndarray) -> np.ndarray:
    """16-bit codes of 64-bit ones."""
    return ((codes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64)


def _word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit codes of the padded trigrams of all words, and where each word's start and how many they are."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    mixed = points[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ points[2:] * np.uint64(0x165667B19E3779F9)
    return mixed, np.cumsum(lengths + 2) - (lengths + 2), lengths


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions ``starts[i] .. starts[i] + sizes[i] - 1``, one run behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _repeat_minima(grams: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with repeated trigrams and the minimum of each hash over their numbered repeats."""
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    number = np.arange(len(grams)) - np.maximum.accumulate(np.where(first, np.arange(len(grams)), 0))
    again = number > 0
    codes = _reduced((grams[again] + number[again].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB))
    which, starts, sizes = np.unique(rows[again], return_index=True, return_counts=True)
    return which, _grouped_minima(_hashes(), codes, starts, sizes)


def fingerprints(bags: list[str]) -> np.ndarray:
    """uint64 array (rows, WORDS) of 1-bit minhashes; bags must not be empty."""
    split = [t.split(" ") for t in bags]
    index: dict[str, int] = {}
    codes = np.array([index.setdefault(w, len(index)) for ws in split for w in ws])
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    grams, starts, lengths = _word_grams(list(index))
    by_word = _grouped_minima(_hashes(), _reduced(grams), starts, lengths)
    least = _grouped_minima(by_word, codes, np.cumsum(sizes) - sizes, sizes)
    rows = np.repeat(np.repeat(np.arange(len(split)), sizes), lengths[codes])
    which, minima = _repeat_minima(grams[_spread(starts[codes], lengths[codes])], rows)
    least[which] = np.minimum(least[which], minima)
    return np.packbits((least & 1).astype(np.uint8), axis=1).view(">u8").astype(np.uint64)


_SIGNATURE = T.StructType([T.StructField(f"s{i}", T.LongType()) for i in range(WORDS)])


@F.arrow_udf(_SIGNATURE)
def _signature(bags: pa.Array) -> pa.Array:
    texts = bags.to_pylist()
    signs = fingerprints(texts) if texts else np.empty((0, WORDS), np.uint64)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(signs[:, i]).view(np.int64)) for i in range(WORDS)], [f"s{i}" for i in range(WORDS)])


def _blocks(signs: np.ndarray) -> np.ndarray:
    """uint32 (TRIES, rows): the BITS-bit block of each trie, first bit on top."""
    bits = np.unpackbits(signs.astype(">u8").view(np.uint8).reshape(len(signs), -1), axis=1)
    weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.uint32)
    return np.stack([(bits[:, t * BITS : (t + 1) * BITS] * weights).sum(1, dtype=np.uint32) for t in range(TRIES)])


def trie_join(left: np.ndarray, right: np.ndarray | None, depth: int, check) -> list[tuple[np.ndarray, np.ndarray]]:
    """Walk two tries (or one with itself) in node pairs and return what ``check`` keeps.

    ``left`` and ``right`` are sorted block values whose first ``depth`` bits were already
    walked.  A node is a range of a sorted array.  ``check(i, j)`` gets positions of pairs
    under surviving leaves.
    """
    same = right is None
    right = left if same else right
    found: list[tuple[np.ndarray, np.ndarray]] = []
    first = int(bin((int(left[0]) ^ int(right[0])) >> (BITS - depth)).count("1")) if depth and len(left) and len(right) else 0
    stack = [(depth, np.array([[0, len(left), 0, len(right), first]], np.int64))]
    while stack:
        d, f = stack.pop()
        sizes = (f[:, 1] - f[:, 0]) * (f[:, 3] - f[:, 2])
        done = (sizes <= 24) | (d == BITS)
        if done.any():
            _expand(f[done], same, check, found)
            f = f[~done]
        if not len(f):
            continue
        if len(f) > 1 << 18:
            half = len(f) // 2
            stack += [(d, f[:half]), (d, f[half:])]
            continue
        shift = BITS - 1 - d

        def middle(values, lo, hi, shift=shift):
            want = ((values[lo].astype(np.int64) >> (shift + 1)) << (shift + 1)) | (1 << shift)
            return np.clip(np.searchsorted(values, want.astype(np.uint32)), lo, hi)

        am, bm = middle(left, f[:, 0], f[:, 1]), middle(right, f[:, 2], f[:, 3])
        a0, a1 = (f[:, 0], am), (am, f[:, 1])
        b0, b1 = (f[:, 2], bm), (bm, f[:, 3])
        children = [(a0, b0, 0), (a1, b1, 0), (a0, b1, 1), (a1, b0, 1)]
        parts = []
        for n, (a, b, cost) in enumerate(children):
            keep = (a[1] > a[0]) & (b[1] > b[0]) & (f[:, 4] + cost <= ERRORS)
            if n == 3 and same:
                keep &= f[:, 0] != f[:, 2]  # a node with itself: its two crossings are one
            if keep.any():
                parts.append(np.column_stack([a[0], a[1], b[0], b[1], f[:, 4] + cost])[keep])
        if parts:
            stack.append((d + 1, np.concatenate(parts)))
    return found


def _expand(nodes: np.ndarray, same: bool, check, found: list) -> None:
    sizes = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
    ends = np.cumsum(sizes)
    start = 0
    while start < len(nodes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 21), "right")))
        part = nodes[start:stop]
        for piece in _pieces(part):
            n = (piece[:, 1] - piece[:, 0]) * (piece[:, 3] - piece[:, 2])
            which = np.repeat(np.arange(len(piece)), n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = (piece[:, 3] - piece[:, 2])[which]
            i, j = piece[which, 0] + inside // width, piece[which, 2] + inside % width
            if same:
                keep = (i < j) | (piece[which, 0] != piece[which, 2])
                i, j = i[keep], j[keep]
            found.append(check(i, j))
        start = stop


def _pieces(nodes: np.ndarray):
    """One node pair larger than the step is cut along its left side."""
    if len(nodes) > 1:
        yield nodes
        return
    lo, hi, blo, bhi, err = nodes[0]
    step = max((1 << 21) // max(bhi - blo, 1), 1)
    for at in range(lo, hi, step):
        yield np.array([[at, min(at + step, hi), blo, bhi, err]]) if hi - lo > step else nodes[:1]


def _walk(ids_a, signs_a, ids_b, signs_b, tries, depth: int):
    """Pairs of ids found by the given tries and within the whole budget."""
    blocks_a = _blocks(signs_a)
    blocks_b = None if signs_b is None else _blocks(signs_b)
    out_a, out_b = [], []
    for t in tries:
        oa = np.argsort(blocks_a[t], kind="stable")
        va, sa, ia = blocks_a[t][oa], signs_a[oa], ids_a[oa]
        if signs_b is None:
            vb, sb, ib = None, sa, ia
        else:
            ob = np.argsort(blocks_b[t], kind="stable")
            vb, sb, ib = blocks_b[t][ob], signs_b[ob], ids_b[ob]

        def check(i, j, sa=sa, sb=sb):
            distance = np.zeros(len(i), np.uint8)
            for w in range(WORDS):
                distance += np.bitwise_count(sa[i, w] ^ sb[j, w])
            keep = distance <= TOTAL_ERRORS
            return i[keep], j[keep]

        for i, j in trie_join(va, vb, depth, check):
            out_a.append(ia[i])
            out_b.append(ib[j])
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
    return pairs[:, 0], pairs[:, 1]


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _task(rows: pa.Table) -> pa.Table:
    """One task: a whole small group in all tries, or one pair of subtree slices in one trie."""
    ids = rows["rep"].to_numpy()
    signs = np.column_stack([rows[f"s{i}"].to_numpy() for i in range(WORDS)]).view(np.uint64)
    trie, depth = rows["trie"][0].as_py(), rows["depth"][0].as_py()
    side = rows["side"].to_numpy()
    tries = range(TRIES) if trie < 0 else [trie]
    if rows["pair"][0].as_py() == 0:
        a, b = _walk(ids, signs, None, None, tries, depth)
    else:
        l, r = side == 0, side == 1
        if not l.any() or not r.any():
            return _PAIRS.empty_table()
        a, b = _walk(ids[l], signs[l], ids[r], signs[r], tries, depth)
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], _PAIRS)


def _masks(depth: int) -> list[int]:
    """All ways to differ in at most ERRORS of ``depth`` bits."""
    out = [0]
    for _ in range(ERRORS):
        out = sorted({m | (1 << i) for m in out for i in range(depth)} | set(out))
    return out


MAX_DEPTH = 14


def _tasks(classes: DataFrame) -> DataFrame:
    """Rows of classes assigned to tasks; a row of a cut group goes to several."""
    sizes = classes.groupBy("gkey").agg(F.count("*").alias("size")).where("size > 1")
    large = small_or_shuffled(sizes.where(F.col("size") > NODE_ROWS).select("gkey", "size"))
    signs = [f"s{i}" for i in range(WORDS)]
    lone = sizes.where(F.col("size") <= NODE_ROWS).select("gkey")
    rest = classes.join(large.select("gkey"), "gkey", "left_anti")  # a hot group never meets the shuffled join
    whole = rest.join(lone, "gkey", "left_semi").select(
        F.col("gkey").alias("task"), F.lit(0).alias("pair"), F.lit(-1).alias("trie"), F.lit(0).alias("depth"), F.lit(0).alias("side"), "rep", *signs
    )
    depth = F.least(F.ceil(F.log2(F.col("size") / NODE_ROWS)).cast("int"), F.lit(MAX_DEPTH))
    cut = classes.join(large, "gkey").select("gkey", depth.alias("depth"), "rep", *signs)
    cut = cut.select("*", F.posexplode(F.array(*[_top(t) for t in range(TRIES)])).alias("trie", "block"))
    cut = cut.withColumn("node", F.expr(f"cast(shiftright(block, {BITS} - depth) as int)"))
    # subtrees that hold more than a slice (many alike records) are cut again by id
    nodes = cut.groupBy("gkey", "trie", "node").agg(F.count("*").alias("n"))
    slices = nodes.select("gkey", "trie", "node", F.ceil(F.col("n") / (2 * NODE_ROWS)).cast("int").alias("slices"))
    many = small_or_shuffled(slices.where("slices > 1"))
    own = cut.join(many, ["gkey", "trie", "node"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = own.withColumn("slice", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int"))
    masks = F.create_map(*[x for d in range(1, MAX_DEPTH + 1) for x in (F.lit(d), F.array(*[F.lit(m) for m in _masks(d)]))])
    own = own.select("*", F.explode(masks[F.col("depth")]).alias("mask")).withColumn("other", F.col("node").bitwiseXOR(F.col("mask")))
    theirs = small_or_shuffled(slices.where("slices > 1").select("gkey", "trie", F.col("node").alias("other"), F.col("slices").alias("o_slices")))
    own = own.join(theirs, ["gkey", "trie", "other"], "left").withColumn("o_slices", F.coalesce("o_slices", F.lit(1)))
    own = own.select("*", F.explode(F.sequence(F.lit(0), F.col("o_slices") - 1)).alias("o_slice"))
    mine, them = F.struct(F.col("node").alias("n"), F.col("slice").alias("s")), F.struct(F.col("other").alias("n"), F.col("o_slice").alias("s"))
    return whole.unionByName(
        own.select(
            "gkey",
            "trie",
            "depth",
            F.when(mine == them, 0).otherwise(1).alias("pair"),
            F.when(mine <= them, 0).otherwise(1).alias("side"),
            F.least(mine, them).alias("lo"),
            F.greatest(mine, them).alias("hi"),
            "rep",
            *signs,
        ).select(F.xxhash64("gkey", "trie", "lo", "hi").alias("task"), "pair", "trie", "depth", "side", "rep", *signs)
    )


def _top(trie: int) -> Column:
    """The trie's block as a long, cut from the signature's words."""
    at = trie * BITS
    word, offset = divmod(at, 64)
    fits = 64 - offset
    mask = F.lit((1 << BITS) - 1).cast("long")
    if fits >= BITS:
        return F.shiftrightunsigned(F.col(f"s{word}"), fits - BITS).bitwiseAND(mask)
    high = F.shiftleft(F.col(f"s{word}").bitwiseAND(F.lit((1 << fits) - 1).cast("long")), BITS - fits)
    return high.bitwiseOR(F.shiftrightunsigned(F.col(f"s{word + 1}"), 64 - (BITS - fits))).bitwiseAND(mask)


def _verifier(threshold: float):
    @F.arrow_udf(T.BooleanType())
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        cache: dict[str, frozenset] = {}

        def of(text):
            if text not in cache:
                cache[text] = features(text)
            return cache[text]

        return pa.array([jaccard(of(x), of(y)) > threshold for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())

    return alike


def _alike(records: DataFrame, record_id: str, group: list[Column], texts: list[Column], threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The classes (rep, n, ...), the members (id, rep, n) of those with copies, and the verified pairs (a, b) of representatives."""
    scratch = Scratch(records.sparkSession, "nearcopies")
    group_id = F.xxhash64(*[x for g in group for x in (g, g.isNull())])
    said = records.where(F.col(record_id).isNotNull()).select(F.col(record_id).alias("id"), group_id.alias("gkey"), bag(*texts).alias("bag")).where("bag <> ''")
    rows = said.select("id", "gkey", "bag", F.xxhash64("bag").alias("d1"), F.xxhash64(F.lit(1), "bag").alias("d2"), _signature("bag").alias("s"))
    rows = scratch.write(rows.select("id", "gkey", "bag", "d1", "d2", "s.*"), "rows")
    signs = [f"s{i}" for i in range(WORDS)]
    classes = rows.groupBy("gkey", "d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), *[F.min(s).alias(s) for s in signs])
    classes = scratch.write(classes, "classes")

    tasks = _tasks(classes)
    found = tasks.groupBy("task", "pair").applyInArrow(_task, "a long, b long").where("a <> b").distinct()
    found = scratch.write(found, "found")
    bags = rows.select("id", "gkey", "bag")
    left = bags.select(F.col("id").alias("a"), F.col("gkey").alias("ga"), F.col("bag").alias("ba"))
    right = bags.select(F.col("id").alias("b"), F.col("gkey").alias("gb"), F.col("bag").alias("bb"))
    same = found.join(left, "a").join(right, "b").where("ga = gb").where(_verifier(threshold)("ba", "bb")).select("a", "b")
    same = scratch.write(same.distinct(), "same")

    repeated = classes.where("n > 1").select("gkey", "d1", "d2", "rep", "n", F.col("n").alias("weight"))
    copies = attach(rows.select("id", "gkey", "d1", "d2"), ["gkey", "d1", "d2"], repeated, max(rows.count() // HOT_PARTS, 1000), "weight").select("id", "rep", "n")
    copies = scratch.write(copies, "copies")
    scratch.drop("rows", "found")
    return classes, copies, same


def near_classes(records: DataFrame, record_id: str, group: list[Column], texts: list[Column], threshold: float = 0.8) -> DataFrame:
    """(id, class_id, class_size, links): every record that says something with its class and the number of other classes like it.

    Nothing grows with the square of a class: the links between classes are the verified pairs
    of their representatives, and a class has one row per record.
    """
    classes, copies, same = _alike(records, record_id, group, texts, threshold)
    ends = F.explode(F.array("a", "b")).alias("rep")
    links = same.select(ends).groupBy("rep").agg(F.count("*").alias("links"))
    alone = classes.where("n = 1").select(F.col("rep").alias("id"), "rep", "n")
    members = alone.unionByName(copies.select("id", "rep", "n"))
    return members.join(links, "rep", "left").select("id", F.col("rep").alias("class_id"), F.col("n").alias("class_size"), F.coalesce("links", F.lit(0)).alias("links"))


def near_copies(records: DataFrame, record_id: str, group: list[Column], texts: list[Column], threshold: float = 0.8) -> DataFrame:
    """(a, b) with a < b: ids of records of one group that agree in more than ``threshold`` of what they say."""
    classes, copies, same = _alike(records, record_id, group, texts, threshold)
    scratch = Scratch(records.sparkSession, "nearcopies-pairs")
    listed = F.lit(True) if SHOWN is None else F.col("n") <= SHOWN
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    lists = copies.where(listed).groupBy("rep", F.pmod(F.xxhash64("id"), slices).cast("int").alias("slice")).agg(F.collect_list("id").alias("ids"))  # about SLICE ids each
    lists = scratch.write(lists, "lists")
    cut = small_or_shuffled(classes.where(listed & (F.col("n") > SLICE)).select("rep", slices.alias("slices")))
    inside = lists.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b")).where("a < b")
    later = lists.join(cut, "rep").where("slice + 1 < slices").select("rep", "ids", F.explode(F.expr("sequence(slice + 1, slices - 1)")).alias("slice"))
    across = later.join(lists.withColumnRenamed("ids", "_ids"), ["rep", "slice"]).select(F.explode("ids").alias("x"), "_ids").select("x", F.explode("_ids").alias("y"))
    crossed = same
    for c in ("a", "b"):
        crossed = crossed.join(cut.select(F.col("rep").alias(c), F.col("slices").alias(f"n_{c}")), c, "left")
        crossed = crossed.withColumn(f"s_{c}", F.explode(F.sequence(F.lit(0), F.coalesce(f"n_{c}", F.lit(1)) - 1)))
        crossed = crossed.join(lists.select(F.col("rep").alias(c), F.col("slice").alias(f"s_{c}"), F.col("ids").alias(f"_{c}")), [c, f"s_{c}"], "left")
    # a class without a list has one record to show, a slice without one has none
    shown = lambda c: F.coalesce(f"_{c}", F.when(F.col(f"n_{c}").isNull(), F.array(c)), F.array().cast("array<bigint>"))
    crossed = crossed.select(F.explode(shown("a")).alias("x"), shown("b").alias("ys")).select("x", F.explode("ys").alias("y"))
    pairs = inside.unionByName(across.unionByName(crossed).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    if SHOWN is None:
        return pairs
    return pairs.unionByName(copies.where((F.col("n") > SHOWN) & (F.col("id") > F.col("rep"))).select(F.col("rep").alias("a"), F.col("id").alias("b")))


def _of_candidates(candidates: DataFrame) -> tuple:
    keyed = candidates.where(F.col("partition").isNotNull() & F.col("kind.tag").isNotNull())
    names = F.array_join(F.coalesce("subject_names", F.array().cast("array<string>")), " ")
    return keyed, "cand_id", [F.col("partition"), F.col("kind.tag"), F.col("kind.value")], [F.col("title"), names, F.col("location")]


def candidate_copies(candidates: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(cand_id_a, cand_id_b) of candidates of equal partition and kind."""
    return near_copies(*_of_candidates(candidates), threshold).select(F.col("a").alias("cand_id_a"), F.col("b").alias("cand_id_b"))


def candidate_classes(candidates: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(cand_id, class_id, class_size, links) of candidates of equal partition and kind."""
    return near_classes(*_of_candidates(candidates), threshold).withColumnRenamed("id", "cand_id")
