"""Packing texts into fixed containers along a space-filling curve.

1. A text's token ids are hashed into a vector, projected to four dimensions and quantised;
   its position on the Hilbert curve through that space is its key.  Texts with like words
   lie near each other on the curve.
2. The texts are range-sorted by (key, id).  The id splits keys that many texts share.
3. Each range packs its texts in curve order: ``LOOK_AHEAD`` neighbours at a time, the
   largest first, each into the open container it fills best.  Containers stay open over
   the following neighbours until they are full or ``OPEN`` newer ones are open.

A text longer than the capacity is cut into pieces of exactly the capacity and a rest;
nothing else is cut.  A task holds only the open containers' free room and one window.

Defined cases: null texts are in no container; empty texts take no room and lie in the
container that is open; repeated texts each get their place; null kinds and capacities that are
null or not positive are ignored, of several capacities of a kind the largest holds; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coalis.sources.scratch import Scratch

from .tokens import VOCABULARY, encoder

BUCKETS, DIMENSIONS, DEPTH = 4096, 4, 8
LOOK_AHEAD, OPEN = 4096, 512
#: Container kinds are a fixed small table.
MAX_KINDS = 1000


@lru_cache(1)
def _projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMENSIONS))


def project(ids: np.ndarray) -> np.ndarray:
    """A token list's place in the unit cube: hashed presence vector, random projection, logistic squeeze."""
    hashed = np.unique((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12))
    return 1 / (1 + np.exp(-1.702 * _projection()[hashed.astype(np.int64)].sum(0) / max(len(hashed), 1) ** 0.5))


def hilbert(points: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions of integer points (rows, dimensions) on the Hilbert curve (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (depth - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (depth - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(depth - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


_SIZED = T.StructType([T.StructField("n_tokens", T.IntegerType()), T.StructField("curve", T.LongType())])


def size_and_place(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """struct<n_tokens, curve> of a whole text."""

    @F.arrow_udf(_SIZED)
    def place(texts: pa.Array) -> pa.Array:
        encode = encoder(vocabulary).encode_ordinary
        sizes, points = [], np.zeros((len(texts), DIMENSIONS))
        for i, text in enumerate(texts.to_pylist()):
            ids = encode(text or "")
            sizes.append(None if text is None else len(ids))
            points[i] = project(np.array(ids, np.int64))
        keys = hilbert((points * (1 << DEPTH)).astype(np.int64).clip(0, (1 << DEPTH) - 1)) if len(texts) else np.empty(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(keys, pa.int64())], ["n_tokens", "curve"])

    return place(text)


class Packer:
    """Best-fit packing of a stream of sizes into containers of one capacity."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.rooms: dict[int, list[int]] = {}
        self.mask = 0
        self.count = 0

    def _open(self, room: int, container: int) -> None:
        if room:
            self.rooms.setdefault(room, []).append(container)
            self.mask |= 1 << room
            self.count += 1
            if self.count > OPEN:  # the fullest one is closed
                self._take((self.mask & -self.mask).bit_length() - 1)

    def _take(self, room: int) -> int:
        stack = self.rooms[room]
        container = stack.pop()
        if not stack:
            del self.rooms[room]
            self.mask ^= 1 << room
        self.count -= 1
        return container

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, size: int) -> int:
        """The container of an item of at most the capacity."""
        fitting = self.mask >> max(size, 1)
        if fitting:
            room = max(size, 1) + (fitting & -fitting).bit_length() - 1
            container = self._take(room)
            self._open(room - size, container)
        else:
            container = self._new()
            self._open(self.capacity - size, container)
        return container

    def window(self, sizes: np.ndarray):
        """(item, piece_no, size, container) of one window of neighbours, the largest first."""
        for i in np.argsort(-sizes, kind="stable").tolist():
            left, piece = int(sizes[i]), 0
            while left > self.capacity:
                yield i, piece, self.capacity, self._new()
                left, piece = left - self.capacity, piece + 1
            yield i, piece, left, self.place(left)


_PACKED = "container_kind string, container_id long, doc_id long, piece_no int, n_tokens int"
_SCHEMA = pa.schema([("container_kind", pa.string()), ("container_id", pa.int64()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("n_tokens", pa.int32())])


def _pack_range(kinds: list[tuple[str, int]]):
    """A mapInArrow function that packs one range of the curve into containers of every kind."""

    def run(batches):
        first = TaskContext.get().partitionId() << 40
        packers = [(kind, Packer(capacity, first)) for kind, capacity in kinds]
        ids, sizes, held = [], [], 0

        def flush():
            doc, size = np.concatenate(ids), np.concatenate(sizes)
            for kind, packer in packers:
                rows = list(packer.window(size))
                item, piece, n, container = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                yield pa.record_batch(
                    [pa.array([kind] * len(item), pa.string()), pa.array(container), pa.array(doc[item]), pa.array(piece, pa.int32()), pa.array(n, pa.int32())], schema=_SCHEMA
                )

        for batch in batches:
            for at in range(0, len(batch), LOOK_AHEAD):
                part = batch.slice(at, LOOK_AHEAD)
                ids.append(part["doc_id"].to_numpy(zero_copy_only=False))
                sizes.append(part["n_tokens"].to_numpy(zero_copy_only=False))
                held += len(part)
                if held >= LOOK_AHEAD:
                    yield from flush()
                    ids, sizes, held = [], [], 0
        if held:
            yield from flush()

    return run


def capacities(kinds: DataFrame) -> DataFrame:
    """(container_kind, capacity): the largest positive capacity of each kind; more than ``MAX_KINDS`` kinds are an error."""
    listed = kinds.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity"))
    if listed.limit(MAX_KINDS + 1).count() > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} container kinds")
    return listed


def packed(documents: DataFrame, kinds: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_kind, container_id, doc_id, piece_no, n_tokens) for each kind of container."""
    listed = capacities(kinds).sort("container_kind").collect()  # proven small
    scratch = Scratch(documents.sparkSession, "packing")
    sized = documents.where(F.col("text").isNotNull()).select("doc_id", size_and_place(F.col("text"), vocabulary).alias("s")).select("doc_id", "s.n_tokens", "s.curve")
    sized = scratch.write(sized, "sized")
    ordered = sized.repartitionByRange("curve", "doc_id", "n_tokens").sortWithinPartitions("curve", "doc_id", "n_tokens")
    return ordered.select("doc_id", "n_tokens").mapInArrow(_pack_range([(r[0], r[1]) for r in listed]), _PACKED)


def fill(packing: DataFrame, kinds: DataFrame) -> DataFrame:
    """(container_kind, containers, tokens, room, fill_share): how full the containers are."""
    used = packing.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"))
    room = F.col("containers") * F.col("capacity")
    return used.join(F.broadcast(capacities(kinds)), "container_kind").select("container_kind", "containers", "tokens", room.alias("room"), (F.col("tokens") / room).alias("fill_share"))


def locality(packing: DataFrame, places: DataFrame) -> DataFrame:
    """(container_kind, spread, spread_of_all, ratio): how near on the curve the texts of a container are.

    ``places`` has doc_id and curve.  The spread is the variance of the curve position inside
    containers of two or more texts; random containers would have the variance over all texts.
    """
    at = F.col("curve").cast("double")
    placed = packing.select("container_kind", "container_id", "doc_id").distinct().join(places.select("doc_id", at.alias("at")), "doc_id")
    inside = placed.groupBy("container_kind", "container_id").agg(F.count("*").alias("n"), F.var_samp("at").alias("v")).where("n > 1")
    inside = inside.groupBy("container_kind").agg((F.sum(F.col("v") * (F.col("n") - 1)) / F.sum(F.col("n") - 1)).alias("spread"))
    every = placed.groupBy("container_kind").agg(F.var_samp("at").alias("spread_of_all"))
    return inside.join(every, "container_kind").select("container_kind", "spread", "spread_of_all", (F.col("spread") / F.col("spread_of_all")).alias("ratio"))


def curve_places(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, curve) of every text."""
    return documents.where(F.col("text").isNotNull()).select("doc_id", size_and_place(F.col("text"), vocabulary)["curve"].alias("curve"))
