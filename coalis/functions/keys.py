"""Versioned occurrence and correlation keys.

An occurrence's canonical message is built by Catalyst and only its digest runs in Python; the
cross product of issues and subjects is built next to its digests, in the same Arrow batch.
Every part is its length as eight big-endian bytes and its UTF-8 bytes; a present field is
tag, 0x01, value; an absent one tag, 0x00.

The two derivation contexts belong to the format of stored keys and are a setting: the JSON file
the environment variable ``COALIS_KEY_CONTEXTS`` names, by default ``key_contexts.json`` beside the
package, with ``occurrence`` and ``correlation``.  Without a file neutral contexts hold, which
give sound keys that differ from stored ones.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blake3 import derive_keys

# Key prefixes (part of the key format).
OCCURRENCE_PREFIX = "occ:v1:"
CORRELATION_PREFIX = "corr:v1:"

NEUTRAL = {"occurrence": "occurrence/v1", "correlation": "correlation/v1"}


@lru_cache(1)
def contexts() -> dict[str, str]:
    """The derivation contexts of occurrence and correlation keys."""
    named = os.environ.get("COALIS_KEY_CONTEXTS")
    path = Path(named) if named else Path(__file__).resolve().parents[2] / "key_contexts.json"
    if named is None and not path.is_file():
        return NEUTRAL
    return NEUTRAL | json.loads(path.read_text())


def _part(value: Column) -> Column:
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(value)), 16, "0")), F.encode(value, "UTF-8"))


def _field(tag: str, value: Column) -> Column:
    return F.when(value.isNull(), F.concat(_part(F.lit(tag)), F.unhex(F.lit("00")))).otherwise(F.concat(_part(F.lit(tag)), F.unhex(F.lit("01")), _part(value)))


def _kind(kind: Column) -> Column:
    return F.concat(_field("kind", kind["tag"]), _field("kind_value", F.when(kind["tag"] == "other", kind["value"])))


def occurrence_message(partition: Column, kind: Column, source: Column, subtype: Column, native_id: Column) -> Column:
    return F.concat(_field("partition", partition), _kind(kind), _field("source", source), _field("subtype", subtype), _field("native_id", native_id))


@lru_cache(8)
def _digest(context: str, prefix: str):
    """The Arrow function message -> key of one context."""

    @F.arrow_udf(T.StringType())
    def digest(messages: pa.Array) -> pa.Array:
        values = messages.to_pylist()
        found = iter(derive_keys(context, [v for v in values if v is not None]))
        return pa.array([None if v is None else prefix + next(found).hex() for v in values], pa.string())

    return digest


def _bytes(tag: str, value: str | None) -> bytes:
    part = lambda x: len(x).to_bytes(8, "big") + x
    return part(tag.encode()) + (b"\0" if value is None else b"\1" + part(value.encode()))


@lru_cache(8)
def _correlations(context: str):
    """The Arrow function that builds the cross product of issues and subjects next to its digests."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def correlations(partition: pa.Array, tag: pa.Array, value: pa.Array, issues: pa.Array, identities: pa.Array, alone: pa.Array) -> pa.Array:
        messages, sizes = [], []
        for p, t, v, some, subjects, single in zip(*(c.to_pylist() for c in (partition, tag, value, issues, identities, alone)), strict=True):
            head = _bytes("partition", p) + _bytes("kind", t) + _bytes("kind_value", v if t == "other" else None) if p is not None else b""
            known = subjects or ([None] if single else [])
            made = [head + _bytes("issue", i) + _bytes("subject", s) for i in some or () for s in known] if p is not None else []
            messages += made
            sizes.append(len(made))
        found = iter(derive_keys(context, messages))
        return pa.array([sorted({CORRELATION_PREFIX + next(found).hex() for _ in range(n)}) for n in sizes], pa.list_(pa.string()))

    # See subjects.py: keeps the projections around the functions apart.
    return correlations.asNondeterministic()


def occurrence_key(partition: Column, kind: Column, source: Column, subtype: Column, native_id: Column) -> Column:
    """``occ:v1:`` and 64 hex digits; null if a required part is null."""
    return _digest(contexts()["occurrence"], OCCURRENCE_PREFIX)(occurrence_message(partition, kind, source, subtype, native_id))


def correlation_keys(partition: Column, kind: Column, issues: Column, identities: Column, issue_only: bool = False) -> Column:
    """Sorted distinct keys of issues x subjects; of the issues alone if allowed and there is no subject."""
    return _correlations(contexts()["correlation"])(partition, kind["tag"], kind["value"], issues, identities, F.lit(issue_only))


def valid_key(key: Column, prefix: str = OCCURRENCE_PREFIX) -> Column:
    return key.rlike(f"^{prefix}[0-9a-fA-F]{{64}}$")


def parse_key(key: Column, prefix: str = OCCURRENCE_PREFIX) -> Column:
    """struct<key, error>: the lower-case key, or ``Prefix`` / ``Digest``."""
    error = F.when(~F.startswith(key, F.lit(prefix)), "Prefix").when(~valid_key(key, prefix), "Digest")
    return F.struct(F.when(error.isNull(), F.lower(key)).alias("key"), error.alias("error"))


def key_bytes(key: Column) -> Column:
    """The 32 raw bytes of a rendered key."""
    return F.unhex(F.substring_index(key, ":", -1))
