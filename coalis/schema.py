"""Fixed schemas and orders."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations in their defined order.
KINDS = ("vulnerability", "misconfiguration", "secret", "code", "other")
DECISIONS = ("duplicate", "review", "distinct", "not_comparable")
METHODS = ("same_occurrence", "exact_correlation", "fuzzy", "blocked")
SIGNAL_FIELDS = ("partition", "kind", "source", "issue", "subject", "version", "subject_name", "title", "location")
SIGNAL_KINDS = ("exact", "similar", "different", "missing", "incomparable", "same_source")
MAX_SCORE = 10_000

_STRINGS = T.ArrayType(T.StringType())
KIND = T.StructType([T.StructField("tag", T.StringType()), T.StructField("value", T.StringType())])
ORIGIN = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "subtype", "native_id")])
RAW = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("subtype", T.StringType()),
        T.StructField("native_id", T.StringType()),
        T.StructField("partition", T.StringType()),
        T.StructField("kind", KIND),
        T.StructField("issues", _STRINGS),
        T.StructField("purls", _STRINGS),
        T.StructField("cpes", _STRINGS),
        T.StructField("subject_names", _STRINGS),
        T.StructField("title", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("affected_version", T.StringType()),
    ]
)
SIGNAL = T.StructType([T.StructField("field", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("score", T.IntegerType())])
COMPARISON = T.StructType(
    [
        T.StructField("left", T.StringType()),
        T.StructField("right", T.StringType()),
        T.StructField("decision", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("method", T.StringType()),
        T.StructField("signals", T.ArrayType(SIGNAL)),
    ]
)
