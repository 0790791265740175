"""Structured subjects (PURL or CPE) as Arrow functions over whole array columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cpe import is_cpe, parse_cpe
from .purl import CANONICAL, IdentityError, parse_purl

# Prefixes of a subject's full identity inside a correlation key.
PURL_IDENTITY = "subject:purl:v1:"
CPE_IDENTITY = "subject:cpe:v1:"

PAIR = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
SUBJECT = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("canonical", T.StringType()),
        T.StructField("full_identity", T.StringType()),
        T.StructField("coordinate", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("qualifiers", T.ArrayType(PAIR)),
        T.StructField("subpath", T.StringType()),
        T.StructField("cpe_tokens", T.ArrayType(T.StringType())),
        T.StructField("type", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("error_detail", T.StringType()),
        T.StructField("error_position", T.IntegerType()),
        T.StructField("error_component", T.IntegerType()),
    ]
)
NAMES = T.StructType([T.StructField("canonical", T.StringType()), T.StructField("coordinate", T.StringType())])



def parse_subject(value: str) -> dict:
    """One subject by its prefix (case-sensitive), as a row of :data:`SUBJECT`; errors are data, not exceptions."""
    row = dict.fromkeys(SUBJECT.fieldNames())
    try:
        if value.startswith("pkg:"):
            p = parse_purl(value)
            row |= {k: p[k] for k in ("canonical", "coordinate", "name", "version", "subpath", "type", "namespace")}
            row |= {"kind": "purl", "full_identity": PURL_IDENTITY + p["canonical"], "qualifiers": [{"k": k, "v": v} for k, v in p["qualifiers"]]}
        elif is_cpe(value):
            p = parse_cpe(value)
            row |= {k: p[k] for k in ("canonical", "coordinate", "name", "version")}
            row |= {"kind": "cpe", "full_identity": CPE_IDENTITY + p["canonical"], "cpe_tokens": p["tokens"]}
        else:
            raise IdentityError("UnsupportedSubjectId")
    except IdentityError as e:
        row |= {"error_code": e.code, "error_detail": e.detail, "error_position": e.position, "error_component": e.component}
    return row


def names_of(value: str | None) -> tuple[str, str] | None:
    """(canonical, coordinate), or None for null and invalid subjects."""
    try:
        p = parse_purl(value) if value.startswith("pkg:") else parse_cpe(value)
    except (IdentityError, AttributeError):
        return None
    return p["canonical"], p["coordinate"]


def _per_distinct(values: pa.Array, function, kind: pa.DataType) -> pa.Array:
    coded = values.dictionary_encode()
    parsed = pa.array([None if v is None else function(v) for v in coded.dictionary.to_pylist()], kind)
    return parsed.take(coded.indices)


_NAMES_ARROW = pa.struct([("canonical", pa.string()), ("coordinate", pa.string())])


def _names_row(value: str):
    found = names_of(value)
    return None if found is None else {"canonical": found[0], "coordinate": found[1]}


@F.arrow_udf(T.ArrayType(NAMES))
def _names_udf(lists: pa.Array) -> pa.Array:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = _per_distinct(lists.flatten(), _names_row, _NAMES_ARROW)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = [0, *lengths.cumsum().tolist()]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def subject_names(column: Column) -> Column:
    """array<string> of raw subjects -> array<struct<canonical, coordinate>> of the valid ones, distinct.

    A null array gives an empty one; null and invalid members are left out.
    """
    return F.array_distinct(F.filter(_names_udf(column), lambda s: s.isNotNull()))


_FULL_ARROW = pa.struct(
    [
        (f.name, pa.int32())
        if isinstance(f.dataType, T.IntegerType)
        else (f.name, pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())])))
        if f.name == "qualifiers"
        else (f.name, pa.list_(pa.string()))
        if f.name == "cpe_tokens"
        else (f.name, pa.string())
        for f in SUBJECT.fields
    ]
)


@F.arrow_udf(T.ArrayType(SUBJECT))
def _subjects_udf(lists: pa.Array) -> pa.Array:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = _per_distinct(lists.flatten(), parse_subject, _FULL_ARROW)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = [0, *lengths.cumsum().tolist()]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def parse_subjects(column: Column) -> Column:
    """array<string> -> array<SUBJECT>, one entry per raw subject, errors included."""
    return _subjects_udf(column)


def is_canonical(value: Column) -> Column:
    """Whether ``value`` is a PURL that :func:`canonical_subject` takes apart without Python."""
    return F.coalesce(value.rlike(CANONICAL), F.lit(False))


def canonical_subject(x: Column) -> Column:
    """:func:`parse_subject` of a PURL that :func:`is_canonical`."""
    coordinate = F.substring_index(x, "@", 1)
    name, kind = F.substring_index(coordinate, "/", -1), F.substring(F.substring_index(x, "/", 1), 5, 1 << 30)
    middle = F.length(coordinate) - F.length(name) - F.length(kind) - 6
    fields = {
        "kind": F.lit("purl"),
        "canonical": x,
        "full_identity": F.concat(F.lit(PURL_IDENTITY), x),
        "coordinate": coordinate,
        "name": name,
        "version": F.when(F.contains(x, F.lit("@")), F.substring_index(x, "@", -1)),
        "qualifiers": F.array(),
        "type": kind,
        "namespace": F.when(middle > 0, F.substring(coordinate, F.length(kind) + 6, middle)),
    }
    return F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SUBJECT.fields])


# A projection over a Python function's result must not be merged into one that feeds another.
_subjects_udf = _subjects_udf.asNondeterministic()
