"""Token counts of a public byte-level BPE vocabulary, in Arrow batches.

The vocabulary file is a parameter; it is read once per Python worker and never copied.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = os.environ.get("COALIS_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the vocabulary's published pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text; null for null, 0 for the empty text."""

    @F.arrow_udf(T.IntegerType())
    def count(texts: pa.Array) -> pa.Array:
        encode = encoder(vocabulary).encode_ordinary
        return pa.array([None if t is None else len(encode(t)) for t in texts.to_pylist()], pa.int32())

    return count(text)
