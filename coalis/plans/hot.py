"""Problem 4: per-key results where a handful of keys hold most rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coalis.operators.blocks import block_keys
from coalis.operators.selection import heavy_keys, key_quantiles
from coalis.sources.tables import table

#: Part of all candidate rows from which a key is hot.
HOT_SHARE = 0.02
PROBS = {"delay_p50": 0.5, "delay_p90": 0.9, "delay_p99": 0.99}


def _delays(candidates: DataFrame) -> DataFrame:
    """Block keys with the microseconds from sighting to delivery."""
    micros = F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("seen_at").cast("timestamp"))
    return block_keys(candidates.withColumn("delay", micros), "delay")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "candidates")
    least = max(math.ceil(HOT_SHARE * candidates.count()), 1)
    return heavy_keys(block_keys(candidates), ["block_kind", "block_key"], least).select("block_kind", "block_key")


def p4_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_quantiles(_delays(table(spark, sf_dir, "candidates")), ["block_kind", "block_key"], "delay", PROBS)


_NAME = "replace(regexp_replace(regexp_replace(x, '[?#].*$', ''), '@[^/]*$', ''), '/@', '/%40')"
SUBJECT_COORDINATE = f"""case
  when x like 'cpe:2.3:%' then lower(array_to_string(string_split(x, ':')[1:5], ':')) || ':*:*:*:*:*:*:*:*'
  when x like 'cpe:/%' then 'cpe:2.3:' || lower(array_to_string(string_split(substr(x, 6), ':')[1:3], ':')) || ':*:*:*:*:*:*:*:*'
  when lower(x) like 'pkg:pypi/%' then replace(lower({_NAME}), '_', '-')
  when regexp_matches(lower(x), '^pkg:(npm|github|deb)/') then lower({_NAME})
  else lower(regexp_extract(x, '^pkg:[^/]*')) || regexp_replace({_NAME}, '^pkg:[^/]*', '') end"""
ISSUE = """case when regexp_matches(upper(trim(i, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '^(CVE|CWE|GHSA|RUSTSEC)-')
  then upper(trim(i, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) else trim(i, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) end"""
_KEYS = f"""
k as (
  select distinct cand_id, 'issue' as block_kind, {ISSUE} as block_key, seen_at, received_at from (select cand_id, unnest(issue_ids) as i, seen_at, received_at from candidates) where i is not null
  union all
  select distinct cand_id, 'subject', {SUBJECT_COORDINATE}, seen_at, received_at from (select cand_id, unnest(subject_ids) as x, seen_at, received_at from candidates) where x is not null),
d as (select *, epoch_us(received_at) - epoch_us(seen_at) as delay from k where block_key <> '')"""

SQL = {
    "p4_found": f"with {_KEYS} select block_kind, block_key from d group by all having count(*) >= {HOT_SHARE} * (select count(*) from candidates)",
    "p4_quantiles": f"""with {_KEYS},
s as (select *, row_number() over (partition by block_kind, block_key, delay is null order by delay) as rn, count(delay) over (partition by block_kind, block_key) as m from d)
select block_kind, block_key, count(*) as n, max(m) as n_values,
{", ".join(f"max(case when delay is not null and rn = greatest(ceil({p} * m), 1) then delay end) as {n}" for n, p in PROBS.items())}
from s group by all""",
}
QUERIES = {"p4_found": p4_found, "p4_quantiles": p4_quantiles}
