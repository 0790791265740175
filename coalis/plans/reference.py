"""One query per operator family of the correlation engine, over whole tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coalis.config import Config
from coalis.functions import keys as K
from coalis.functions.similarity import normal_text, with_similarity
from coalis.functions.subjects import parse_subjects
from coalis.functions.text import normalize_issue, trim_unicode
from coalis.operators import blocking as B
from coalis.operators import candidates as C
from coalis.operators import cluster as M
from coalis.operators.blockwise import compare_all
from coalis.operators.compare import compare, details_compatible, join_pairs
from coalis.sources import wire
from coalis.sources.tables import table

from . import fixtures as X
from .hot import ISSUE, SUBJECT_COORDINATE

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


NORMAL = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'))"


def lcs_sql(a: str, b: str) -> str:
    """Indel similarity in basis points of two normalised SQL texts."""
    full = f"((1::hugeint << len({a})) - 1)"
    mask = f"list_sum(list_transform(range(len({a})), lambda i: case when substr({a}, (i + 1)::int, 1) = ch then (1::hugeint << i::int) else 0::hugeint end))::hugeint"
    masks = f"list_transform(string_split({b}, ''), lambda ch: {mask})"
    last = f"list_reduce(list_prepend({full}, {masks}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full})"
    lcs = f"(len({a}) - bit_count({last}))"
    m = f"(len({a}) + len({b}))"
    return f"(case when {a} = '' or {b} = '' then 0 else floor((1.0::double - ({m} - 2 * {lcs})::double / {m}) * 10000 + 0.5)::int end)"


# ---------------------------------------------------------------- text and identifiers


@query(f"select doc_id, {NORMAL.format('text')} as normal from documents where text is not null")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", normal_text(F.col("text")).alias("normal"))


@query(
    f"""with n as (select p_partkey as k, {NORMAL.format("p_name || ' ' || p_type")} as t from part)
select a.k, {lcs_sql('a.t', 'b.t')} as score from n a join n b on b.k = a.k + 1"""
)
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring parts' texts."""
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), normal_text(F.concat_ws(" ", "p_name", "p_type")).alias("t"))
    b = n.select((F.col("k") - 1).alias("k"), F.col("t").alias("u"))
    return with_similarity(n.join(b, "k"), "t", "u", "score").select("k", "score")


@query(f"select cand_id, issue from (select cand_id, {ISSUE} as issue from (select cand_id, unnest(issue_ids) as i from candidates) where i is not null) where issue <> ''")
def issue_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "candidates").select("cand_id", F.explode("issue_ids").alias("i"))
    return each.select("cand_id", normalize_issue(F.col("i")).alias("issue")).where("issue is not null")


@query(
    f"""with s as (select cand_id, unnest(subject_ids) as x from candidates), p as (select cand_id, x, {SUBJECT_COORDINATE} as coordinate from s where lower(x) like 'pkg:%')
select cand_id, coordinate, regexp_extract(coordinate, '^pkg:([^/]*)/', 1) as type,
nullif(replace(regexp_extract(coordinate, '^pkg:[^/]*/(.*)/[^/]*$', 1), '%40', '@'), '') as namespace,
regexp_extract(coordinate, '([^/]*)$', 1) as name,
nullif(regexp_extract(regexp_replace(x, '[?#].*$', ''), '@([^/@]*)$', 1), '') as version from p"""
)
def purl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "candidates").select("cand_id", F.explode(parse_subjects(F.col("subject_ids"))).alias("s"))
    return s.where("s.kind = 'purl'").select("cand_id", "s.coordinate", "s.type", "s.namespace", "s.name", "s.version")


_BAD_PURLS = (
    ("pkg:generic/la%4gmp@", "InvalidPercentEscape", 14),
    ("pkg:generic/lamp@?v=", "EmptyPurlVersion", None),
    ("pkg:generic/lamp?abi=&k=", "EmptyPurlQualifierValue", None),
    ("pkg:generic/lamp?abi&k=", "InvalidPurlQualifier", None),
    ("pkg:generic/lamp?ABI=1&abi=", "DuplicatePurlQualifier", None),
    ("pkg:generic/lamp#a?b=", "InvalidPurl", None),
    ("urn:generic/lamp@", "UnsupportedSubjectId", None),
)


@query(
    "with t(n, code, position) as (values "
    + ", ".join(f"({i}, '{code}', {'null' if at is None else at})" for i, (_, code, at) in enumerate(_BAD_PURLS))
    + f") select p_partkey, code, position::int as position from part join t on n = p_partkey % {len(_BAD_PURLS)}"
)
def purl_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(*[F.lit(head) for head, _, _ in _BAD_PURLS])
    raw = F.concat(F.get(heads, (F.col("p_partkey") % len(_BAD_PURLS)).cast("int")), F.col("p_partkey"))
    s = table(spark, sf_dir, "part").select("p_partkey", F.get(parse_subjects(F.array(raw)), F.lit(0)).alias("s"))
    return s.select("p_partkey", F.col("s.error_code").alias("code"), F.col("s.error_position").alias("position"))


_CPE = "'cpe:2.3:a:' || lower(replace(p_brand, '#', '\\#')) || ':' || replace(p_name, ' ', '_') || ':' || p_size || ':*:*:*:*:*:*:*'"


@query(f"select p_partkey, {_CPE} as canonical, replace(p_name, ' ', '_') as product, p_size::varchar as version, 'cpe:2.3:a:' || lower(replace(p_brand, '#', '\\#')) || ':' || replace(p_name, ' ', '_') || ':*:*:*:*:*:*:*:*' as coordinate from part")
def cpe_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted names with an escaped character and upper case."""
    raw = F.concat(F.lit("cpe:2.3:a:"), F.replace("p_brand", F.lit("#"), F.lit("\\#")), F.lit(":"), F.translate("p_name", " ", "_"), F.lit(":"), F.col("p_size"), F.lit(":*:*:*:*:*:*:*"))
    s = table(spark, sf_dir, "part").select("p_partkey", F.get(parse_subjects(F.array(raw)), F.lit(0)).alias("s"))
    return s.select("p_partkey", "s.canonical", F.col("s.name").alias("product"), "s.version", "s.coordinate")


@query(f"select p_partkey, {_CPE} as canonical from part")
def cpe_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same names in the legacy binding come out equal."""
    raw = F.concat(F.lit("cpe:/a:"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("%23"))), F.lit(":"), F.translate("p_name", " ", "_"), F.lit(":"), F.col("p_size"))
    s = table(spark, sf_dir, "part").select("p_partkey", F.get(parse_subjects(F.array(raw)), F.lit(0)).alias("s"))
    return s.select("p_partkey", "s.canonical")


_BAD_CPES = (
    ("cpe:2.3:q:mill:lamp:{}:*:*:*:*:*:*:*", "InvalidCpePart", None),
    ("cpe:2.3:a:mill:lamp:4*{}:*:*:*:*:*:*:*", "InvalidCpeValue", 3),
    ("cpe:2.3:a:mill:lamp:{}:*:*:german:*:*:*:*", "InvalidCpeValue", 6),
    ("cpe:2.3:a:mill:lamp:{}", "CpeComponentCount", None),
    ("cpe:2.3:a:mi#ll:lamp:{}:*:*:*:*:*:*:*", "InvalidCpeValue", 1),
    ("cpe:/a:mill:lamp:{}:u2:e3:de:more", "LegacyCpeComponentCount", None),
    ("cpe:2.3:a:mill:lamp:{}:*:*:de-at:*:*:*:*", None, None),
    ("cpe:2.3:h:mill:lamp:{}??:*:*:*:*:*:*:*", None, None),
)


@query(
    "with t(n, code, component) as (values "
    + ", ".join(f"({i}, {'null' if code is None else repr(code)}, {'null' if at is None else at})" for i, (_, code, at) in enumerate(_BAD_CPES))
    + f") select p_partkey, code, component::int as component from part join t on n = p_partkey % {len(_BAD_CPES)}"
)
def cpe_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, wildcards, escapes, languages and component counts that are wrong, and two that are right."""
    raw = F.replace(F.get(F.array(*[F.lit(c) for c, _, _ in _BAD_CPES]), (F.col("p_partkey") % len(_BAD_CPES)).cast("int")), F.lit("{}"), F.col("p_partkey").cast("string"))
    s = table(spark, sf_dir, "part").select("p_partkey", F.get(parse_subjects(F.array(raw)), F.lit(0)).alias("s"))
    return s.select("p_partkey", F.col("s.error_code").alias("code"), F.col("s.error_component").alias("component"))


_CPE_DETAILS = (
    ("4:*:*:*:*:*:*:*", "4:*:*:*:*:*:*:*", True), ("4:*:*:*:*:*:*:*", "5:*:*:*:*:*:*:*", False), ("*:*:*:*:*:*:*:*", "5:*:*:*:*:*:*:*", True),
    ("4:u1:*:*:*:*:*:*", "4:u2:*:*:*:*:*:*", False), ("4:u1:*:*:*:*:*:*", "4:*:*:de:*:*:*:*", True), ("4:*:*:*:*:*:x:*", "4:*:*:*:*:*:y:*", False), ("4:-:*:*:*:*:*:*", "4:u1:*:*:*:*:*:*", False),
)


@query("with t(n, compatible) as (values " + ", ".join(f"({i}, {str(c).lower()})" for i, (_, _, c) in enumerate(_CPE_DETAILS)) + f") select p_partkey, compatible from part join t on n = p_partkey % {len(_CPE_DETAILS)}")
def cpe_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two CPE names of one product can be one: any concrete component that differs speaks against it."""
    which = (F.col("p_partkey") % len(_CPE_DETAILS)).cast("int")
    name = F.concat(F.lit("cpe:2.3:a:mill:lamp"), F.col("p_partkey"), F.lit(":"))
    pair = F.array(*[F.concat(name, F.get(F.array(*[F.lit(d[i]) for d in _CPE_DETAILS]), which)) for i in (0, 1)])
    s = table(spark, sf_dir, "part").select("p_partkey", parse_subjects(pair).alias("s"))
    return s.select("p_partkey", details_compatible(F.get("s", F.lit(0)), F.get("s", F.lit(1))).alias("compatible"))


_DETAILS = (
    ("@1", "@1", True), ("@1", "@2", False), ("", "@2", True), ("@1?arch=x", "@1?arch=y", False), ("@1?arch=x", "@1?os=y", True),
    ("?arch=x", "", True), ("#a", "#b", False), ("#a", "", True), ("-other@1", "@1", False),
)


@query("with t(n, compatible) as (values " + ", ".join(f"({i}, {str(c).lower()})" for i, (_, _, c) in enumerate(_DETAILS)) + f") select p_partkey, compatible from part join t on n = p_partkey % {len(_DETAILS)}")
def subject_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two subjects can be one: equal coordinate and no detail of one contradicts the other."""
    which = (F.col("p_partkey") % len(_DETAILS)).cast("int")
    name = F.concat(F.lit("pkg:generic/widget-"), F.col("p_partkey"))
    pair = F.array(*[F.concat(name, F.get(F.array(*[F.lit(d[i]) for d in _DETAILS]), which)) for i in (0, 1)])
    s = table(spark, sf_dir, "part").select("p_partkey", parse_subjects(pair).alias("s"))
    return s.select("p_partkey", details_compatible(F.get("s", F.lit(0)), F.get("s", F.lit(1))).alias("compatible"))


# ---------------------------------------------------------------- rows and keys

_CONTROL = "regexp_matches({}, '[\\x{{00}}-\\x{{1F}}\\x{{7F}}-\\x{{9F}}]')"
_BLANK = "regexp_replace({}, '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]', '', 'g') = ''"


@query(
    f"""select doc_id, case when source is null or {_BLANK.format('source')} then 'EmptyField' when lang is null or {_BLANK.format('lang')} then 'EmptyField'
when {_BLANK.format('text')} then 'EmptyField' when {_CONTROL.format('text')} then 'ControlCharacter' when text is null then 'NoEvidence' end as code,
case when source is null or {_BLANK.format('source')} then 'source' when lang is null or {_BLANK.format('lang')} then 'partition'
when {_BLANK.format('text')} then 'title' when {_CONTROL.format('text')} then 'title' end as field from documents"""
)
def candidate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a finding with its whole text as title, and its first error."""
    d = table(spark, sf_dir, "documents")
    raw = C.with_columns(d, {"native_id": F.col("doc_id").cast("string"), "partition": F.col("lang"), "title": F.col("text")})
    raw = raw.withColumn("doc_id", F.col("native_id").cast("long"))
    return C.build(raw, ["doc_id"]).select("doc_id", "error.code", "error.field")


@query("select source, count(*) as n_rejected from documents where source is null or lang is null or text is null group by source")
def candidate_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows per source, controls in texts made blanks first."""
    d = table(spark, sf_dir, "documents")
    raw = C.with_columns(d, {"native_id": F.col("doc_id").cast("string"), "partition": F.col("lang"), "title": F.regexp_replace("text", r"\p{Cc}", " ")})
    return C.quarantine(C.build(raw)).groupBy(F.col("origin.source").alias("source")).agg(F.count("*").alias("n_rejected"))


@query("select cand_id, lower(occurrence_key) as occurrence_key from candidates")
def occurrence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLAKE3 keys derived anew; the table stores what they must be."""
    c = table(spark, sf_dir, "candidates")
    part = lambda name: trim_unicode(F.col(name))
    return c.select("cand_id", K.occurrence_key(part("partition"), F.col("kind"), part("origin.source"), part("origin.subtype"), part("origin.native_id")).alias("occurrence_key"))


@query("select lower(occurrence_key) as key, count(*) as n from candidates group by 1 having count(*) > 1")
def occurrence_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.duplicate_occurrences(table(spark, sf_dir, "candidates").select(F.lower("occurrence_key").alias("key")))


_SHIP = """s as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_shipdate) as shipped from lineitem group by 1, 2, 3, 4),
f as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as k, 'scanner-' || (l_suppkey % 5) as source, year(shipped)::varchar as y, l_partkey as p, l_linenumber as v,
  lower(replace(p_brand, '#', '-')) || '/' || replace(p_name, ' ', '-') || '-' || p_partkey as c, p_name, p_name || ' ' || lower(p_type) as title from s join part on l_partkey = p_partkey)"""


@query(f"with {_SHIP} select 'ship-year:' || y as partition, 'CVE-' || y || '-' || p as issue, 'pkg:generic/' || c || '@' || v as subject, count(*) as n from f group by all having count(*) > 1")
def correlation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that share one exact correlation key (grouped by the digest, shown in plain text)."""
    good = C.with_keys(C.accepted(C.build(X.shipment_findings(spark, sf_dir))), Config(), F.col("origin.native_id"))
    each = good.select(F.explode("correlation_keys").alias("key"), "partition", F.get("issue_ids", F.lit(0)).alias("issue"), F.get("subjects", F.lit(0))["canonical"].alias("subject"))
    grouped = each.groupBy("key").agg(F.min("partition").alias("partition"), F.min("issue").alias("issue"), F.min("subject").alias("subject"), F.count("*").alias("n"))
    return grouped.where("n > 1").drop("key")


# ---------------------------------------------------------------- blocks and pairs

_BLOCKS = f"""b as (
  select 'issue' as kind, 'ship-year:' || y as partition, 'issue:CVE-' || y || '-' || p as block_value, k from f
  union all select 'subject', 'ship-year:' || y, 'purl:pkg:generic/' || c, k from f),
z as (select kind, partition, block_value, count(*) as size from b group by all)"""


@query(f"with {_SHIP}, {_BLOCKS} select kind as block_kind, partition, block_value, size from z")
def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.block_sizes(B.block_entries(X.shipments(spark, sf_dir))).select("block_kind", "partition", "block_value", "size")


@query(
    f"""with {_SHIP}, {_BLOCKS} select kind, size, 8::bigint as "limit", row_number() over (order by kind, partition, block_value)::int as position from z where size > 8"""
)
def oversized_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.oversized(B.block_entries(X.shipments(spark, sf_dir)), Config(max_block_size=8))


@query(
    f"""with {_SHIP}, {_BLOCKS} select distinct least(a.k, b2.k) as left_key, greatest(a.k, b2.k) as right_key from z join b a using (kind, partition, block_value) join b b2 using (kind, partition, block_value)
where z.size between 2 and 1000 and a.k < b2.k"""
)
def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = B.block_pairs(B.block_entries(X.shipments(spark, sf_dir)))
    return pairs.select(F.col("left").alias("left_key"), F.col("right").alias("right_key"))


@query("select p_partkey::varchar as key, 1::bigint as n_pairs from part")
def self_pair_quirk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding with two versions of one package pairs with itself, once."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("pkg:generic/widget-"), F.col("p_partkey"), F.lit("@"))
    raw = C.with_columns(p, {"source": F.lit("s"), "native_id": F.col("p_partkey").cast("string"), "partition": F.lit("q"), "purls": F.array(F.concat(name, F.lit("1")), F.concat(name, F.lit("2")))})
    pairs = B.block_pairs(B.block_entries(X._prepared(raw)))
    return pairs.where("left = right").groupBy(F.col("left").alias("key")).agg(F.count("*").alias("n_pairs"))


# ---------------------------------------------------------------- comparison

_EVENTS = """e as (select event_id as i, 'scanner-' || (event_id % 4) as source, 'tenant:' || (user_id % 50) as partition, event_type as kind,
  upper('cve-2024-' || (props::json ->> '$.k')) as issue, event_type || ' anomaly ' || (props::json ->> '$.k') as title, floor(value / 100)::bigint::varchar as v from events)"""


@query(
    f"""with {_EVENTS} select a.i::varchar as event, case when a.partition <> b.partition or a.kind <> b.kind or a.source = b.source then 'not_comparable' else 'other' end as decision,
case when a.partition <> b.partition then 1 when a.kind <> b.kind then 2 when a.source = b.source then 3 end::int as n_signals,
case when a.partition <> b.partition then 'different' when a.kind <> b.kind then 'different' when a.source = b.source then 'same_source' end as last_kind
from e a join e b on b.i = a.i + 4"""
)
def compare_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events four apart (always of one source): the partition, kind and source boundaries."""
    prepared = X.events(spark, sf_dir)
    pairs = prepared.select(F.col("key").alias("left"), (F.col("key").cast("long") + 4).cast("string").alias("right"))
    joined = join_pairs(pairs, prepared)
    out = compare(joined).withColumn("event", F.least(F.col("left").cast("long"), F.col("right").cast("long")).cast("string"))
    return out.select("event", "decision", F.size("signals").cast("int").alias("n_signals"), F.element_at("signals", -1)["kind"].alias("last_kind"))


@query(
    f"""with {_SHIP} select least(a.k, b.k) as left_key, greatest(a.k, b.k) as right_key,
case when a.source = b.source then 'not_comparable' when a.v = b.v then 'duplicate' else 'review' end as decision,
case when a.source = b.source then null when a.v = b.v then 10000 else 8800 end::int as score,
case when a.source = b.source then 'blocked' when a.v = b.v then 'exact_correlation' else 'fuzzy' end as method
from f a join f b on a.y = b.y and a.p = b.p and a.k < b.k"""
)
def compare_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every blocked pair of shipments, compared."""
    out = compare_all(X.shipments(spark, sf_dir))
    return out.select(F.col("left").alias("left_key"), F.col("right").alias("right_key"), "decision", "score", "method")


_PARTS = f"""n as (select p_partkey as i, 'scanner-' || (p_partkey % 5) as source, {NORMAL.format('p_name')} as name, {NORMAL.format("p_name || ' ' || p_type")} as title,
  {NORMAL.format("p_brand || '/' || p_type || '/' || p_size")} as location from part),
q as (select a.i, {lcs_sql('a.name', 'b.name')} as name, {lcs_sql('a.title', 'b.title')} as title, {lcs_sql('a.location', 'b.location')} as location from n a join n b on b.i = a.i + 1),
v as (select *, least(greatest(name, title) + (location * 500) // 10000, 9999)::int as score from q)"""


def _part_pairs(spark: SparkSession, sf_dir: str, config: Config = Config()) -> DataFrame:
    prepared = X.parts(spark, sf_dir)
    pairs = prepared.select(F.col("key").alias("left"), (F.col("key").cast("long") + 1).cast("string").alias("right"))
    out = compare(join_pairs(pairs, prepared), config)
    return out.withColumn("part", F.least(F.col("left").cast("long"), F.col("right").cast("long")))


@query(f"with {_PARTS} select i as part, case when score >= 6500 then 'review' else 'distinct' end as decision, score from v")
def compare_fuzzy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_pairs(spark, sf_dir).select("part", "decision", "score")


@query(
    f"""with {_PARTS}, s as (select i, unnest([('subject_name', name), ('title', title), ('location', location)]) as x from v)
select i as part, x[1] as field, case when x[2] = 10000 then 'exact' else 'similar' end as kind, x[2]::int as score from s"""
)
def compare_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _part_pairs(spark, sf_dir).select("part", F.explode("signals").alias("s")).select("part", "s.field", "s.kind", "s.score")
    return s.where(F.col("field").isin("subject_name", "title", "location"))


@query(
    f"with {_PARTS}, t(threshold) as (values (5000), (6500), (8000)) select threshold::int as threshold, case when score >= threshold then 'review' else 'distinct' end as decision, count(*) as n from v, t group by all"
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in (5000, 6500, 8000):
        one = _part_pairs(spark, sf_dir, Config(review_threshold=t)).groupBy("decision").agg(F.count("*").alias("n")).select(F.lit(t).alias("threshold"), "decision", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""with {_EVENTS} select a.i as event, case when a.partition <> b.partition or a.kind <> b.kind then 'not_comparable' when a.issue <> b.issue then 'distinct' else 'other' end as decision
from e a join e b on b.i = a.i + 1 where a.partition <> b.partition or a.kind <> b.kind or a.issue <> b.issue"""
)
def compare_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring events of different sources: other boundaries and issue conflicts."""
    prepared = X.events(spark, sf_dir)
    pairs = prepared.select(F.col("key").alias("left"), (F.col("key").cast("long") + 1).cast("string").alias("right"))
    out = compare(join_pairs(pairs, prepared)).withColumn("event", F.least(F.col("left").cast("long"), F.col("right").cast("long")))
    return out.where("method = 'blocked'").select("event", "decision")


# ---------------------------------------------------------------- clusters


@query(f"with {_SHIP} select k as key, min(k) over (partition by y, p, v) as cluster_key from f")
def exact_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact keys alone without the source rule: plain components."""
    return M.exact_components(X.shipments(spark, sf_dir))


# the r-th finding of a source joins the r-th cluster of its exact key
_RANKED = f"""{_SHIP}, r as (select *, row_number() over (partition by y, p, v, source order by k) as r from f),
m as (select *, min(k) over (partition by y, p, v, r) as cluster_key from r)"""


@query(f"with {_RANKED} select k as key, cluster_key from m")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cluster(X.shipments(spark, sf_dir)).members


@query(
    f"""with {_RANKED}, q as (select count(*) as n from f a join f b on a.y = b.y and a.p = b.p and a.k < b.k)
select count(*) as candidate_count, any_value(q.n) as candidate_pair_count, any_value(q.n) as comparison_count, count(*) - count(distinct cluster_key) as exact_merge_count,
0::bigint as fuzzy_merge_count, count(distinct cluster_key) as cluster_count from m, q"""
)
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cluster(X.shipments(spark, sf_dir)).stats


@query(
    f"with {_SHIP} select a.k as left_key, b.k as right_key, 8800::int as score, 'fuzzy' as method from f a join f b on a.y = b.y and a.p = b.p and a.k < b.k and a.v <> b.v and a.source <> b.source"
)
def review_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cluster(X.shipments(spark, sf_dir)).review_pairs.withColumnRenamed("left", "left_key").withColumnRenamed("right", "right_key")


@query(
    f"""with {_SHIP}, g as (select y, p, v, source, count(*) as n from f group by all), m as (select y, p, v, max(n) as most from g group by all)
select (select count(*) from f) as candidate_count, sum(most)::bigint as cluster_count from m"""
)
def cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the source rule an exact block of one key splits into as many clusters as its most frequent source has findings."""
    return M.cluster(X.shipments(spark, sf_dir)).stats.select("candidate_count", "cluster_count")


@query()
def cluster_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored candidates clustered with real digests as keys."""
    good = C.accepted(C.build(X.stored_findings(spark, sf_dir)))
    return M.cluster(C.prepared(C.with_keys(good))).members


_NEAR = "(p_partkey % 2 = 0 and p_partkey % 3 <> 0)"  # parts where b, not c, joins a and d


@query(f"select p_partkey || '-' || w as key, p_partkey || '-' || case when w = 'b' and not {_NEAR} then 'b' when w = 'c' and {_NEAR} then 'c' else 'a' end as cluster_key from part, (select unnest(['a', 'b', 'c', 'd']) as w)")
def fuzzy_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete links keep a bridge apart: two fuzzy duplicates of one pair that conflict with each other, or share its source."""
    return M.cluster(X.bridges(spark, sf_dir)).members


@query("select 4 * count(*) as candidate_count, 6 * count(*) as candidate_pair_count, 6 * count(*) as comparison_count, count(*) as exact_merge_count, count(*) as fuzzy_merge_count, 2 * count(*) as cluster_count from part")
def fuzzy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cluster(X.bridges(spark, sf_dir)).stats


@query("select p_partkey || '-b' as left_key, p_partkey || '-c' as right_key, 9000::int as score, 'fuzzy' as method from part")
def fuzzy_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conflicting pair is left to review, across two clusters."""
    return M.cluster(X.bridges(spark, sf_dir)).review_pairs.withColumnRenamed("left", "left_key").withColumnRenamed("right", "right_key")


@query(
    """with w as (select unnest(['a', 'b', 'c', 'd']) as w), q as (select p_partkey as p, l.w as l, r.w as r from part, w l, w r where l.w < r.w),
o as (select *, case when l = 'a' and r = 'b' and p % 3 = 0 then 'source' when l = 'a' and r = 'd' then 'exact' when l = 'b' and r = 'c' then 'conflict' else 'fuzzy' end as how,
  case when l in ('b', 'c') then l else r end as other from q)
select p || '-' || l as left_key, p || '-' || r as right_key,
case how when 'source' then 'not_comparable' when 'conflict' then 'review' else 'duplicate' end as decision,
case how when 'source' then null when 'exact' then 10000 when 'conflict' then 9000 else case when (other = 'b') = (p % 2 = 0) then 9300 else 9000 end end::int as score,
case how when 'source' then 'blocked' when 'exact' then 'exact_correlation' else 'fuzzy' end as method from o"""
)
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every blocked pair of the bridges: exact, fuzzy, of one source, and in conflict."""
    out = compare_all(X.bridges(spark, sf_dir))
    return out.select(F.col("left").alias("left_key"), F.col("right").alias("right_key"), "decision", "score", "method")


@query("select p_partkey::varchar as key, 'duplicate' as decision, 10000::int as score, 'same_occurrence' as method, 'source' as field from part")
def compare_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding compared with itself."""
    prepared = X.parts(spark, sf_dir)
    out = compare(join_pairs(prepared.select(F.col("key").alias("left"), F.col("key").alias("right")), prepared))
    return out.select(F.col("left").alias("key"), "decision", "score", "method", F.element_at("signals", -1)["field"].alias("field"))


@query("select p_partkey as part, 'distinct' as decision, 0::int as score, 'blocked' as method, 'different' as subject from part where p_partkey + 1 in (select p_partkey from part)")
def compare_subject_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring parts with one issue and different packages."""
    raw = C.with_columns(
        table(spark, sf_dir, "part"),
        {"source": F.concat(F.lit("s"), F.col("p_partkey") % 2), "native_id": F.col("p_partkey").cast("string"), "partition": F.lit("q"), "issues": F.array(F.lit("ADV-1")), "purls": F.array(F.concat(F.lit("pkg:generic/lamp-"), F.col("p_partkey")))},
    )
    prepared = X._prepared(raw)
    pairs = prepared.select(F.col("key").alias("left"), (F.col("key").cast("long") + 1).cast("string").alias("right"))
    out = compare(join_pairs(pairs, prepared)).withColumn("part", F.least(F.col("left").cast("long"), F.col("right").cast("long")))
    return out.select("part", "decision", "score", "method", F.element_at(F.filter("signals", lambda s: s["field"] == "subject"), 1)["kind"].alias("subject"))


@query(f"with {_EVENTS} select partition, kind, issue, count(*) as n from e group by all having count(*) > 1")
def issue_only_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact keys of issues alone, for findings without a subject, where the option allows them."""
    good = C.with_keys(C.accepted(C.build(X.event_findings(spark, sf_dir))), Config(issue_only_exact=True), F.col("origin.native_id"))
    kind = F.coalesce(F.col("kind.value"), F.create_map(*[F.lit(x) for pair in (("vulnerability", "error"), ("misconfiguration", "view"), ("secret", "purchase"), ("code", "click")) for x in pair])[F.col("kind.tag")])
    each = good.select(F.explode("correlation_keys").alias("key"), "partition", kind.alias("kind"), F.get("issue_ids", F.lit(0)).alias("issue"))
    grouped = each.groupBy("key").agg(F.min("partition").alias("partition"), F.min("kind").alias("kind"), F.min("issue").alias("issue"), F.count("*").alias("n"), F.count_distinct("partition", "kind", "issue").alias("mixed"))
    return grouped.where("n > 1 and mixed = 1").select("partition", "kind", "issue", "n")


# ---------------------------------------------------------------- stored results and JSON


@query(
    """with p as (select comparison_id, lower(left_key) as l, lower(right_key) as r, lower(trim(decision)) as d, score as s, method as m, signals,
  list_transform(signals, lambda x: list_position(['partition', 'kind', 'source', 'issue', 'subject', 'version', 'subject_name', 'title', 'location'], x.field)) as places,
  list_bool_and(list_transform(signals, lambda x: case
    when x.kind = 'exact' or (x.field = 'subject' and x.kind = 'similar') then x.score is not distinct from 10000
    when x.kind = 'similar' then coalesce(x.score >= 0 and x.score < 10000, false) else x.score is null end)) as sound from comparisons)
select comparison_id, case
  when not coalesce(regexp_matches(l, '^occ:v1:[0-9a-f]{64}$') and regexp_matches(r, '^occ:v1:[0-9a-f]{64}$'), false) then 'key'
  when not coalesce(d in ('duplicate', 'review', 'distinct', 'not_comparable') and m in ('same_occurrence', 'exact_correlation', 'fuzzy', 'blocked'), false) then 'name'
  when l > r then 'order' when coalesce(len(signals), 0) < 1 then 'signals' when places <> list_sort(list_distinct(places)) then 'signals' when not sound then 'signal'
  when not coalesce(case when m = 'same_occurrence' then l = r and d = 'duplicate' and s is not distinct from 10000 when l >= r then false
    when m = 'exact_correlation' then d = 'duplicate' and s is not distinct from 10000
    when m = 'fuzzy' then d <> 'not_comparable' and coalesce(s >= 0 and s < 10000, false)
    else (d = 'not_comparable' and s is null) or (d = 'distinct' and s is not distinct from 0) end, false) then 'state' end as error from p"""
)
def comparison_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first broken invariant of each stored comparison (keys and decisions folded first)."""
    c = table(spark, sf_dir, "comparisons").select(
        "comparison_id", F.lower("left_key").alias("left"), F.lower("right_key").alias("right"), F.lower(F.trim("decision")).alias("decision"), "score", "method", "signals"
    )
    return c.select("comparison_id", wire.comparison_error().alias("error"))


@query("select cluster_id, members = list_sort(list_distinct(members)) and len(members) > 0 as sound from clusters")
def cluster_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clusters").select("cluster_id", wire.members_valid(F.col("members")).alias("sound"))


@query("select warning_id, coalesce(size_limit >= 2 and size > size_limit, false) as sound from cluster_warnings")
def warning_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cluster_warnings").select("warning_id", wire.warning_valid(F.col("size"), F.col("size_limit")).alias("sound"))


@query("select p_partkey::varchar as native_id, true as same from part")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates written as JSON, read back strictly, built again and written again."""
    built = C.accepted(C.build(X.part_findings(spark, sf_dir)))
    first = built.select(F.col("origin.native_id").alias("id"), wire.candidate_json().alias("json"))
    read = wire.read_candidates(first).where("wire_error is null")
    again = C.accepted(C.build(read, ["json"])).select("origin.native_id", (wire.candidate_json() == F.col("json")).alias("same"))
    return again


_BAD_JSON = (
    ('{"origin":{"source":"s","native_id":"1"},"partition":"p","title":"t","extra":1}', "unknown field"),
    ('{"origin":{"source":"s","native_id":"1","more":2},"partition":"p","title":"t"}', "unknown field"),
    ('{"partition":"p","title":"t"}', "missing origin"),
    ('{"origin":{"source":"s","native_id":"1"},"title":"t"}', "missing field"),
    ('{"origin":{"source":"s","native_id":"1"},"partition":"p","kind":"bug","title":"t"}', "unknown kind"),
    ("[1, 2]", "malformed"),
    ('{"origin":{"source":"s","native_id":"1"},"partition":"p","title":"t","title":"u"}', "malformed"),
    ('{"origin":{"source":"s","native_id":"1"},"partition":"p","issue_ids":"x"}', "wrong type"),
    ('{"origin":{"source":"s","native_id":"1"},"partition":"p","issue_ids":null,"title":"t"}', "wrong type"),
    ('{"origin":{"source":"s","native_id":"1"},"partition":"p","subject_names":["a",null]}', "wrong type"),
    ('{"origin":{"source":"s","native_id":1},"partition":"p","title":"t"}', "wrong type"),
    ('{"origin":{"source":"s","native_id":"1"},"partition":"p","title":7}', "wrong type"),
    ('{"origin":{"source":"s","native_id":"1","subtype":null},"partition":"p","title":null,"issue_ids":[],"location":"l"}', None),
    ('{"origin":{"source":"s","native_id":"1"},"partition":"p","kind":{"other":"x"},"title":"t"}', None),
)


@query(
    "with t(n, e) as (values "
    + ", ".join(f"({i}, {'null' if e is None else repr(e)})" for i, (_, e) in enumerate(_BAD_JSON))
    + f") select p_partkey, e as wire_error from part join t on n = p_partkey % {len(_BAD_JSON)}"
)
def json_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*[F.lit(j) for j, _ in _BAD_JSON]), (F.col("p_partkey") % len(_BAD_JSON)).cast("int")).alias("json"))
    return wire.read_candidates(lines).select("p_partkey", "wire_error")


# A document's shape, its text with < and > for its two keys, and the error it must show.
_RESULTS = (
    ("comparison", '{"left":"<","right":">","decision":"review","score":7000,"method":"fuzzy","signals":[{"field":"partition","kind":"exact","score":10000}]}', None),
    ("comparison", '{"left":">","right":"<","decision":"review","score":7000,"method":"fuzzy","signals":[{"field":"partition","kind":"exact","score":10000}]}', "order"),
    ("comparison", '{"left":"<","right":">","decision":"distinct","score":0,"method":"blocked","signals":[]}', "signals"),
    ("comparison", '{"left":"<","right":">","decision":"distinct","score":"0","method":"blocked","signals":[{"field":"issue","kind":"different","score":null}]}', "shape"),
    ("comparison", '{"left":"<","right":">","decision":"distinct","score":5,"method":"blocked","signals":[{"field":"issue","kind":"different","score":null}]}', "state"),
    ("comparison", '{"left":"<","right":">","decision":"distinct","score":0,"method":"blocked","signals":[{"field":"issue","kind":"different","score":3}]}', "signal"),
    ("warning", '{"OversizedBlock":{"kind":"issue","size":9,"limit":8}}', None),
    ("warning", '{"OversizedBlock":{"kind":"issue","size":8,"limit":8}}', "warning"),
    ("warning", '{"OversizedBlock":{"kind":"title","size":9,"limit":8}}', "name"),
    ("stats", '{"candidate_count":3,"candidate_pair_count":2,"comparison_count":3,"exact_merge_count":1,"fuzzy_merge_count":0,"cluster_count":2}', None),
    ("stats", '{"candidate_count":3,"candidate_pair_count":2,"comparison_count":3,"exact_merge_count":1,"fuzzy_merge_count":1,"cluster_count":2}', "stats"),
    ("cluster", '{"members":["<",">"]}', None),
    ("cluster", '{"members":[">","<"]}', "members"),
    ("cluster", '{"members":["<"],"size":1}', "shape"),
    ("result", '{"clusters":[{"members":["<"]},{"members":[">"]}],"review_pairs":[{"left":"<","right":">","decision":"review","score":7000,"method":"fuzzy","signals":[{"field":"partition","kind":"exact","score":10000}]}],"warnings":[],"stats":{"candidate_count":2,"candidate_pair_count":1,"comparison_count":1,"exact_merge_count":0,"fuzzy_merge_count":0,"cluster_count":2}}', None),
    ("result", '{"clusters":[{"members":["<",">"]}],"review_pairs":[{"left":"<","right":">","decision":"review","score":7000,"method":"fuzzy","signals":[{"field":"partition","kind":"exact","score":10000}]}],"warnings":[],"stats":{"candidate_count":2,"candidate_pair_count":1,"comparison_count":1,"exact_merge_count":1,"fuzzy_merge_count":0,"cluster_count":1}}', "review pairs"),
    ("result", '{"clusters":[{"members":[">"]},{"members":["<"]}],"review_pairs":[],"warnings":[],"stats":{"candidate_count":2,"candidate_pair_count":1,"comparison_count":1,"exact_merge_count":0,"fuzzy_merge_count":0,"cluster_count":2}}', "cluster order"),
    ("result", '{"clusters":[{"members":["<",">"]}],"review_pairs":[],"warnings":[],"stats":{"candidate_count":3,"candidate_pair_count":1,"comparison_count":1,"exact_merge_count":2,"fuzzy_merge_count":0,"cluster_count":1}}', "counts"),
)


@query(
    "with t(n, shape, e) as (values "
    + ", ".join(f"({i}, '{shape}', {'null' if e is None else repr(e)})" for i, (shape, _, e) in enumerate(_RESULTS))
    + f") select p_partkey, shape, e as wire_error from part join t on n = p_partkey % {len(_RESULTS)}"
)
def result_json_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results of every shape, sound and broken, read back strictly."""
    digits = lambda c: F.concat(F.lit("occ:v1:"), F.lpad(F.lower(F.hex(c)), 64, "0"))
    which = (F.col("p_partkey") % len(_RESULTS)).cast("int")
    json = F.get(F.array(*[F.lit(j) for _, j, _ in _RESULTS]), which)
    json = F.replace(F.replace(json, F.lit("<"), digits(2 * F.col("p_partkey"))), F.lit(">"), digits(2 * F.col("p_partkey") + 1))
    shape = F.get(F.array(*[F.lit(s) for s, _, _ in _RESULTS]), which)
    lines = table(spark, sf_dir, "part").select("p_partkey", shape.alias("shape"), json.alias("json"))
    out = None
    for name in wire.SHAPES:
        read = wire.read_results(lines.where(F.col("shape") == name), name).select("p_partkey", "shape", "wire_error")
        out = read if out is None else out.unionByName(read)
    return out
