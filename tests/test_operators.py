import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from coalis.config import ERROR, Config
from coalis.operators import blocking as B
from coalis.operators import blockwise
from coalis.operators import candidates as C
from coalis.operators import cluster as M
from coalis.operators.compare import compare, join_pairs
from coalis.operators.groups import label_groups
from coalis.operators.merge import merge_group
from coalis.operators.pairwise import decide
from coalis.operators.selection import heavy_keys, key_quantiles
from coalis.schema import RAW
from coalis.sources import wire
from coalis.sources.scratch import Scratch

DEFAULTS = {"subtype": None, "partition": "global", "kind": None, "issues": [], "purls": [], "cpes": [], "subject_names": [], "title": None, "location": None, "affected_version": None}


def raw(spark, *findings):
    rows = [{**DEFAULTS, "source": f"s{i}", "native_id": str(i)} | f for i, f in enumerate(findings)]
    return spark.createDataFrame([tuple(r[f.name] for f in RAW.fields) for r in rows], RAW)


def prepared(spark, *findings, config=Config(), digests=False):
    good = C.accepted(C.build(raw(spark, *findings)))
    return C.prepared(C.with_keys(good, config, None if digests else F.concat_ws("/", "origin.source", "origin.native_id")))


def pair(spark, a, b, config=Config()):
    p = prepared(spark, {"source": "one", "native_id": "1"} | a, {"source": "two", "native_id": "2"} | b, config=config)
    keys = sorted(r["key"] for r in p.collect())
    out = {}
    for left, right in (keys, keys[::-1]):
        pairs = spark.createDataFrame([(left, right)], "left string, right string")
        out[left] = compare(join_pairs(pairs, p), config).first()
    first, second = out.values()
    assert first == second  # symmetric
    rows = {r["key"]: r.asDict(True) for r in p.collect()}
    assert decide(rows[keys[0]], rows[keys[1]], config) == (first["decision"], first["score"], first["method"])
    return first


ISSUE = {"issues": ["CVE-1"]}


@pytest.mark.parametrize(
    ("a", "b", "config", "expected"),
    [
        (ISSUE | {"purls": ["pkg:PYPI/a_b@1"]}, ISSUE | {"purls": ["pkg:pypi/a-b@1"]}, {}, ("duplicate", "exact_correlation")),
        (ISSUE, ISSUE | {"partition": "p2"}, {}, ("not_comparable", "blocked")),
        (ISSUE, ISSUE | {"kind": ("code", None)}, {}, ("not_comparable", "blocked")),
        (ISSUE | {"purls": ["pkg:cargo/widget"]}, ISSUE | {"purls": ["pkg:cargo/lantern"]}, {}, ("distinct", "blocked")),
        (ISSUE | {"purls": ["pkg:cargo/widget@1"]}, ISSUE | {"cpes": ["cpe:2.3:a:acme:widget:1:*:*:*:*:*:*:*"]}, {}, ("review", "fuzzy")),
        (ISSUE, ISSUE, {"issue_only_exact": True}, ("duplicate", "exact_correlation")),
        ({"issues": ["A"], "title": "same"}, {"issues": ["B"], "title": "same"}, {}, ("distinct", "blocked")),
        ({"title": "identical title"}, {"title": "identical title"}, {}, ("review", "fuzzy")),
        (ISSUE | {"purls": ["pkg:cargo/w@1.0.0"]}, ISSUE | {"purls": ["pkg:cargo/w@2.0.0"]}, {}, ("review", "fuzzy")),
        (ISSUE | {"purls": ["pkg:generic/w@1?arch=amd64"]}, ISSUE | {"purls": ["pkg:generic/w@1?arch=arm64"]}, {}, ("review", "fuzzy")),
        (ISSUE | {"purls": ["pkg:generic/w@1?arch=amd64"]}, ISSUE | {"purls": ["pkg:generic/w@1"]}, {}, ("duplicate", "fuzzy")),
        (ISSUE, ISSUE, {}, ("distinct", "fuzzy")),
        (ISSUE | {"subject_names": ["openssl"], "title": "overflow"}, ISSUE | {"subject_names": ["openssl"], "title": "overflow"}, {}, ("duplicate", "fuzzy")),
        (ISSUE | {"source": "one", "purls": ["pkg:a/b@1"]}, ISSUE | {"source": "one", "purls": ["pkg:a/b@1"]}, {}, ("not_comparable", "blocked")),
        (ISSUE | {"source": "one", "purls": ["pkg:a/b@1"]}, ISSUE | {"source": "one", "purls": ["pkg:a/b@1"]}, {"cross_source_only": False}, ("duplicate", "exact_correlation")),
    ],
)
def test_decision_table(spark, a, b, config, expected):
    row = pair(spark, a, b, Config(**config))
    assert (row["decision"], row["method"]) == expected


def test_signals_are_ordered_and_private(spark):
    row = pair(spark, ISSUE | {"purls": ["pkg:generic/w@1"], "title": "secret title"}, ISSUE | {"purls": ["pkg:generic/w@1?arch=x"], "title": "secret titles"})
    assert [s["field"] for s in row["signals"]] == ["partition", "kind", "issue", "subject", "version", "subject_name", "title", "location"]
    assert [s["kind"] for s in row["signals"]][2:] == ["exact", "similar", "exact", "exact", "similar", "missing"]
    assert "secret" not in str(row)


def findings(rng, n):
    pick = lambda values, most: rng.sample(values, rng.randint(0, most))
    for i in range(n):
        yield {
            "source": rng.choice("abc"),
            "native_id": str(i),
            "partition": rng.choice(["p", "q"]),
            "kind": rng.choice([("code", None), ("vulnerability", None)]),
            "issues": pick(["I1", "I2", "I3"], 2),
            "purls": pick(["pkg:generic/w@1", "pkg:generic/w@2", "pkg:generic/w@1?arch=x", "pkg:generic/v"], 2),
            "cpes": pick(["cpe:/a:v:w:1", "cpe:/a:v:w:2", "cpe:/a:v:w"], 1),
            "subject_names": pick(["widget", "wodget", "gadget!"], 2),
            "title": rng.choice(["lamp mill", "lamp mill kit", "mill kit", "t"]),
            "location": rng.choice([None, "src/a", "src/b"]),
            "affected_version": rng.choice([None, "1", "3"]),
        }


def test_projection_and_python_agree_and_merging_in_parts_is_merging_whole(spark):
    config = Config(duplicate_threshold=7000, review_threshold=5000, subject_similarity_threshold=7000)
    p = prepared(spark, *findings(random.Random(5), 40), config=config, digests=True).cache()
    rows = {r["key"]: r.asDict(True) for r in p.collect()}
    pairs = spark.createDataFrame(list(combinations(sorted(rows), 2)), "left string, right string")
    for c in compare(join_pairs(pairs, p), config).collect():
        assert decide(rows[c["left"]], rows[c["right"]], config) == (c["decision"], c["score"], c["method"])

    result = M.cluster(p, config)
    blocked = B.block_pairs(B.block_entries(p), config).collect()
    compared = {(b["left"], b["right"]): decide(rows[b["left"]], rows[b["right"]], config) for b in blocked}
    clusters, reviews, counts = merge_group(list(rows.values()), compared, config)
    assert {tuple(r) for r in result.members.collect()} == set(clusters)
    stats = result.stats.first()
    assert (stats["exact_merge_count"], stats["fuzzy_merge_count"]) == (counts["exact_merges"], counts["fuzzy_merges"])
    assert stats["comparison_count"] == len(blocked) + counts["asked"]
    of = dict(clusters)
    expected = {(a, b) for (a, b), d in compared.items() if d[0] == "review" and of[a] != of[b]} | {(r[0], r[1]) for r in reviews if of[r[0]] != of[r[1]]}
    assert {(r["left"], r["right"]) for r in result.review_pairs.collect()} == expected


def test_complete_link_keeps_a_bridge_apart(spark):
    names = [["alpha beta"], ["alpha beta gamma"], ["beta gamma"]]
    config = Config(duplicate_threshold=7000, review_threshold=6000, subject_similarity_threshold=7000)
    result = M.cluster(prepared(spark, *[ISSUE | {"subject_names": n} for n in names], config=config), config)
    assert sorted(len(r["members"]) for r in result.clusters.collect()) == [1, 2]


def test_one_source_never_twice_in_a_cluster(spark):
    same = ISSUE | {"purls": ["pkg:a/b@1"]}
    for order in ((0, 1, 2), (2, 1, 0)):
        rows = [{"source": "one", "native_id": "1"}, {"source": "one", "native_id": "2"}, {"source": "two", "native_id": "3"}]
        result = M.cluster(prepared(spark, *[same | rows[i] for i in order], digests=True))
        assert sorted(len(r["members"]) for r in result.clusters.collect()) == [1, 2]


def test_stats_of_an_exact_pair(spark):
    same = ISSUE | {"purls": ["pkg:a/b@1"]}
    assert tuple(M.cluster(prepared(spark, same, same)).stats.first()) == (2, 1, 1, 1, 0, 1)


def test_duplicate_occurrence_is_an_error(spark):
    same = ISSUE | {"source": "s", "native_id": "1"}
    with pytest.raises(M.DuplicateOccurrence) as e:
        M.cluster(prepared(spark, same, same))
    assert e.value.key == "s/1"


def test_oversized_blocks_warn_or_fail(spark):
    p = prepared(spark, *[ISSUE | {"subject_names": [n]} for n in "abc"])
    small = Config(max_block_size=2)
    result = M.cluster(p, small)
    assert result.stats.first()["candidate_pair_count"] == 0
    assert [(w["kind"], w["size"], w["limit"]) for w in result.warnings.collect()] == [("issue", 3, 2)]
    with pytest.raises(B.OversizedBlock):
        M.cluster(p, Config(max_block_size=2, oversized_block_policy=ERROR))
    versions = prepared(spark, *[{"purls": [f"pkg:a/b@{v}"]} for v in "123"])
    assert [(w["kind"], w["size"]) for w in M.cluster(versions, small).warnings.collect()] == [("subject", 3)]


def test_two_versions_of_one_package_pair_with_themselves(spark):
    p = prepared(spark, {"purls": ["pkg:a/w@1", "pkg:a/w@2"]})
    assert tuple(M.cluster(p).stats.first()) == (1, 1, 1, 0, 0, 1)


def test_exact_bridging_and_text_only_candidates(spark):
    s = {"purls": ["pkg:a/b@1"]}
    bridged = M.cluster(prepared(spark, s | {"issues": ["i1"]}, s | {"issues": ["i1", "i2"]}, s | {"issues": ["i2"]}))
    assert bridged.clusters.count() == 1
    assert M.cluster(prepared(spark, {"title": "same"}, {"title": "same"})).stats.first()["candidate_pair_count"] == 0


def test_empty_input(spark):
    result = M.cluster(prepared(spark, {"title": "x"}).where("false"))
    assert result.members.count() == 0 and tuple(result.stats.first()) == (0, 0, 0, 0, 0, 0)


@pytest.mark.parametrize(
    ("finding", "code", "field"),
    [
        ({"source": " "}, "EmptyField", "source"),
        ({"source": None}, "EmptyField", "source"),
        ({"native_id": "a\u0007"}, "ControlCharacter", "native_id"),
        ({"partition": None}, "EmptyField", "partition"),
        ({"title": "abc\n"}, "ControlCharacter", "title"),
        ({"title": ""}, "EmptyField", "title"),
        ({"kind": ("other", " ")}, "EmptyField", "kind"),
        ({"issues": ["ok", " "]}, "EmptyIssueId", None),
        ({"subject_names": [""]}, "EmptyField", "subject_name"),
        ({"title": None, "location": "x", "affected_version": "1"}, "NoEvidence", None),
        ({"purls": ["pkg:generic/w@"], "source": ""}, "EmptyPurlVersion", None),
        ({"purls": ["cpe:/a:v:p"]}, "InvalidPurl", None),
        ({"cpes": ["pkg:a/b"]}, "UnsupportedCpeBinding", None),
        ({"title": "abc ", "issues": ["CVE-1\n"]}, None, None),
    ],
)
def test_validation(spark, finding, code, field):
    row = C.build(raw(spark, {"title": "t"} | finding)).first()
    assert (row["error"] and row["error"]["code"]) == code
    if field:
        assert row["error"]["field"] == field


def test_build_trims_sorts_and_folds(spark):
    row = C.build(raw(spark, {"title": " t ", "issues": ["cve-2", "CVE-1 ", "CVE-2"], "purls": ["pkg:a/b@2", "pkg:a/b@1", "pkg:A/b@1"], "cpes": ["cpe:/a:v:p"], "subject_names": ["b", " a", "a"]})).first()
    assert (row["title"], row["issue_ids"], row["subject_names"]) == ("t", ["CVE-1", "CVE-2"], ["a", "b"])
    assert [s["canonical"] for s in row["subjects"]] == ["pkg:a/b@1", "pkg:a/b@2", "cpe:2.3:a:v:p:*:*:*:*:*:*:*:*"]


def test_mapping_fills_missing_columns(spark):
    df = spark.createDataFrame([("x", 7)], "tool string, n int")
    row = C.with_columns(df, {"source": F.col("tool"), "native_id": F.col("n")}).first()
    assert (row["source"], row["native_id"], row["title"]) == ("x", "7", None)


def test_no_plan_has_a_cross_join(spark):
    p = prepared(spark, ISSUE, ISSUE)
    plan = compare(join_pairs(B.block_pairs(B.block_entries(p)), p))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_label_groups_is_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(label_groups(spark.createDataFrame(edges, "left long, right long")).collect())
    assert got == {k: find(k) for k in list(parent)}


def test_key_quantiles_are_exact(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b"]), rng.choice([None, rng.randint(-(10**12), 10**12), 5])) for _ in range(4000)]
    rows += [("none", None), (None, 3), ("one", 9)]
    probs = {"lo": 0.0, "q": 0.25, "mid": 0.5, "hi": 1.0}
    df = spark.createDataFrame(rows, "k string, v long").withColumn("n", F.lit("clash")).withColumn("c", F.lit(1))
    got = {r["k"]: r for r in key_quantiles(df.drop("n", "c").withColumn("extra", F.lit(0)), ["k"], "v", probs).collect()}
    import math

    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        assert got[key]["n"] == sum(k == key for k, _ in rows) and got[key]["n_values"] == len(values)
        for name, p in probs.items():
            assert got[key][name] == (values[max(math.ceil(p * len(values)), 1) - 1] if values else None)
    few = key_quantiles(df, ["k"], "v", probs, min_rows=1000).collect()
    assert [r["k"] for r in few] == ["hot"]
    assert key_quantiles(df.where("false"), ["k"], "v", probs).count() == 0


@pytest.mark.parametrize("bits", [4, 16])
def test_heavy_keys_are_exact(spark, bits):
    rng = random.Random(12)
    rows = [(rng.choice("ab"), rng.choice([None, "hot", "hot", "hot", "warm", *map(str, range(300))])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "kind string, k string").withColumn("_h", F.lit(0)).withColumn("n", F.lit("x"))
    counts = {}
    for r in rows:
        counts[r] = counts.get(r, 0) + 1
    for least in (0, 5, 8, 100, 5000):
        got = [(r["kind"], r["k"], r["n"]) for r in heavy_keys(df, ["kind", "k"], least, bits=bits).collect()]
        assert sorted(got, key=str) == sorted(((*k, n) for k, n in counts.items() if n >= least), key=str)
    assert heavy_keys(df.where("false"), ["kind", "k"], 1).count() == 0


def test_wire_round_trip_and_strictness(spark):
    built = C.accepted(C.build(raw(spark, {"kind": ("other", "x"), "title": 'a "quoted" }', "purls": ["pkg:a/b@1"]}, {"issues": ["CVE-1"]})))
    lines = built.select(wire.candidate_json().alias("json"))
    read = wire.read_candidates(lines)
    assert [r[0] for r in read.select("wire_error").collect()] == [None, None]
    assert sorted(r[0] for r in C.accepted(C.build(read)).select(wire.candidate_json()).collect()) == sorted(r[0] for r in lines.collect())


def test_stored_results_are_checked(spark):
    key = lambda c: "occ:v1:" + c * 64
    signal = [("partition", "exact", 10000)]
    rows = [
        (key("a"), key("b"), "duplicate", 10000, "exact_correlation", signal, None),
        (key("b"), key("a"), "duplicate", 10000, "exact_correlation", signal, "order"),
        (key("a"), key("b"), "duplicate", 10000, "fuzzy", signal, "state"),
        (key("a"), key("b"), "not_comparable", None, "blocked", signal, None),
        (key("a"), key("b"), "distinct", 0, "blocked", [("kind", "exact", 10000), ("partition", "exact", 10000)], "signals"),
        (key("a"), key("b"), "distinct", 0, "blocked", [("title", "similar", 10000)], "signal"),
        (key("a"), key("b"), "distinct", 0, "blocked", [], "signals"),
        ("x", key("b"), "distinct", 0, "blocked", signal, "key"),
    ]
    df = spark.createDataFrame(rows, "left string, right string, decision string, score int, method string, signals array<struct<field:string,kind:string,score:int>>, want string")
    for r in df.select("want", wire.comparison_error().alias("got")).collect():
        assert r["want"] == r["got"]
    stats = spark.createDataFrame([(2, 1, 1, 1, 0, 1), (2, 1, 0, 1, 0, 1)], "candidate_count long, candidate_pair_count long, comparison_count long, exact_merge_count long, fuzzy_merge_count long, cluster_count long")
    assert [r[0] for r in stats.select(wire.stats_valid()).collect()] == [True, False]


def test_a_written_table_leaves_no_shuffle_files(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    written = Scratch(spark, "test").write(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "t")
    assert files() <= before and written.count() == 7


@pytest.mark.parametrize("most", [1000, 12])
def test_blockwise_comparison_in_slices_is_that_of_all_block_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(blockwise, "SLICE_ROWS", 14)
    monkeypatch.setattr(M, "SLICE_ROWS", 20)
    config = Config(duplicate_threshold=7000, review_threshold=5000, subject_similarity_threshold=7000, max_block_size=most)
    p = prepared(spark, *findings(random.Random(8), 60), config=config, digests=True).cache()
    rows = {r["key"]: r.asDict(True) for r in p.collect()}
    pairs = [(b["left"], b["right"]) for b in B.block_pairs(B.block_entries(p), config).collect()]
    found = blockwise.compare_all(p, config).collect()
    assert sorted(tuple(c) for c in found) == sorted((a, b, *decide(rows[a], rows[b], config)) for a, b in pairs) and pairs
    by = {}
    for k, r in rows.items():
        for c in r["correlation_keys"]:
            by.setdefault(c, []).append(k)
    edges = M.exact_edges(p).collect()
    assert {tuple(e) for e in edges} == {(min(ks), k) for ks in by.values() for k in ks if k != min(ks)}
