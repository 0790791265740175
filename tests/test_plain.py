"""Plain candidates: what they are spared, with the results they had."""

from itertools import product

from pyspark.sql import functions as F
from test_operators import prepared

from coalis.functions.subjects import canonical_subject, is_canonical, parse_subject
from coalis.operators import blockwise
from coalis.operators import cluster as M


def plain(spark):
    finding = lambda i, source, version: {"native_id": str(i), "source": source, "issues": ["CVE-1"], "purls": [f"pkg:generic/w@{version}"]}
    return prepared(spark, *[finding(i, *x) for i, x in enumerate([("a", 1), ("b", 1), ("b", 1), ("a", 2)])])


def test_clusters_of_plain_candidates_compare_no_pair(spark, monkeypatch):
    p = plain(spark)
    want = M.cluster(p).review_pairs.collect()

    def fail(*_, **__):
        raise AssertionError("compared")

    monkeypatch.setattr(M, "compare_blocked", fail)
    result = M.cluster(p)
    assert sorted(map(tuple, result.members.collect())) == [("a/0", "a/0"), ("a/3", "a/3"), ("b/1", "a/0"), ("b/2", "b/2")]
    assert tuple(result.stats.first()) == (4, 6, 6, 1, 0, 3)
    assert sorted((r["left"], r["right"]) for r in want) == [("a/3", "b/1"), ("a/3", "b/2")]


def test_comparison_derives_no_digest(spark):
    assert "correlations" not in blockwise.slim(plain(spark))._jdf.queryExecution().executedPlan().toString()


def test_canonical_purls_are_taken_apart_as_the_parser_does(spark):
    kinds = ["generic", "npm", "pypi", "cargo", "github", "qpkg", "Generic", "a.b"]
    values = [f"pkg:{k}{n}{v}" for k, n, v in product(kinds, ["/a", "/A", "/a_b", "/n/a", "//a", "/a%41", "/"], ["", "@1.X", "@", "@1?k=v", "#s", "\n"])]
    rows = spark.createDataFrame([(v,) for v in values], "v string").where(is_canonical(F.col("v"))).select("v", canonical_subject(F.col("v")).alias("s")).collect()
    assert len(rows) == 32  # generic 8, a.b 8, npm, github and qpkg 4 each, pypi and cargo 2 each
    for r in rows:
        assert r["s"].asDict(True) == parse_subject(r["v"])
