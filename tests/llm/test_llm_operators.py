import random


import numpy as np
import pytest
from pyspark.sql import functions as F

from coalis.functions.subjects import names_of
from coalis.llm import components, incremental, mixing, nearcopies, packing, survivorship, truncation
from coalis.llm.tokens import VOCABULARY, encoder, token_count

CANDIDATE = (
    "cand_id long, occurrence_key string, origin struct<source:string,subtype:string,native_id:string>, partition string, kind struct<tag:string,value:string>, "
    "issue_ids array<string>, subject_ids array<string>, subject_names array<string>, title string, location string, affected_version string, seen_at timestamp_ntz"
)
K = lambda c: "occ:v1:" + c * 64


def candidates(spark, rows, extra=""):
    base = dict(occurrence_key=K("a"), origin=("s", None, "1"), partition="p", kind=("code", None), issue_ids=["I"], subject_ids=["pkg:a/b@1"], subject_names=None, title=None, location=None, affected_version=None, seen_at=None)
    names = [c.split()[0] for c in CANDIDATE.replace("struct<source:string,subtype:string,native_id:string>", "x").replace("struct<tag:string,value:string>", "x").split(", ")]
    full = [base | {"cand_id": i} | r for i, r in enumerate(rows, 1)]
    tail = [c.split()[0] for c in extra.split(", ")] if extra else []
    return spark.createDataFrame([tuple(r[n] for n in names + tail) for r in full], CANDIDATE + (", " + extra if extra else ""))


def clashing(df):
    """Extra columns whose names the operators use inside."""
    return df.withColumns({c: F.lit("x") for c in ("u", "v", "m", "n", "id", "key", "_key", "rank", "gkey", "bag", "left", "right", "h1", "first_id", "luck", "block", "curve", "word", "body") if c not in df.columns})


# ------------------------------------------------------------------ 1


def test_survivors(spark):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    rows = [
        {"cand_id": 1, "occurrence_key": K("a"), "origin": ("Good_Scan ", None, "1"), "title": "N/A", "affected_version": "1.0", "seen_at": day(1)},
        {"cand_id": 2, "occurrence_key": K("A"), "origin": ("good-scan", None, "1"), "title": " ", "affected_version": "{{version}}", "seen_at": day(2)},
        {"cand_id": 3, "occurrence_key": K("b"), "origin": ("poor", None, "1"), "title": "real", "affected_version": "2.0", "seen_at": None},
        {"cand_id": 4, "occurrence_key": K("b"), "origin": ("unlisted", None, "1"), "title": "also real", "affected_version": None, "seen_at": day(9)},
        {"cand_id": 5, "occurrence_key": K("c"), "origin": (None, None, "1"), "title": "x", "affected_version": "unknown", "seen_at": day(1)},
        {"cand_id": 6, "occurrence_key": K("c"), "origin": (None, None, "1"), "title": "xxx", "affected_version": "--", "seen_at": day(1)},
        {"cand_id": 7, "occurrence_key": None, "origin": ("good-scan", None, "1"), "title": "lost"},
    ]
    groups = [(1, [K("a"), K("B"), K("b"), None]), (2, [K("a"), K("A")]), (3, [K("c"), K("d")]), (4, None), (5, []), (6, [K("e"), K("f")])]
    fields = {"title": F.col("title"), "affected_version": F.col("affected_version"), "source": None}
    g = clashing(spark.createDataFrame(groups, "cluster_id long, members array<string>"))
    s = clashing(spark.createDataFrame([("good-scan", 1), ("poor", 5), ("poor", 7)], "source string, trust_rank int"))
    c = clashing(candidates(spark, rows))
    got = {(r[0], r[1]): r[2] for r in survivorship.survivors(g, c, s, fields).collect()}
    assert got == {(1, "title"): 3, (1, "affected_version"): 1, (1, "source"): 2, (3, "title"): 5, (3, "source"): 5}
    assert survivorship.survivors(g.where("false"), c, s, fields).count() == survivorship.survivors(g, c.where("false"), s, fields).count() == 0
    record = {r["cluster_id"]: r for r in survivorship.golden_records(g, c, s).collect()}
    assert (record[1]["title"], record[1]["affected_version"], record[1]["source"]) == ("real", "1.0", "good-scan") and record[3]["affected_version"] is None


def test_a_key_that_most_groups_list_is_attached_apart(spark, monkeypatch):
    monkeypatch.setattr(survivorship, "attach", lambda rows, on, table, limit, _f=survivorship.attach: _f(rows, on, table, 5))
    rows = [{"cand_id": i, "occurrence_key": K(c), "origin": ("s", None, "1"), "title": f"t{c}"} for i, c in enumerate("abcdef", 1)]
    groups = spark.createDataFrame([(i, [K("a"), K("bcdef"[i % 5])]) for i in range(20)], "cluster_id long, members array<string>")
    sources = spark.createDataFrame([("s", 1)], "source string, trust_rank int")
    got = survivorship.survivors(groups, candidates(spark, rows), sources, {"title": F.col("title")}).collect()
    assert len(got) == 20 and {r[2] for r in got} == {1}
    none = survivorship.survivors(groups, candidates(spark, rows), sources, {"title": F.col("title")}, stand_ins=("ta",)).collect()
    assert {r[2] for r in none} == {2, 3, 4, 5, 6}


@pytest.mark.parametrize("text", ["", " ", " ", "--", "?", "...", "N.A.", "#N/A", "(none)", "<null>", "T.B.D.", "UNKNOWN ", "[title]", "${version}", "%VERSION%", "x.y.z", "to be filled in", "xxx", None])
def test_stand_ins(spark, text):
    assert spark.createDataFrame([(text,)], "x string").select(survivorship.usable(F.col("x"))).first()[0] is False


@pytest.mark.parametrize("text", ["1.0", "v9.6", "none of the checks run", "<script> in title", "Unknown cursor extraction", "x"])
def test_real_values(spark, text):
    assert spark.createDataFrame([(text,)], "x string").select(survivorship.usable(F.col("x"))).first()[0] is True


# ------------------------------------------------------------------ 2


def groups_of(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in list(parent)}


@pytest.mark.parametrize("hot", [None, 3])
def test_components(spark, monkeypatch, hot):
    rng = random.Random(6)
    edges = [(f"k{rng.randint(0, 80):03}", f"k{rng.randint(0, 80):03}") for _ in range(50)]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)] + [("hub", f"h{i}") for i in range(60)] + [("x", None), (None, None), ("y", "y")]
    edges += edges[:9]
    if hot:  # every node of some degree takes the broadcast way
        monkeypatch.setattr(components, "attach", lambda rows, on, table, limit, _f=components.attach: _f(rows, on, table, hot))
    df = clashing(spark.createDataFrame(edges, "left string, right string"))
    got = components.connected(df).collect()
    assert dict(got) == groups_of(edges) and len(got) == len(set(got))
    assert components.connected(df.where("false")).count() == 0


def test_linked_keys(spark):
    at = "2024-01-0{} 00:00:00"
    rows = [
        (1, K("a"), K("b"), "duplicate", at.format(1)), (2, K("B"), K("a"), "distinct", at.format(2)),  # the later one counts
        (3, K("c"), K("d"), "review", at.format(2)), (4, K("D"), K("c"), " Duplicate", at.format(3)),
        (5, K("d"), K("d"), "duplicate", at.format(1)), (6, K("e"), K("f"), None, at.format(1)),
        (7, K("0"), K("1"), "distinct", at.format(1)), (8, K("1"), K("0"), "duplicate", at.format(1)),  # a tie: the larger id
        (9, K("2"), K("3"), "duplicate", None), (10, None, K("3"), "duplicate", at.format(1)), (11, "odd", K("2"), "duplicate", at.format(1)),
    ]
    comparisons = spark.createDataFrame(rows, "comparison_id long, left_key string, right_key string, decision string, t string").withColumn("compared_at", F.to_timestamp_ntz("t"))
    lists = spark.createDataFrame([(1, [K("C"), K("9"), K("9")]), (2, [K("7")]), (3, None), (4, [K("8"), None])], "cluster_id long, members array<string>")
    got = dict(components.linked_keys(clashing(comparisons), clashing(lists)).collect())
    assert got == {K("c"): K("9"), K("d"): K("9"), K("9"): K("9"), K("0"): K("0"), K("1"): K("0"), K("2"): K("2"), K("3"): K("2"), "odd": K("2")}
    assert components.linked_keys(comparisons.where("false"), lists.where("false")).count() == 0


# ------------------------------------------------------------------ 3


def noisy(rng, words):
    words = list(words)
    for _ in range(rng.randint(0, 2)):
        i = rng.randrange(len(words))
        w = words[i]
        words[i] = w[:1] + rng.choice("aeiou") + w[2:] if len(w) > 2 else w
    rng.shuffle(words)
    return rng.choice([" ", "  ", " - "]).join(words)


def test_near_copies_match_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    rows = []
    for _ in range(60):
        words = rng.sample(vocabulary, 14)
        for _ in range(rng.randint(1, 4)):
            rows.append({"title": noisy(rng, words).upper() if rng.random() < 0.2 else noisy(rng, words), "subject_names": rng.choice([None, [], ["a b"], ["b", "a", None]]), "partition": rng.choice(["p", "q", None])})
    rows += [{"title": "Same text here!"}] * 3 + [{"title": "text, here same"}, {"title": None}, {"title": "?"}, {"title": "?"}, {"title": "long " * 3000}, {"title": "LONG " * 3000}, {"kind": ("other", "code"), "title": "Same text here"}]
    df = clashing(candidates(spark, rows))
    said = [(r.cand_id, (r.partition, r.kind.tag, r.kind.value), r.bag) for r in df.withColumn("bag", nearcopies.bag(F.col("title"), F.array_join(F.coalesce("subject_names", F.array().cast("array<string>")), " "), F.col("location"))).collect()]
    said = [(i, g, nearcopies.features(b)) for i, g, b in said if b and g[0]]
    expected = {(i, j) for i, g, a in said for j, h, b in said if i < j and g == h and nearcopies.jaccard(a, b) > 0.8}
    assert len(expected) > 30
    for node_rows in (nearcopies.NODE_ROWS, 4):
        monkeypatch.setattr(nearcopies, "NODE_ROWS", node_rows)
        got = [tuple(r) for r in nearcopies.candidate_copies(df).collect()]
        assert set(got) == expected and len(got) == len(expected)
    assert nearcopies.candidate_copies(df.where("false")).count() == 0


def test_repeated_words_count_in_fingerprints(spark):
    """Texts of Jaccard 0.87 whose words repeat: their sets of words agree far less than their bags."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(7))
    rows, expected = [], set()
    for i in range(40):
        few, extra = [word() for _ in range(3)], [word() for _ in range(2)]
        rows += [{"title": " ".join(few * 9 + extra[:1])}, {"title": " ".join(few * 9 + extra)}]
    a, b = (nearcopies.features(" ".join(sorted(r["title"].split()))) for r in rows[:2])
    assert nearcopies.jaccard(a, b) > 0.85
    got = {tuple(r) for r in nearcopies.candidate_copies(candidates(spark, rows)).collect()}
    assert len({(i, i + 1) for i in range(1, 80, 2)} & got) >= 39


def test_classes_carry_members_and_links(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron"
    rows = [{"title": words}, {"title": words.upper()}, {"title": words + " pi"}, {"title": "other words entirely"}, {"title": None}, {"title": words, "partition": None}]
    got = sorted(tuple(r) for r in nearcopies.candidate_classes(clashing(candidates(spark, rows))).collect())
    assert got == [(1, 1, 2, 1), (2, 1, 2, 1), (3, 3, 1, 1), (4, 4, 1, 0)]
    assert nearcopies.candidate_classes(candidates(spark, rows).where("false")).count() == 0


def test_large_classes_of_copies_come_out_as_stars(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "SHOWN", 3)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron"
    rows = [{"title": words}] * 6 + [{"title": words + "!"}, {"title": words + " pi"}, {"title": "pi " + words}]
    got = {tuple(r) for r in nearcopies.candidate_copies(candidates(spark, rows)).collect()}
    assert got == {(1, i) for i in range(2, 8)} | {(8, 9)} | {(1, 8), (1, 9)}


def test_large_classes_come_out_in_all_pairs(spark, monkeypatch):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron".split()
    rng = random.Random(9)
    spelled = lambda more: [{"title": rng.choice([" ", ", "]).join(rng.sample(words + more, len(words + more)))} for _ in range(70)]
    rows = [{"title": " ".join(words)}] * 70 + spelled([]) + spelled(["pi"]) + [{"title": " ".join([*words, "rho"])}]
    expected = {(i, j) for j in range(1, len(rows) + 1) for i in range(1, j)}
    for size in (nearcopies.SLICE, 16):
        monkeypatch.setattr(nearcopies, "SLICE", size)
        got = [tuple(r) for r in nearcopies.candidate_copies(candidates(spark, rows)).collect()]
        assert set(got) == expected and len(got) == len(expected)


def test_trie_walk_finds_every_pair_in_the_budget():
    rng = np.random.default_rng(3)
    values = np.sort(rng.integers(0, 1 << nearcopies.BITS, 3000).astype(np.uint32))
    values[100:140] = values[100] ^ (1 << rng.integers(0, nearcopies.BITS, 40)).astype(np.uint32)
    values.sort()
    distance = np.bitwise_count(values[:, None] ^ values[None, :])
    expected = {(i, j) for i, j in zip(*np.nonzero(np.triu(distance <= nearcopies.ERRORS, 1)), strict=True)}

    def check(i, j):
        keep = np.bitwise_count(values[i] ^ values[j]) <= nearcopies.ERRORS
        return i[keep], j[keep]

    found = [(min(a, b), max(a, b)) for i, j in nearcopies.trie_join(values, None, 0, check) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(found) == len(set(found)) and set(found) == expected
    half = nearcopies.trie_join(values[:1500], values[1500:], 0, lambda i, j: (i[k := np.bitwise_count(values[i] ^ values[1500 + j]) <= 2], j[k]))
    assert {(a, b + 1500) for i, j in half for a, b in zip(i.tolist(), j.tolist(), strict=True)} == {(a, b) for a, b in expected if a < 1500 <= b}


def test_fingerprint_bits_estimate_jaccard():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(7)) for _ in range(40)]
    a, b = " ".join(sorted(words[:22])), " ".join(sorted(words[2:24]))
    signs = nearcopies.fingerprints([a, b, b, "q" * 50_000 + " z"])
    apart = int(np.bitwise_count(signs[0] ^ signs[1]).sum()) / (nearcopies.TRIES * nearcopies.BITS)
    grams = [{t for w in x.split() for t in (f" {w} "[i : i + 3] for i in range(len(w)))} for x in (a, b)]
    assert abs(apart - (1 - nearcopies.jaccard(*map(frozenset, grams))) / 2) < 0.09 and (signs[1] == signs[2]).all()


# ------------------------------------------------------------------ 5


@pytest.mark.parametrize(("entries", "every"), [(1 << 20, 4), (8, 1)])
def test_repeated_matches_brute_force(spark, entries, every, monkeypatch):
    if entries < 100:
        monkeypatch.setattr(incremental, "PAGE", 2)
    rng = random.Random(9)
    subjects = ["pkg:pypi/A_b@1", "pkg:pypi/a-b@1", "pkg:PYPI/a-b@2", "cpe:/a:V:p:1", "cpe:2.3:a:v:p:1:*:*:*:*:*:*:*", "pkg:deb/d/x@1?b=2&A=1", "pkg:deb/d/x@1?a=1&b=2", "nonsense", None]
    issues = ["cve-1", "CVE-1 ", "ADV-x", "adv-x", " ", None]

    def rows(n, first):
        for i in range(n):
            yield {
                "cand_id": first + i,
                "partition": rng.choice(["p", "q", "q", "q", None]),
                "kind": rng.choice([("code", None), ("code", None), ("other", "code"), ("other", None)]),
                "issue_ids": rng.choice([None, [], *[[rng.choice(issues), rng.choice(issues)]] * 6]),
                "subject_ids": rng.choice([None, *[[rng.choice(subjects), rng.choice(subjects)]] * 5]),
                "batch_no": rng.choice([1, 2, 3, 7, None]),
            }

    old, new = list(rows(25, 1)), list(rows(120, 1000))
    history = clashing(candidates(spark, old))
    incoming = clashing(candidates(spark, new, "batch_no int"))
    fold = lambda i: i.strip().upper() if i.strip().upper().startswith("CVE-") else i.strip()

    def keys(r):
        if r["partition"] is None:
            return set()
        return {(r["partition"], r["kind"], fold(i), names_of(s)[0]) for i in r["issue_ids"] or () if i and i.strip() for s in r["subject_ids"] or () if s and names_of(s)}

    accepted = [(-1, r) for r in old] + [(r["batch_no"] or 10**9, r) for r in new]
    expected = {}
    for r in new:
        hits = [a["cand_id"] for b, a in accepted if b < (r["batch_no"] or 10**9) and keys(a) & keys(r)]
        if hits:
            expected[r["cand_id"]] = min(hits)
    got = incremental.repeated(history, incoming, range_entries=entries, compact_every=every).collect()
    assert dict(got) == expected and len(got) == len(expected) > 10
    assert incremental.repeated(history.where("false"), incoming.where("false")).count() == 0
    assert incremental.repeated(history, incoming.where("false")).count() == 0
    assert dict(incremental.repeated(history.where("false"), incoming.where("batch_no = 1")).collect()) == {}


def test_runs_are_opened_again_and_read_in_part(spark, tmp_path):
    rows = [{"cand_id": i, "partition": f"p{i % 40:02}", "issue_ids": [f"I-{i % 1000:04}"], "subject_ids": [f"pkg:deb/d/x{i % 77}@1"]} for i in range(1, 4001)]
    folder = f"file://{tmp_path}/runs"
    incremental.repeated(candidates(spark, rows), candidates(spark, [], "batch_no int"), range_entries=200, folder=folder)
    runs = incremental.SortedRuns.open(spark, folder)
    assert len(runs.state["splits"]) > 10 and runs.state["runs"][0][1] > 3000
    new = [dict(r, cand_id=10_000 + i) for i, r in enumerate(rows[5:4000:800])] + [dict(rows[0], cand_id=11_000, issue_ids=["new"])]
    scratch = incremental.Scratch(spark, "again")
    keyed = scratch.write(incremental.exact_keys(candidates(spark, new), "cand_id"), "batch")
    name = runs.write(keyed.groupBy("key").agg(F.min("cand_id").alias("first_id"), F.count("*").alias("n")))
    assert runs.around(name).count() <= 6 * incremental.PAGE  # a few pages of 4,000 entries
    got = dict(incremental.add_batch(runs, keyed, keyed.count(), scratch, "x").collect())
    assert got == {10_000 + i: r["cand_id"] for i, r in enumerate(rows[5:4000:800])}
    again = incremental.SortedRuns.open(spark, folder)  # the batch is history for the next job
    late = incremental.exact_keys(candidates(spark, [dict(new[-1], cand_id=12_000)]), "cand_id")
    assert dict(incremental.add_batch(again, late, 1, scratch, "y").collect()) == {12_000: 11_000}


def test_near_repeats_are_found_in_windows(spark, monkeypatch):
    monkeypatch.setattr(incremental, "PAGE", 16)
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    told = [rng.sample(vocabulary, 14) for _ in range(300)]
    base = lambda i: {"partition": f"p{i % 3}", "issue_ids": [f"I{i % 20}"], "subject_ids": [f"pkg:a/b{i % 7}@{i % 3}"]}
    old = [base(i) | {"cand_id": i + 1, "title": " ".join(w)} for i, w in enumerate(told)]
    old += [{"cand_id": 900, "title": None}, {"cand_id": 901, "title": "?"}]
    new = [base(i) | {"cand_id": 1000 + i, "title": noisy(rng, told[i]), "batch_no": rng.choice([1, 2, None])} for i in range(0, 300, 2)]
    new += [base(i) | {"cand_id": 2000 + i, "title": noisy(rng, told[i]), "batch_no": 9} for i in range(1, 300, 5)]
    history, incoming = clashing(candidates(spark, old)), clashing(candidates(spark, [{"title": None} | r for r in new], "batch_no int"))
    text = lambda r: " ".join(sorted(r["title"].lower().replace("-", " ").split()))
    order = lambda r: r.get("batch_no") or 10**9
    said = [(r, nearcopies.features(text(r)), -1 if r["cand_id"] < 1000 else order(r)) for r in old[:300] + new]
    pairs = {}
    for r, f, b in said:
        if b >= 0:
            near = {o["cand_id"] for o, g, c in said if c < b and o["partition"] == r["partition"] and nearcopies.jaccard(f, g) > 0.8}
            if near:
                pairs[r["cand_id"]] = near
    got = dict(incremental.nearly_repeated(history, incoming, range_entries=100).collect())
    assert all(got[i] in pairs[i] for i in got)
    assert len(pairs) > 100 and len(got) >= 0.9 * len(pairs)
    assert incremental.nearly_repeated(history.where("false"), incoming.where("false")).count() == 0


# ------------------------------------------------------------------ 6


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def texts(n, seed=0):
    rng = random.Random(seed)
    words = ["harbour", "ladder", "the", "repairs", "with", "council", "winter", "Bretagne", "naïve", "."]
    return [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, ""]) if rng.random() < 0.02 else " ".join(rng.choice(words) for _ in range(int(rng.paretovariate(1) * 5)))) for i in range(n)]


def test_packing_is_whole_and_tight(spark):
    rows = texts(1500) + [(5000, "a", "same text"), (5001, "a", "same text"), (5002, "a", "harbour " * 3000)]
    df = clashing(documents(spark, rows).repartition(3))
    kinds = spark.createDataFrame([("s", 64), ("m", 512), ("none", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    out = packing.packed(df, kinds).toPandas()
    size = {i: len(encoder(VOCABULARY).encode_ordinary(t)) for i, _, t in rows if t is not None}
    for kind, capacity in (("s", 64), ("m", 512)):
        part = out[out.container_kind == kind]
        assert part.groupby("doc_id").n_tokens.sum().to_dict() == size
        assert part.groupby("container_id").n_tokens.sum().max() <= capacity
        pieces = part.groupby("doc_id").size().to_dict()
        assert all(pieces[i] == max(-(-n // capacity), 1) for i, n in size.items())
        filled = part.groupby("container_id").n_tokens.sum()
        assert filled.sum() / (len(filled) * capacity) > 0.95
    assert set(out.container_kind) == {"s", "m"}
    report = {r["container_kind"]: r for r in packing.fill(packing.packed(df, kinds), kinds).collect()}
    assert report["s"]["tokens"] == sum(size.values()) and report["s"]["fill_share"] > 0.95
    assert packing.packed(df.where("false"), kinds).count() == packing.packed(df, kinds.where("false")).count() == 0


def test_hilbert_curve_is_a_walk_through_every_cell():
    side = 1 << 3
    points = np.array([[x, y] for x in range(side) for y in range(side)])
    keys = packing.hilbert(points, 3)
    assert sorted(keys.tolist()) == list(range(side * side))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_token_counts(spark):
    got = [r[0] for r in spark.createDataFrame([("Hello world",), ("",), (None,), ("a" * 20_000,)], "x string").select(token_count(F.col("x"))).collect()]
    assert got[:3] == [2, 0, None] and got[3] == len(encoder(VOCABULARY).encode_ordinary("a" * 20_000))


# ------------------------------------------------------------------ 7


def test_mixing_meets_shares(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["big"] * 8 + ["mid"] * 3 + ["tiny", "other", None]), "harbour ladder " * rng.randint(0, 9)) for i in range(3000)]
    df = clashing(documents(spark, rows + [(9000, "big", None), (9001, "mid", "")]).repartition(3))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 6), ("absent", 0.2, 3), ("never", None, 1), (None, 0.1, 1), ("mid", 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(df, targets, shard_tokens=2000)
    got = mix.toPandas()
    used = got.groupby(["source", "doc_id"]).size()
    assert {s: used[s].max() for s in ("big", "mid", "tiny")}["big"] == 1 and used["mid"].max() <= 2 and used["tiny"].max() <= 6
    assert got.groupby(["source", "doc_id", "repeat_no"]).size().max() == 1
    share = got.groupby("source").n_tokens.sum() / got.n_tokens.sum()
    for s, want in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
        assert abs(share[s] - want) < 0.005
    have = {s: sum(len(encoder(VOCABULARY).encode_ordinary(t)) for _, x, t in rows if x == s) for s in ("big", "mid", "tiny")}
    best = min(c * have[s] / w for s, w, c in (("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 6)))
    assert got.n_tokens.sum() > 0.99 * best
    per_shard = got.groupby("shard").n_tokens.sum()
    assert len(per_shard) > 2 and got.groupby("shard").position.apply(lambda p: sorted(p) == list(range(1, len(p) + 1))).all()
    report = {r["source"]: r for r in mixing.share_report(mix, targets).collect() if r["source"]}
    assert report["absent"]["actual_share"] == 0 and abs(report["tiny"]["actual_share"] - 0.2) < 0.005 and report["tiny"]["max_used"] <= 6
    assert mixing.mixed(df.where("false"), targets).count() == mixing.mixed(df, targets.where("false")).count() == 0


def test_more_shards_than_the_tree_has_leaves(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("aab"), "harbour ladder " * rng.randint(1, 9)) for i in range(2500)]
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 2)], "source string, target_share double, max_repeats int")
    flat = mixing.mixed(documents(spark, rows), targets, shard_tokens=1000).toPandas()
    deep = mixing.mixed(documents(spark, rows), targets, shard_tokens=1000, tree_shards=4).toPandas()
    size = deep.groupby("shard").n_tokens.sum()
    assert len(size) >= 24 and size.max() < 2500 and abs(deep.n_tokens.sum() - flat.n_tokens.sum()) < 100
    assert deep.groupby(["doc_id", "repeat_no"]).size().max() == 1
    share = deep[deep.source == "a"].groupby("shard").n_tokens.sum() / size
    assert abs(share.mean() - 0.6) < 0.05 and share.std() < 0.2


def test_splitting_tree_is_exact_and_fair():
    quotas = np.array([1000, 10, 3, 0])
    drawn = mixing.split_tree(quotas, 7, np.random.default_rng(0))
    assert (drawn.sum(0) == quotas).all() and (drawn >= 0).all() and np.ptp(drawn.sum(1)) <= 1
    mean = np.mean([mixing.split_tree(np.array([30, 10]), 4, np.random.default_rng(i))[:, 1] for i in range(400)], axis=0)
    assert np.allclose(mean, 2.5, atol=0.3)


# ------------------------------------------------------------------ 8


NOUNS = ["harbour", "ladder", "council", "engine", "lantern", "baker", "bridge", "kettle", "report", "mill"]
VERBS = ["repairs", "moves", "paints", "finds", "closes", "needs"]
ENDS = ["in spite of the rain", "before sunrise", "with great patience", "at the end of the month"]


def sentence(rng):
    s = f"The {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)}"
    return s + rng.choice(["", " " + rng.choice(ENDS)])


def test_truncation(spark):
    rng = random.Random(5)
    rows, cut = [], set()
    for i in range(1500):
        text = " ".join(sentence(rng) + rng.choice(".....!?…") for _ in range(rng.randint(1, 8)))
        source = rng.choice(["free", "limited"])
        if source == "limited" and len(text) > 200:
            if text[199] not in ".!?… " and text[:200] != text:
                cut.add(i)
            text = text[:200]
            if text[-1] == " " and text[-2] not in ".!?…":
                cut.add(i)
        elif source == "free" and rng.random() < 0.1:
            end = rng.randint(len(text) // 2, len(text) - 3)
            if text[end - 1] not in ".!?… " and text[end] != ".":
                text = text[:end]
                cut.add(i)
        elif rng.random() < 0.1:
            text += rng.choice([" [12]", " (rev.)", " </seg>", " –– Lomun", " ☂"])
        rows.append((i, source, text))
    whole = ["The harbour and the ladder", "31. The mill", "237 days", "The bridge – Pepok", "The kettle before sunrise [4]", "", None, "The mill" + " " * 100_000 + "moves the engine. " + "#" * 100_000 + " The mill closes the engine."]
    rows += [(10_000 + i, "free", t) for i, t in enumerate(whole)] + [(20_000, None, "The harbour repairs the ladder before"), (20_001, None, "The harbour repairs the ladder before"), (20_002, "free", "The mill closes the brid…")]
    cut |= {20_000, 20_001, 20_002}
    df = clashing(documents(spark, rows))
    got = {r[0] for r in truncation.truncated(df).collect()}
    sure = {i for i in cut if i >= 10_000}
    assert sure <= got and not {10_000 + i for i in range(len(whole))} & got
    assert len(got & cut) / len(cut) > 0.9 and len(got & cut) / len(got) > 0.9
    rates = {r["source"]: r for r in truncation.truncation_rates(df).collect()}
    assert rates[None]["share"] == 1.0 and rates["free"]["n_truncated"] == sum(1 for i, s, _ in rows if s == "free" and i in got)
    assert truncation.truncated(df.where("false")).count() == 0


def test_truncation_does_not_depend_on_the_size_of_the_corpus(spark):
    rng = random.Random(6)
    rows = [(i, "free", " ".join(sentence(rng) + "." for _ in range(rng.randint(1, 6)))) for i in range(400)]
    cut = {1000 + i: f"The mill closes the {w}" for i, w in enumerate(["brid…", "brid…", "brid…", "brid… …", "brid. . .", "brid", "ladd", "ladd", "ladd"])}
    whole = {2000: "The mill closes the bridge…", 2001: "The ladder", 2002: "The ladder and the mill"}
    rows += [(i, "free", t) for i, t in (cut | whole).items()]
    # the fragment inside of texts, as rarely as stray words are
    rows += [(3000 + i, "free", f"The bridge moves the {w} before sunrise. The mill closes the engine.") for i, w in enumerate(["brid", "ladd"])]
    once = {r[0] for r in truncation.truncated(documents(spark, rows)).collect()}
    assert cut.keys() - {1004} <= once and not whole.keys() & once
    many = {r[0] for r in truncation.truncated(documents(spark, [(i + 10_000 * k, s, t) for i, s, t in rows for k in range(6)])).collect()}
    assert many == {i + 10_000 * k for i in once for k in range(6)}


def test_texts_cut_inside_long_words(spark):
    rng = random.Random(7)
    word = "harbour" * 20
    rows = [(i, "free", " ".join(sentence(rng) + "." for _ in range(rng.randint(1, 6)))) for i in range(400)]
    rows += [(1000 + i, "free", f"The mill moves the {word}" + (" before sunrise." if i % 4 else ".")) for i in range(20)]
    cut = {2000: f"The mill and the {word[:30]}", 2001: f"The mill and the {word[:70]}", 2002: f"The mill and the {word[:139]}", 2003: f"The mill closes the {word[:100]}…"}
    whole = {3000: f"The mill and the {word}", 3001: f"The mill and the {word[:80]}x"}
    got = {r[0] for r in truncation.truncated(documents(spark, rows + [(i, "free", t) for i, t in (cut | whole).items()])).collect()}
    assert cut.keys() <= got and not whole.keys() & got


def test_censored_fit_recovers_the_limits():
    rng = np.random.default_rng(0)
    natural = np.exp(rng.normal(4.5, 0.8, 40_000)).astype(int) + 1
    way = rng.random(len(natural))
    lengths = np.where((natural > 120) & (way < 0.5), 120, np.where((natural > 200) & (way > 0.8), 200, natural))
    values, counts = np.unique(lengths, return_counts=True)
    mu, sigma, parts, posteriors, gain = truncation.censored_fit(values, counts, [120, 200])
    assert abs(mu - 4.5) < 0.05 and abs(sigma - 0.8) < 0.05 and abs(parts[0] - 0.5) < 0.05 and abs(parts[1] - 0.2) < 0.05 and gain > 100
    assert (posteriors > 0.9).all()
    alone = truncation.censored_fit(values, counts, [120])
    assert gain > alone[-1]  # both limits explain the lengths better than one


def test_length_decides_where_endings_do_not(spark):
    """Lists without a predicate look like headings wherever they end: only a limit's length tells the cut ones."""
    rng = random.Random(3)
    rows, cut = [], set()
    for i in range(3000):
        source = rng.choice(["limited", "free"])
        line = f"The {rng.choice('abcdefghijk') * rng.randint(1, 9)} " + " and the ".join(rng.choice(NOUNS) for _ in range(rng.randint(2, 9)))
        if source == "limited" and len(line) > 60:
            line = line[:60]
            cut.add(i)
        rows.append((i, source, line))
    rows += [(10_000 + i, "free", " ".join(sentence(rng) + "." for _ in range(3))) for i in range(1500)]
    got = {r["doc_id"]: r for r in truncation.judged(documents(spark, rows)).collect()}
    heads = {i for i in range(3000) if got[i]["kind"] == "heading"}
    found = {i for i in heads if got[i]["score"] > 0}
    # a line of exactly the limit's length, or one less, cannot be told from a cut one
    assert len(cut & heads) > 200 and cut & heads <= found and all(len(rows[i][2]) in (59, 60) and rows[i][1] == "limited" for i in found)
    assert all(got[i]["by_ending"] <= 0 for i in found)  # the ending alone would let them pass


def test_a_source_that_never_cuts_lowers_a_weak_ending(spark):
    """Whole sentences end in an ellipsis now and then; behind a torn text it is a mark of the cut."""
    rng = random.Random(4)
    whole = lambda end="": " ".join(sentence(rng) + rng.choice(".......…") for _ in range(3)) + end
    rows = [(i, "torn", whole()[: rng.randint(20, 60)].rstrip(".… ") + "…") for i in range(400)] + [(1000 + i, "torn", whole()) for i in range(100)]
    rows += [(5000 + i, "clean", whole()) for i in range(1500)]
    got = {r["doc_id"]: r for r in truncation.judged(documents(spark, rows)).collect()}
    assert all(r["score"] <= 0 for i, r in got.items() if i >= 5000)
    torn = [got[i] for i in range(400) if got[i]["kind"] == "ellipsis"]
    assert len(torn) > 50 and all(r["score"] > 0 for r in torn)
