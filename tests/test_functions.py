import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coalis.config import Config, ConfigError
from coalis.functions.blake3 import IV, derive_keys, digests
from coalis.functions.cpe import parse_cpe
from coalis.functions.keys import NEUTRAL, contexts, correlation_keys, key_bytes, occurrence_key, parse_key
from coalis.functions.purl import IdentityError, parse_purl
from coalis.functions.similarity import lcs, normal_text, score_of, similarity, with_similarity
from coalis.functions.subjects import parse_subject, parse_subjects, subject_names
from coalis.functions.text import normalize_issue, normalize_issues


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


# ------------------------------------------------------------------ BLAKE3 and keys


def test_blake3_published_digests():
    assert digests([b""], IV, 0)[0].hex().startswith("af1349b9f5f9a1a6a0404dea36dcc949")
    pattern = lambda n: bytes(i % 251 for i in range(n))
    assert digests([pattern(2049)], IV, 0)[0].hex().startswith("5f4d72f40d7a5f82b15ca2b2e44b1de3")
    assert digests([pattern(3073)], IV, 0)[0].hex().startswith("7124b49501012f81cc7f11ca069ec922")


def test_blake3_batch_is_message_by_message():
    rng = random.Random(1)
    data = [rng.randbytes(n) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 5000, 64, 10_000)]
    assert derive_keys("c", data) == [derive_keys("c", [d])[0] for d in data]


def test_key_golden_vectors(spark):
    df = spark.createDataFrame(
        [("global", ("vulnerability", None), "scanner", None, "42", ["CVE-2024-1"], ["subject:purl:v1:pkg:cargo/widget@1.0.0"])],
        "p string, kind struct<tag:string,value:string>, s string, t string, n string, i array<string>, f array<string>",
    )
    row = df.select(
        occurrence_key(F.col("p"), F.col("kind"), F.col("s"), F.col("t"), F.col("n")).alias("o"), correlation_keys(F.col("p"), F.col("kind"), F.col("i"), F.col("f")).alias("c")
    ).first()
    assert row["o"] == "occ:v1:450c326009b8cd7997128cb8dec1198ffc90c42a71bb588b31d598ed08cd17a4"
    assert row["c"] == ["corr:v1:424a766e50abab734784726f6e678f9d4b938cc9fcaa8c6e8fec562637698ae2"]
    assert set(contexts()) == set(NEUTRAL) and len(set(contexts().values())) == 2


def test_issue_only_keys_need_the_option_and_no_subject(spark):
    df = spark.createDataFrame([("p", ("code", None), ["B", "A"], [])], "p string, kind struct<tag:string,value:string>, i array<string>, f array<string>")
    off, on = df.select(correlation_keys(F.col("p"), F.col("kind"), F.col("i"), F.col("f")), correlation_keys(F.col("p"), F.col("kind"), F.col("i"), F.col("f"), True)).first()
    assert off == [] and len(on) == 2 and on == sorted(on)


def test_custom_kind_is_not_the_built_in(spark):
    rows = [("p", ("vulnerability", None), "s", None, "1"), ("p", ("other", "vulnerability"), "s", None, "1")]
    df = spark.createDataFrame(rows, "p string, kind struct<tag:string,value:string>, s string, t string, n string")
    keys = df.select(occurrence_key(*[F.col(c) for c in ("p", "kind", "s", "t", "n")])).collect()
    assert keys[0] != keys[1]


def test_parse_key(spark):
    good = "occ:v1:" + "AB" * 32
    rows = column(spark, [good, "corr:v1:" + "ab" * 32, "occ:v1:xyz", None]).select(parse_key(F.col("x")).alias("k"), key_bytes(F.col("x")).alias("b")).limit(2).collect()
    assert rows[0]["k"]["key"] == good.lower() and bytes(rows[0]["b"]) == b"\xab" * 32
    errors = [r["k"]["error"] for r in column(spark, [good, "corr:v1:ab", "occ:v1:xyz"]).select(parse_key(F.col("x")).alias("k")).collect()]
    assert errors == [None, "Prefix", "Digest"]


# ------------------------------------------------------------------ text


@pytest.mark.parametrize(
    ("text", "normal"),
    [(" \tHeap-read:  libTiff?? ", "heap read libtiff"), ("ÑANDÚ über-früh", "ñandú über früh"), ("ǅvor_lamp", "ǆvor lamp"), ("!!!", ""), ("ΟΔΟΣ", "οδοσ"), ("", ""), (None, None)],
)
def test_normal_text(spark, text, normal):
    assert column(spark, [text]).select(normal_text(F.col("x"))).first()[0] == normal


def test_similarity_forms_agree(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n)).strip() or "a"
    pairs = [(word(n), word(m)) for n in (1, 5, 20, 61, 62) for m in (1, 30, 62, 63, 200)] + [("", "a"), ("lamp mill", "mill kit"), ("lamp", "lamp")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [score_of(a, b) for a, b in pairs]
    long = [(word(n), word(m)) for n in (80, 130) for m in (90, 400)] + pairs
    scored = with_similarity(spark.createDataFrame(long, "a string, b string"), "a", "b", "s").collect()
    assert sorted((r["a"], r["b"], r["s"]) for r in scored) == sorted((a, b, score_of(a, b)) for a, b in long)
    with pytest.raises(Exception, match="more than 62"):
        spark.createDataFrame(long, "a string, b string").select(similarity(F.col("a"), F.col("b"))).collect()


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=20), st.text("abc", max_size=20))
def test_lcs_is_the_textbook_one(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert lcs(a, b) == table[-1][-1] and score_of(a, b) == score_of(b, a)


def test_similarity_of_known_texts():
    assert score_of("lamp mill", "lamp mill kit") == 8182 and score_of("lamp", "mill") == 2500


def test_issues(spark):
    values = [" cve-2024-1\n", "Ghsa-x", "ADV-Mixed", "  ", None, "a\u0007b", "rustsec-1 "]
    got = [r[0] for r in column(spark, values).select(normalize_issue(F.col("x"))).collect()]
    assert got == ["CVE-2024-1", "GHSA-X", "ADV-Mixed", None, None, None, "RUSTSEC-1"]
    lists = spark.createDataFrame([(["b", " B", "b", None],), (None,)], "x array<string>").select(normalize_issues(F.col("x"))).collect()
    assert [r[0] for r in lists] == [["B", "b"], []]


# ------------------------------------------------------------------ identifiers


@pytest.mark.parametrize(
    ("raw", "canonical", "coordinate"),
    [
        ("pkg:GitHub/Mill-Works/Lamp-Kit@3?Os=x&abi=y", "pkg:github/mill-works/lamp-kit@3?abi=y&os=x", "pkg:github/mill-works/lamp-kit"),
        ("pkg:PyPi/Lamp_Kit_Two@7", "pkg:pypi/lamp-kit-two@7", "pkg:pypi/lamp-kit-two"),
        ("pkg:npm/%40mill/lamp@0.9", "pkg:npm/%40mill/lamp@0.9", "pkg:npm/%40mill/lamp"),
        ("pkg:npm/@mill/lamp@0.9", "pkg:npm/%40mill/lamp@0.9", "pkg:npm/%40mill/lamp"),
        ("pkg:deb/ubuntu/lampd@4-1?suite=noble&epoch=2#usr/bin", "pkg:deb/ubuntu/lampd@4-1?epoch=2&suite=noble#usr/bin", "pkg:deb/ubuntu/lampd"),
    ],
)
def test_purl_canonical(raw, canonical, coordinate):
    p = parse_purl(raw)
    assert (p["canonical"], p["coordinate"]) == (canonical, coordinate)
    assert parse_purl(canonical) == p


@pytest.mark.parametrize(
    ("raw", "code", "detail", "position"),
    [
        ("pkg:generic/la%4gmp@1", "InvalidPercentEscape", None, 14),
        ("pkg:generic/lamp@", "EmptyPurlVersion", None, None),
        ("pkg:generic/lamp?abi=", "EmptyPurlQualifierValue", "abi", None),
        ("pkg:generic/lamp?abi", "InvalidPurlQualifier", "abi", None),
        ("pkg:generic/lamp?abi=1&ABI=2", "DuplicatePurlQualifier", "abi", None),
        ("pkg:generic/lamp?x=1?y=2", "InvalidPurl", None, None),
        ("pkg:cargo/mill/lamp", "InvalidPurl", None, None),
    ],
)
def test_purl_errors(raw, code, detail, position):
    with pytest.raises(IdentityError) as e:
        parse_purl(raw)
    assert e.value.code == code and (detail is None or e.value.detail == detail) and e.value.position == position


@pytest.mark.parametrize(
    ("raw", "canonical"),
    [
        (r"cpe:2.3:a:mill:lamp\:kit\\two:9:*:*:*:*:*:*:*", None),
        ("cpe:2.3:o:mill:lamp:??4??:*:*:*:*:*:*:*", None),
        ("cpe:2.3:h:MILL:LampKit:B2:*:*:*:*:*:*:*", "cpe:2.3:h:mill:lampkit:b2:*:*:*:*:*:*:*"),
        ("cpe:/a:microsoft:internet_explorer:8.%02:sp%01", "cpe:2.3:a:microsoft:internet_explorer:8.*:sp?:*:*:*:*:*:*"),
        ("cpe:/a:microsoft:internet_explorer:8.%2a:sp%3f", r"cpe:2.3:a:microsoft:internet_explorer:8.\*:sp\?:*:*:*:*:*:*"),
        ("cpe:/a:hp:insight_diagnostics:7.4.0.1570:-:~~online~win2003~x64~", "cpe:2.3:a:hp:insight_diagnostics:7.4.0.1570:-:*:*:online:win2003:x64:*"),
    ],
)
def test_cpe_canonical(raw, canonical):
    p = parse_cpe(raw)
    assert p["canonical"] == (canonical or raw) and parse_cpe(p["canonical"])["canonical"] == p["canonical"]


@pytest.mark.parametrize(
    ("raw", "code", "component"),
    [
        ("cpe:2.3:a:mill:lamp:4*2:*:*:*:*:*:*:*", "InvalidCpeValue", 3),
        ("cpe:2.3:q:mill:lamp:4:*:*:*:*:*:*:*", "InvalidCpePart", None),
        ("cpe:2.3:O:mill:lamp:4:*:*:*:*:*:*:*", "InvalidCpePart", None),
        ("cpe:/a:mill:lamp:4:u2:e3:de:more", "LegacyCpeComponentCount", None),
        ("cpe:2.3:a:mill:lamp", "CpeComponentCount", None),
        ("cpe:2.3:a:mill:lamp:\\", "InvalidCpeEscape", 3),
        ("cpe:2.3:a:mi#ll:lamp:4:*:*:*:*:*:*:*", "InvalidCpeValue", 1),
        ("cpe:2.3:a:mill:lamp:4:*:*:german:*:*:*:*", "InvalidCpeValue", 6),
        ("urn:x", "UnsupportedCpeBinding", None),
    ],
)
def test_cpe_errors(raw, code, component):
    with pytest.raises(IdentityError) as e:
        parse_cpe(raw)
    assert (e.value.code, e.value.component) == (code, component)


def test_cpe_escaped_vendor_and_wildcards_stay_apart():
    p = parse_cpe(r"cpe:2.3:a:mill\\:lamp:4:*:*:*:*:*:*:*")
    assert p["tokens"][1] == r"mill\\" and p["name"] == "lamp"
    wild, literal = (parse_cpe(f"cpe:2.3:a:v:p:{v}:*:*:*:*:*:*:*") for v in ("8.*", r"8.\*"))
    assert wild["canonical"] != literal["canonical"] and wild["version"] == literal["version"] == "8.*"


def test_subject_columns(spark):
    rows = spark.createDataFrame([(["pkg:pypi/A_b@1", "PKG:pypi/a", None, "cpe:/a:v:p:1", "pkg:pypi/a-b@1"],), (None,), ([],)], "x array<string>")
    names = rows.select(subject_names(F.col("x")).alias("n")).collect()
    assert [[n["canonical"] for n in r["n"]] for r in names] == [["pkg:pypi/a-b@1", "cpe:2.3:a:v:p:1:*:*:*:*:*:*:*"], [], []]
    full = rows.select(F.size(parse_subjects(F.col("x")))).collect()
    assert [r[0] for r in full] == [5, 0, 0]
    assert parse_subject("PKG:pypi/a")["error_code"] == "UnsupportedSubjectId"


# ------------------------------------------------------------------ config


@pytest.mark.parametrize(
    ("kwargs", "code"),
    [({"duplicate_threshold": 10_001}, "ScoreOutOfRange"), ({"review_threshold": 9000}, "ThresholdOrder"), ({"max_block_size": 1}, "BlockSize"), ({"subject_similarity_threshold": -1}, "ScoreOutOfRange")],
)
def test_config_errors(kwargs, code):
    with pytest.raises(ConfigError) as e:
        Config(**kwargs)
    assert e.value.code == code


def test_config_json():
    assert Config.from_json(Config(max_block_size=7).to_json()) == Config(max_block_size=7)
    for bad in ("[]", "{}", Config().to_json()[:-1] + ', "more": 1}'):
        with pytest.raises(ConfigError):
            Config.from_json(bad)
