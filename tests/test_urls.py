import random

import pytest
from pyspark.sql import functions as F

from pagewarden.functions import whatwg
from pagewarden.functions.hosts import DEFAULT_RULES, SuffixRules, is_ip_host, suffix
from pagewarden.functions.homoglyphs import alignment_distance, fold, fold_text
from pagewarden.functions.membership import Membership, best_bits, best_hashes, fnv1a
from pagewarden.functions.urls import feed_url, typed_url, with_url_parts

GOOD = [
    ("https://example.org/", "example.org", "example.org", [], False, False, ""),
    ("http://shop.example.org/a?b=%2Fc&d=1", "shop.example.org", "example.org", ["shop"], False, False, ""),
    ("https://x.y.z.firm.co.uk/q", "x.y.z.firm.co.uk", "firm.co.uk", ["x", "y", "z"], False, False, ""),
    ("https://dots.example../", "dots.example", "dots.example", [], False, False, ""),
    ("https://LOUD.Example/Path", "loud.example", "loud.example", [], False, False, ""),
    ("https://me:secret@example.org/", "example.org", "example.org", [], False, False, ""),
    ("https://example.org:8443/", "example.org", "example.org", [], False, False, "8443"),
    ("https://example.org:443/", "example.org", "example.org", [], False, False, ""),
    ("http://10.0.0.1/in", "10.0.0.1", "10.0.0.1", [], True, False, ""),
    ("http://[::1]:8080/", "[::1]", "[::1]", [], True, False, "8080"),
    ("https://müller.de/", "xn--mller-kva.de", "xn--mller-kva.de", [], False, True, ""),
    ("https://someone.github.io/", "someone.github.io", "someone.github.io", [], False, False, ""),
    ("https://in.bank.co.nz/", "in.bank.co.nz", "bank.co.nz", ["in"], False, False, ""),
]
BAD = ["about:blank", "chrome://settings", "file:///etc/passwd", "data:text/html,x", "javascript:void(0)", "ftp://example.org/f", "no url", "", "https://", "https://.../", None]


@pytest.mark.parametrize("general", [True])
def test_parts(spark, general):
    rows = [(k, u) for k, u in enumerate([g[0] for g in GOOD] + BAD)]
    out = with_url_parts(spark.createDataFrame(rows, "k int, url string"), general=general).orderBy("k").collect()
    for r, (_, host, etld1, labels, ip, puny, port) in zip(out, GOOD, strict=False):
        p = r["parts"]
        assert (p["host"], p["etld1"], p["labels"], p["is_ip"], p["is_punycode"], p["port"]) == (host, etld1, labels, ip, puny, port), r
    assert all(r["parts"] is None for r in out[len(GOOD) :])


def test_both_parsers_agree(spark):
    rng = random.Random(5)
    pieces = ["http://", "https://", "a", "b.c", "example", ".com", "/", "//", "..", ".", "?", "&", "=", "#", ":80", ":81", "%2e", "%41", "~", "x y", "@", "'", "|", "^", "[", "{", "7", ".8"]
    urls = ["http://" + "".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))) for _ in range(600)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for r in with_url_parts(df).collect():
        u, p = whatwg.parse(r["url"]), r["parts"]
        host = u.host.rstrip(".") if u else ""
        if not host:
            assert p is None, r
        else:
            assert (p["scheme"], p["host"], p["port"], p["path"], p["search"]) == (u.scheme, host, u.port, u.path, u.search), r
            assert p["is_ip"] == is_ip_host(host) and p["etld1"] == DEFAULT_RULES.registrable(host), r


def test_suffix_lists(spark):
    """Rules of a public suffix list: plain, any label, exceptions, and the private section."""
    text = "// ===BEGIN ICANN DOMAINS===\ncom\nuk\nco.uk\nck\n*.ck\n!www.ck\njp\nkobe.jp\n*.kawasaki.jp\n!city.kawasaki.jp\n公司.cn\n\n// ===END ICANN DOMAINS===\n// ===BEGIN PRIVATE DOMAINS===\ngithub.io\n*.compute.example.com\n// ===END PRIVATE DOMAINS===\n"
    rules = SuffixRules.from_list(text)
    cases = {"a.b.co.uk": "co.uk", "x.y.ck": "y.ck", "www.ck": "ck", "a.www.ck": "ck", "ck": "ck", "b.kobe.jp": "kobe.jp", "c.d.kawasaki.jp": "d.kawasaki.jp", "city.kawasaki.jp": "kawasaki.jp", "kawasaki.jp": "jp", "u.github.io": "github.io", "q.r.compute.example.com": "r.compute.example.com", "compute.example.com": "com", "z.unlisted": "unlisted", "x.xn--55qx5d.cn": "xn--55qx5d.cn"}
    got = spark.createDataFrame([(h,) for h in cases], "h string").select("h", suffix(F.col("h"), rules), suffix(F.col("h"), rules, with_private=False)).collect()
    assert {r[0]: r[1] for r in got} == cases == {h: rules.suffix_of(h) for h in cases}
    assert all(r[2] == rules.suffix_of(r[0], with_private=False) for r in got)
    assert {"com", "uk", "jp", "cn"} <= rules.top and "io" not in rules.top and rules.registrable("a.www.ck") == "www.ck"


def test_relative_references():
    base = whatwg.parse("https://a.example/x/y?z")
    for ref, want in [("p", "https://a.example/x/p"), ("/p", "https://a.example/p"), ("//b.example", "https://b.example/"), ("?q", "https://a.example/x/y?q"), ("", "https://a.example/x/y?z"), ("../../p", "https://a.example/p"), ("\\\\c.example\\p", "https://c.example/p")]:
        assert whatwg.parse(ref, base).href == want
    assert whatwg.parse("mailto:a@b", base) is None


def test_feed_and_typed(spark):
    df = spark.createDataFrame([(u,) for u in ["HTTP://Example.org", " https://u:p@example.org:443/a?b#c ", "http://example.org:8080/x", "ftp://a/b", "http:///x", "", None]], "u string")
    assert [r[0] for r in df.select(feed_url(F.col("u"))).collect()] == ["http://example.org/", "https://example.org/a?b", "http://example.org:8080/x", None, None, None, None]
    assert df.select(feed_url(F.col("u"), keep_port=False)).collect()[2][0] == "http://example.org/x"
    typed = spark.createDataFrame([("example.org",), ("  http://Example.org/a",), ("",), ("a b",)], "u string")
    assert [r[0] for r in typed.select(typed_url(F.col("u"))).collect()] == ["https://example.org/", "http://example.org/a", None, None]


def test_folding_and_distance(spark):
    pairs = [("micr0soft", "microsoft"), ("rnodel", "model"), ("VVeb", "web"), ("s3cur3", "secure"), ("plain", "plain")]
    assert [fold_text(a) for a, _ in pairs] == [b for _, b in pairs]
    assert [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(fold(F.col("a"))).collect()] == [b for _, b in pairs]
    assert [alignment_distance(*p) for p in [("ab", "ba"), ("ca", "abc"), ("sitting", "kitten"), ("", "abc"), ("x", "x")]] == [1, 3, 3, 3, 0]


def test_membership(spark):
    known = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "v string").select(fnv1a(F.col("v"))).collect()
    assert [r[0] for r in known] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968, None]
    h = 0x811C9DC5
    for b in "bücher\0梦".encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    assert spark.createDataFrame([("bücher\0梦",)], "v string").select(fnv1a(F.col("v"))).first()[0] == h
    assert (best_bits(50_000, 0.01), best_hashes(479_253, 50_000)) == (479_253, 7)
    inside = spark.range(400).select(F.concat(F.lit("in-"), "id").alias("domain"))
    m = Membership.build(inside)
    again = Membership.from_bytes(m.to_bytes())
    assert again == m
    assert inside.filter(~again.contains(F.col("domain"))).isEmpty()
    outside = spark.range(1000).select(F.concat(F.lit("out-"), "id").alias("domain"))
    assert outside.filter(again.contains(F.col("domain"))).count() <= 30
    joined = again.marked(inside.unionByName(outside).unionByName(spark.createDataFrame([(None,)], "domain string")), "domain", "listed", constant_bits=0)
    assert joined.count() == 1401 and joined.filter(F.col("listed") != again.contains(F.col("domain"))).isEmpty()
    for raw in (b"TBLM", b"XXXX" + m.to_bytes()[4:], m.to_bytes()[:-1]):
        with pytest.raises(ValueError, match="cut short|not a TBLM"):
            Membership.from_bytes(raw)
