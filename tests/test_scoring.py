import math
import random
import string

import pytest
from pyspark.sql import functions as F

from pagewarden.data.brands import BRANDS, brands_from_json
from pagewarden.functions.dom import Tree, summarize
from pagewarden.functions.hosts import DEFAULT_RULES
from pagewarden.functions.text import first_brand, has_brand, term_count
from pagewarden.operators.features import FEATURES, entropy, extract_page, extract_url, vector
from pagewarden.operators.rules import RULES, Rule, noisy_or_of, score_rules
from pagewarden.operators.trees import Split, ensemble_score
from pagewarden.operators.verdicts import Settings, badge, credential_field, higher, merge, score_pages, score_urls, ui_action

LOGIN = '<html lang="en"><head><title>Sign in</title></head><body><form action="{action}"><input type="password"></form><footer>&copy; Firm</footer></body></html>'


def score(spark, rows, **options):
    df = spark.createDataFrame(rows, "url string, html string")
    return [r.asDict(recursive=True) for r in score_pages(df, **options).collect()]


def test_vector_shape(spark):
    assert len(FEATURES) == 53 == len(set(FEATURES))
    out = vector(extract_page(spark.createDataFrame([("https://example.org/", "<p>hi")], "url string, html string"))).first()
    assert len(out["features"]) == 53
    assert out["warnings"] == []


def test_url_features(spark):
    url = "https://www.ex-ample123.com:8443/a/b/c.html?x=1&y=2"
    r = extract_url(spark.createDataFrame([(url,)], "url string")).first()
    want = {"url_len": len(url), "host_len": 19, "path_len": 11, "query_len": 8, "num_dots_host": 2, "num_subdomains": 1, "num_hyphens_host": 1, "num_digits_host": 3, "num_query_params": 2, "nonstandard_port": 1, "path_depth": 3, "has_file_ext_html_php": 1, "is_https": 1}
    assert {k: r[k] for k in want} == want


@pytest.mark.parametrize(("text", "bits"), [("", 0), ("a", 0), ("aaaa", 0), ("abcd", 2), ("aabb", 1)])
def test_entropy(spark, text, bits):
    assert spark.createDataFrame([(text,)], "t string").select(entropy(F.col("t"))).first()[0] == pytest.approx(bits)


def test_lookalike(spark):
    urls = {"https://paypa1.com/": 1 / 6, "https://paypal.com/": 0, "https://www.xero.com/": 0, "https://example.com/": 1, "http://192.168.0.1/": 1, "https://zzzzzz.com/": 1, "https://123456.com/": 1, "https://paypal.co/": 0}
    out = extract_url(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    for r in out:
        assert r["brand_lookalike_host"] == pytest.approx(urls[r["url"]], abs=1e-6), r["url"]


def test_brands_in_text(spark):
    df = spark.createDataFrame([("paypal login",), ("money",), ("my paypa1 account",), ("ing bank",), ("sing",), (None,)], "t string")
    assert [r[0] for r in df.select(has_brand(F.col("t"), BRANDS)).collect()] == [True, False, True, True, False, False]
    assert df.select(first_brand(F.col("t"), BRANDS)["token"]).first()[0] == "paypal"
    assert brands_from_json('[{"token": "acme", "etld1s": ["acme.test"]}]')[0].domains == ("acme.test",)


def test_terms(spark):
    df = spark.createDataFrame([("Verify NOW, or else",), ("verify nowhere",), ("(verify now)",), ("",)], "t string")
    assert [r[0] for r in df.select(term_count(F.col("t"), ["verify now", "else"])).collect()] == [2, 0, 1, 0]


def test_tree():
    t = Tree("<title>x</title><p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e</table>")
    tags = [n.tag for n in t.html.walk() if not isinstance(n, str)]
    assert tags == ["html", "head", "title", "body", "p", "p", "ul", "li", "li", "table", "tbody", "tr", "td"]
    assert t.body.text() == "abcde"
    again = Tree("<p><b>one<p>two")
    assert [n.tag for n in again.body.walk() if not isinstance(n, str)] == ["body", "p", "b", "p", "b"]


def test_summary():
    s = summarize('<base href="https://evil.example/"><script src="a.js"></script><script>x</script><a href="#">n</a><a href="https://ok.example/">y</a><link rel="shortcut icon" href="/i">', "https://ok.example/", "ok.example", DEFAULT_RULES)
    assert (s["scripts"], s["scripts_external"], s["anchors"], s["anchors_null"], s["anchors_external"], s["icon_external"]) == (1, 1, 2, 1, 1, 1)


def test_stages_and_merge(spark):
    ip, empty, unscorable = score(spark, [("http://127.0.0.1/x", LOGIN.format(action="/in")), ("https://example.org/", ""), ("nothing", "<p>")])
    assert ip["final"]["level"] == "HIGH" and ip["stage1"]["level"] == "MEDIUM"
    assert [r["code"] for r in ip["final"]["reasons"]][:2] == ["URL_IP_HOST", "DOM_PASSWORD_ON_HTTP"]
    assert empty["stage2"] is None and empty["final"] == empty["stage1"]
    assert unscorable["final"] is None and unscorable["error"] == "unscorable url" and unscorable["features"] is None


def test_single_precision_boundaries(spark):
    html = "<html><body>" + "".join(f'<script src="https://x{k}.example/s.js"></script>' for k in range(4)) + '<script src="/own.js"></script></body></html>'
    codes = {r["code"] for r in score(spark, [("https://site.test/", html)])[0]["stage2"]["reasons"]}
    assert "DOM_EXTERNAL_SCRIPT_RATIO" in codes  # 4 of 5 is above 0.8 in single precision
    codes = {r["code"] for r in score(spark, [("https://site.test/abcd/1234/x/y/z", "")])[0]["stage1"]["reasons"]}
    assert "URL_HEX_PATH" in codes


def test_every_rule_can_fire(spark):
    """Each rule is off on a harmless vector, and its condition turns it on."""
    calm = {n: 0.0 for n in FEATURES} | {"is_https": 1.0, "in_tranco_50k": 1.0, "brand_lookalike_host": 1.0}
    loud = {"URL_BRAND_LOOKALIKE": 0.2, "URL_BRAND_LOOKALIKE_WEAK": 0.35, "URL_NOT_TRANCO": 0.0, "URL_NO_HTTPS": 0.0, "URL_LONG_HOST": 100.0}
    rows = [calm]
    for r in RULES:
        name = r.test.split()[0]
        row = calm | {name: loud.get(r.code, 5.0 if name.startswith(("num_", "phish", "urgency", "credential", "financial", "host_entropy")) else 1.0)}
        if r.code == "URL_NOT_TRANCO":
            row["brand_lookalike_host"] = 0.0
        rows.append(row)
    df = spark.createDataFrame([tuple(x[n] for n in FEATURES) for x in rows], ", ".join(f"{n} double" for n in FEATURES))
    out = df.select(*[r.fires(FEATURES).alias(r.code) for r in RULES]).collect()
    assert not any(out[0])
    for k, r in enumerate(RULES):
        assert out[k + 1][r.code], r.code


def test_own_rules(spark):
    """A rule's condition may also be a function of a reader, next to those in SQL."""
    rules = [Rule("LONG", 0.5, lambda f: f("url_len") > 5, "It's long."), Rule("SECURE", 0.25, "is_https = 1", "On {site}.")]
    row = spark.createDataFrame([(9.0, 1.0, "a.test")], "url_len double, is_https double, site string")
    for some in (rules, rules[1:]):
        score, reasons = score_rules(row.columns, "site", some)
        got = row.select(score.alias("score"), reasons.alias("reasons")).first()
        assert got["score"] == 1 - (0.5 if len(some) == 2 else 1) * 0.75
        assert [r["humanText"] for r in got["reasons"]] == ["It's long.", "On a.test."][-len(some) :]
    assert row.select(score_rules(row.columns, None, rules)[1].alias("r")).first()["r"][1]["humanText"] == "On this site."


def test_noisy_or_rises(spark):
    rng = random.Random(3)
    for _ in range(20):
        w = [rng.random() for _ in range(rng.randint(1, 6))]
        df = spark.createDataFrame([(w, w[:-1])], "a array<double>, b array<double>")
        a, b = df.select(noisy_or_of(F.col("a")), noisy_or_of(F.col("b"))).first()
        assert 0 <= b <= a <= 1
    assert spark.createDataFrame([([0.2, 0.1, 0.05],)], "w array<double>").select(noisy_or_of(F.col("w"))).first()[0] == 0.31599999999999995


def test_verdict_pieces(spark):
    v = lambda level, s: F.struct(F.lit(level).alias("level"), F.lit(s).alias("score"))
    one = spark.range(1)
    cases = [(("HIGH", 0.8), ("LOW", 0.1), "HIGH"), (("MEDIUM", 0.5), ("LOW", 0.1), "LOW"), (("MEDIUM", 0.5), ("LOW", 0.2), "MEDIUM"), (("LOW", 0.1), ("HIGH", 0.9), "HIGH")]
    for a, b, want in cases:
        assert one.select(merge(v(*a), v(*b))["level"]).first()[0] == want
    assert one.select(higher(F.lit("MEDIUM"), F.lit(None).cast("string"))).first()[0] == "MEDIUM"
    shown = [one.select(ui_action(v(lv, 0.5), F.lit(p), F.lit(d))).first()[0] for lv, p, d in [("HIGH", False, False), ("HIGH", True, False), ("MEDIUM", False, False), ("LOW", False, False), ("HIGH", False, True)]]
    assert shown == ["interstitial", "proceeded_banner", "banner", "none", "none"]
    assert one.select(badge(F.lit("UNKNOWN"))["text"], badge(F.lit("LOW"))["text"]).first()[:] == ("!", "")
    assert one.select(credential_field(F.lit("text"), F.lit("cc-number")), credential_field(F.lit(None).cast("string"), F.lit("name"))).first()[:] == (True, False)


IN = '<form action="/in"><input type="password"></form>'
#: URL, body and head of pages with a published score each; what fires is told by the score.
WORKED = [
    ("http://example.test:4321/corpus/benign/article-1.html", "<p>Plain words", "", 0.316, "LOW"),
    ("http://127.0.0.1:4321/corpus/phish/ip-login.html", IN, "", 0.829, "HIGH"),
    ("http://paypa1-login.test:4321/corpus/phish/external-action.html", '<form action="https://far.example/x"><input type="password"></form>', "", 0.814, "HIGH"),
    ("http://secure-verify.test:4321/corpus/phish/title-mismatch.html", IN + "<p>Act now, your account is locked", "<title>PayPal</title>", 0.938, "HIGH"),
    ("http://login.example.test:4321/corpus/phish/http-login.html", IN, "", 0.726, "MEDIUM"),
    ("http://account-update.test:4321/corpus/phish/hidden-inputs.html", IN + '<input type="hidden">' * 3, "", 0.797, "HIGH"),
    ("http://wallet-verify.test:4321/corpus/phish/urgency.html", IN + "<p>Final notice: act now", "", 0.876, "HIGH"),
    ("http://xn--pypal-4ve.paypal.evil.test:4321/corpus/phish/punycode.html", IN, "", 0.751, "HIGH"),
    ("http://secure-login.test:4321/corpus/phish/external-scripts.html", IN, '<script src="https://cdn.example/a.js"></script>', 0.837, "HIGH"),
    ("http://paypal-secure.test:4321/corpus/phish/copyright-mismatch.html", IN + "<footer>&copy; PayPal</footer>", "", 0.855, "HIGH"),
    ("http://verify-account.test:4321/corpus/phish/meta-refresh.html", IN, '<meta http-equiv="refresh" content="5">', 0.885, "HIGH"),
]


def test_published_scores(spark):
    got = {r["url"]: r["final"] for r in score(spark, [(u, f"<html><head>{head}</head><body>{body}</body></html>") for u, body, head, _, _ in WORKED])}
    assert {u: (round(v["score"], 3), v["level"]) for u, v in got.items()} == {u: (s, level) for u, _, _, s, level in WORKED}


def test_trees(spark):
    """An ensemble over the vector, against a walk through its nodes."""
    at = FEATURES.index
    trees = [[Split(at("url_len"), 30.0, 1, 2), Split(value=-0.5), Split(at("is_https"), 0.5, 3, 4), Split(value=1.25), Split(value=0.25)], [Split(value=0.1)]]
    rows = [(float(n), float(s)) for n in (10, 30, 31) for s in (0, 1)]
    df = spark.createDataFrame(rows, "url_len double, is_https double")
    walk = lambda n, s: 0.1 + (-0.5 if n < 30 else 1.25 if s < 0.5 else 0.25)
    got = [r[0] for r in df.select(ensemble_score(trees, df.columns)).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-walk(*r))) for r in rows])
    assert df.select(ensemble_score([], df.columns)).first()[0] == 0.5


def test_settings(spark):
    assert Settings.checked({"enabled": True, "allowlist": ["a.b"], "thresholds": {"medium": 0.1, "high": 0.2}}) == Settings(True, ("a.b",), 0.1, 0.2)
    assert Settings.checked({"enabled": 1}) == Settings() == Settings.checked(None)
    assert Settings().allowing("b").allowing("a").allowing("b", False).allowlist == ("a",)
    df = spark.createDataFrame([("http://a.test/login/verify",)], "url string")
    allowed = score_urls(df, settings=Settings(allowlist=("a.test",))).first()["verdict"]
    assert (allowed["level"], allowed["score"], allowed["reasons"][0]["code"]) == ("LOW", 0.0, "ALLOWLISTED")
    assert score_urls(df, settings=Settings(enabled=False)).first()["verdict"]["level"] == "UNKNOWN"


def test_nothing_makes_it_fail(spark):
    rng = random.Random(11)
    chars = string.printable + "é😀\u0000<>&\"'"
    rows = [("".join(rng.choice(chars) for _ in range(rng.randint(0, 40))), "".join(rng.choice(chars + "<p></a=>") for _ in range(rng.randint(0, 300)))) for _ in range(300)]
    rows += [("https://example.org/" + u.replace("\n", ""), h) for u, h in rows[:150]] + [(None, None)]
    assert len(score(spark, rows)) == len(rows)
