"""The library's operators as named queries over a folder of tables, with SQL for the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewarden.data.brands import BRANDS
from pagewarden.data.terms import CREDENTIAL_TERMS, FINANCIAL_TERMS, LANGUAGE_OF_TLD, LOOKALIKE_CHARACTERS, LOOKALIKE_PAIRS, SHORTENERS, TLD_RISK, URGENCY_TERMS, URL_KEYWORDS
from pagewarden.functions import text as text_functions
from pagewarden.functions.homoglyphs import fold
from pagewarden.functions.membership import Membership, fnv1a, positions
from pagewarden.functions.urls import feed_url, with_url_parts
from pagewarden.operators import collection, metrics
from pagewarden.operators.features import FEATURES, URL_FEATURES, extract_page, extract_url, vector
from pagewarden.operators.rules import RULES, fired_codes
from pagewarden.operators.verdicts import Settings, badge, is_navigation, lead_and_next, level_of, merge, score_pages, score_urls, top_reasons, ui_action
from pagewarden.plans import planted
from pagewarden.session import spread
from pagewarden.sources.files import read_brands, read_suffixes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _urls(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", "url")


def _given(spark):
    """The tables that the session names: spark.pagewarden.brands and spark.pagewarden.suffixes, files that Spark can read."""
    return {"brands": read_brands(spark, spark.conf.get("spark.pagewarden.brands", None)), "rules": read_suffixes(spark, spark.conf.get("spark.pagewarden.suffixes", None))}


def _parts(spark, sf_dir):
    return with_url_parts(_urls(spark, sf_dir), rules=_given(spark)["rules"])


# -- what the SQL side knows of a URL
_S_FOLD = lambda x: _s_pairs(f"translate(lower({x}), '{''.join(LOOKALIKE_CHARACTERS)}', '{''.join(LOOKALIKE_CHARACTERS.values())}')")


def _s_pairs(x):
    for a, b in LOOKALIKE_PAIRS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _quoted(items):
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


_PATTERN = r"^(https?)://([^/?#:]+)(?::([0-9]+))?([^?#]*)(\?[^#]*)?"
_U = rf"""u0 AS (SELECT page_id, url, html, regexp_extract(url, '{_PATTERN}', 1) AS scheme, lower(regexp_extract(url, '{_PATTERN}', 2)) AS host,
    regexp_extract(url, '{_PATTERN}', 4) AS p, regexp_extract(url, '{_PATTERN}', 5) AS q FROM pages WHERE regexp_matches(url, '{_PATTERN}')),
u AS (SELECT page_id, url, html, scheme, host, CASE WHEN p = '' THEN '/' ELSE p END AS path, CASE WHEN q = '?' THEN '' ELSE q END AS search,
    regexp_extract(host, '[^.]+$') AS suffix, regexp_extract(host, '[^.]+\.[^.]+$') AS etld1 FROM u0)"""
_SEGMENTS = "list_filter(string_split(path, '/'), lambda x: x <> '')"
_TOKENS = sorted({b.folded for b in BRANDS})


def _s_has_brand(x):
    folded = _S_FOLD(x)
    long = "|".join(t for t in _TOKENS if len(t) >= 5)
    return f"(list_has_any(regexp_split_to_array({folded}, '[^a-z0-9]+'), [{_quoted(_TOKENS)}]) OR {folded} IN ({_quoted(_TOKENS)}) OR regexp_matches({folded}, '{long}'))"


_S_ENTROPY = "(SELECT coalesce(-sum(n / total * log2(n / total)), 0) FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER () AS total FROM (SELECT unnest(string_split(host, '')) AS c) GROUP BY c))"
_F = f"""f AS (SELECT *, CASE WHEN etld1 = host THEN 0 ELSE len(string_split(host, '.')) - 2 END AS n_sub, len({_SEGMENTS}) AS depth,
    len(list_filter({_SEGMENTS}, lambda x: regexp_matches(x, '^[0-9a-fA-F]{{4,}}$'))) AS hexed,
    {" + ".join(f"contains(lower(url), '{k}')::INT" for k in URL_KEYWORDS)} AS n_keywords,
    coalesce((SELECT max(w) FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in TLD_RISK.items())}) r(s, w) WHERE r.s = suffix), 0) AS risk,
    {_s_has_brand("path")} AS brand_path, CASE WHEN etld1 = host THEN false ELSE {_s_has_brand("left(host, length(host) - length(etld1) - 1)")} END AS brand_sub,
    {_S_ENTROPY} AS entropy FROM u)"""
_CONDITIONS = {
    "URL_PUNYCODE": "contains(host, 'xn--')", "URL_BRAND_IN_SUBDOMAIN": "brand_sub", "URL_BRAND_IN_PATH": "brand_path", "URL_MANY_KEYWORDS": "n_keywords >= 2", "URL_NO_HTTPS": "scheme <> 'https'",
    "URL_RISKY_TLD": "risk >= 0.5", "URL_AT_SYMBOL": "contains(url, '@')", "URL_LONG_HOST": "length(host) > 30", "URL_MANY_SUBDOMAINS": "n_sub >= 3", "URL_ENTROPY": "CAST(entropy AS FLOAT)::DOUBLE > 3.5::DOUBLE",
    "URL_HEX_PATH": "depth > 0 AND CAST(hexed / depth AS FLOAT)::DOUBLE > 0.4::DOUBLE", "URL_EXE_EXT": r"regexp_matches(path, '\.(?:html?|php|aspx?|jsp)$', 'i')",
}
_WEIGHTS = {r.code: r.weight for r in RULES}
_S_SCORE = "1::DOUBLE - (" + " * ".join(f"(CASE WHEN {c} THEN {1 - _WEIGHTS[k]!r}::DOUBLE ELSE 1::DOUBLE END)" for k, c in _CONDITIONS.items()) + ")"
_SCORED = f"s AS (SELECT *, {_S_SCORE} AS score FROM f)"
_LEVEL = "CASE WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END"
_FIRED = " UNION ALL ".join(f"SELECT page_id, '{k}' AS code, {_WEIGHTS[k]!r}::DOUBLE AS weight, {[r.code for r in RULES].index(k)} AS ord FROM f WHERE {c}" for k, c in _CONDITIONS.items())


@_query(f"WITH {_U} SELECT page_id, scheme, host, path, search, suffix, etld1, CASE WHEN etld1 = host THEN 0 ELSE len(string_split(host, '.')) - 2 END AS n_labels FROM u")
def url_parts(spark, sf_dir):
    """URLs taken apart."""
    p = _parts(spark, sf_dir).filter("parts IS NOT NULL")
    return p.select("page_id", *[f"parts.{c}" for c in ("scheme", "host", "path", "search", "suffix", "etld1")], F.size("parts.labels").alias("n_labels"))


@_query(f"SELECT regexp_matches(url, '{_PATTERN}') AS scorable, count(*) AS n FROM pages GROUP BY 1")
def scorable_filter(spark, sf_dir):
    """How many URLs can be scored."""
    return _parts(spark, sf_dir).groupBy(F.col("parts").isNotNull().alias("scorable")).agg(F.count(F.lit(1)).alias("n"))


def _features(*names):
    def run(spark, sf_dir):
        return extract_url(_urls(spark, sf_dir), **_given(spark)).select("page_id", *[F.round(F.col(n).cast("double"), 6).alias(n) for n in names])

    return run


def _feature_query(name, names, doc, select):
    f = _features(*names)
    f.__name__, f.__doc__ = name, doc
    _query(f"WITH {_U}, {_F} SELECT page_id, {select} FROM f")(f)


_D = lambda x: f"({x})::DOUBLE"
_CHARS = lambda x, cs: f"length({x}) - length(translate({x}, '{cs}', ''))"
_feature_query("url_lengths", ["url_len", "host_len", "path_len", "query_len"], "Lengths.", f"{_D('length(url)')} AS url_len, {_D('length(host)')} AS host_len, {_D('length(path)')} AS path_len, {_D('length(search)')} AS query_len")
_feature_query("url_char_counts", ["num_dots_host", "num_hyphens_host", "num_digits_host", "num_special_chars"], "Counts of characters.", f"{_D(_CHARS('host', '.'))} AS num_dots_host, {_D(_CHARS('host', '-'))} AS num_hyphens_host, {_D(_CHARS('host', '0123456789'))} AS num_digits_host, {_D(_CHARS('(path || search)', '%~=&'))} AS num_special_chars")
_feature_query("url_flags", ["host_is_ip", "has_at_symbol", "has_double_slash_in_path", "has_punycode", "is_https", "nonstandard_port", "has_file_ext_html_php"], "Yes-or-no signals.", "regexp_matches(host, '^[0-9.]+$')::INT::DOUBLE AS host_is_ip, contains(url, '@')::INT::DOUBLE AS has_at_symbol, contains(path, '//')::INT::DOUBLE AS has_double_slash_in_path, contains(host, 'xn--')::INT::DOUBLE AS has_punycode, (scheme = 'https')::INT::DOUBLE AS is_https, 0::DOUBLE AS nonstandard_port, " + r"regexp_matches(path, '\.(?:html?|php|aspx?|jsp)$', 'i')::INT::DOUBLE AS has_file_ext_html_php")
_feature_query("url_segments", ["num_subdomains", "num_query_params", "path_depth", "hex_ratio_path"], "Counts of parts.", f"n_sub::DOUBLE AS num_subdomains, len(list_filter(string_split(substr(search, 2), '&'), lambda x: x <> ''))::DOUBLE AS num_query_params, depth::DOUBLE AS path_depth, round(CAST(CASE WHEN depth > 0 THEN hexed / depth ELSE 0 END AS FLOAT)::DOUBLE, 6) AS hex_ratio_path")
_feature_query("tld_risk_lookup", ["tld_risk"], "Risk of the suffix.", "round(CAST(risk AS FLOAT)::DOUBLE, 6) AS tld_risk")
_feature_query("shortener_flag", ["is_url_shortener"], "Whether a URL is a short link.", f"(etld1 IN ({_quoted(SHORTENERS)}) OR host IN ({_quoted(SHORTENERS)}))::INT::DOUBLE AS is_url_shortener")
_feature_query("phish_keywords", ["phish_keyword_count"], "Keywords in URLs.", "n_keywords::DOUBLE AS phish_keyword_count")
_feature_query("brand_presence", ["brand_in_subdomain", "brand_in_path"], "Brands in subdomains and paths.", "brand_sub::INT::DOUBLE AS brand_in_subdomain, brand_path::INT::DOUBLE AS brand_in_path")


@_query(f"WITH {_U}, {_F} SELECT page_id, round(CAST(entropy AS FLOAT)::DOUBLE, 5) AS host_entropy FROM f")
def host_entropy(spark, sf_dir):
    """Entropy of host names."""
    return extract_url(_urls(spark, sf_dir), **_given(spark)).select("page_id", F.round(F.col("host_entropy").cast("double"), 5).alias("host_entropy"))


_OWN_DOMAINS = _quoted(sorted({d for b in BRANDS for d in b.domains}))
# SQL's distance lets edits stand within a swap, which the domains of the table don't come near to.
_S_LIKENESS = f"""d AS (SELECT DISTINCT etld1, left(etld1, length(etld1) - length(suffix) - 1) AS name FROM u), g AS (SELECT etld1, unnest(regexp_split_to_array(name, '[-_]')) AS part FROM d),
    n AS (SELECT etld1, min(damerau_levenshtein(part, token) / greatest(length(part), length(token))) AS best FROM g JOIN (VALUES {", ".join(f"('{t}')" for t in _TOKENS)}) b(token)
        ON left({_S_FOLD("part")}, 1) = left(token, 1) AND abs(length(part) - length(token)) / greatest(length(part), length(token)) <= 0.4 WHERE part <> '' AND NOT regexp_matches(part, '^[0-9]+$') GROUP BY etld1)"""


@_query(f"WITH {_U}, {_S_LIKENESS} SELECT page_id, CASE WHEN etld1 IN ({_OWN_DOMAINS}) THEN 0 WHEN best < 0.4 THEN best::FLOAT::DOUBLE ELSE 1 END AS brand_lookalike_host FROM u LEFT JOIN n USING (etld1)")
def brand_lookalike(spark, sf_dir):
    """Likeness of registrable domains to brands."""
    return extract_url(_urls(spark, sf_dir), **_given(spark)).select("page_id", F.col("brand_lookalike_host").cast("double").alias("brand_lookalike_host"))


@_query(f"WITH {_U} SELECT page_id, {_S_FOLD('host')} AS folded FROM u")
def homoglyph_fold(spark, sf_dir):
    """Hosts with look-alike characters folded."""
    return _parts(spark, sf_dir).filter("parts IS NOT NULL").select("page_id", fold(F.col("parts.host")).alias("folded"))


_S_FNV = lambda x, seed: f"list_reduce(list_prepend({seed}::HUGEINT, list_transform(range(1, length(hex(encode({x}))) // 2 + 1), lambda i: ('0x' || substr(hex(encode({x})), 2 * i - 1, 2))::INT::HUGEINT)), lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::HUGEINT * 16777619) % 4294967296)"


@_query(f"WITH {_U} SELECT page_id, ({_S_FNV('host', 0x811C9DC5)})::BIGINT AS fnv FROM u")
def host_fnv1a(spark, sf_dir):
    """FNV-1a of hosts."""
    return _parts(spark, sf_dir).filter("parts IS NOT NULL").select("page_id", fnv1a(F.col("parts.host")).alias("fnv"))


@_query(f"WITH {_U}, d AS (SELECT DISTINCT host FROM u), h AS (SELECT ({_S_FNV('host', 0x811C9DC5)})::BIGINT AS a, (({_S_FNV('host', 0x811C9DC5 ^ 0x9E3779B9)})::BIGINT | 1) AS b FROM d) SELECT DISTINCT (a + i * b) % 9586 AS bit FROM h, range(7) t(i)")
def bloom_bit_positions(spark, sf_dir):
    """Bits that the hosts set in a filter of 9586 bits with 7 hashes."""
    hosts = _parts(spark, sf_dir).select(F.col("parts.host").alias("host")).filter("host IS NOT NULL").distinct()
    return hosts.select(F.explode(positions(F.col("host"), 9586, 7)).alias("bit")).distinct()


_S_FILTER = f"""l AS (SELECT DISTINCT host FROM u WHERE scheme = 'https'), z AS (SELECT count(*) AS n, ceil(-count(*) * ln(0.01) / (ln(2) * ln(2)))::BIGINT AS m FROM l), c AS (SELECT m, greatest(1, round(m / n * ln(2)))::BIGINT AS k FROM z),
    h AS (SELECT host, ({_S_FNV('host', 0x811C9DC5)})::BIGINT AS a, (({_S_FNV('host', 0x811C9DC5 ^ 0x9E3779B9)})::BIGINT | 1) AS b FROM (SELECT DISTINCT host FROM u)),
    p AS (SELECT host, (a + i * b) % m AS bit FROM h, c, range(32) t(i) WHERE i < k), f AS (SELECT DISTINCT bit FROM p SEMI JOIN l USING (host)),
    r AS (SELECT host, bool_and(f.bit IS NOT NULL) AS listed FROM p LEFT JOIN f USING (bit) GROUP BY host)"""


@_query(f"WITH {_U}, {_S_FILTER} SELECT page_id, host, listed FROM u JOIN r USING (host)")
def bloom_membership(spark, sf_dir):
    """Hosts of https pages as a filter, asked for all hosts."""
    parts = _parts(spark, sf_dir).filter("parts IS NOT NULL").select("page_id", F.col("parts.host").alias("host"), F.col("parts.scheme").alias("scheme"))
    listed = Membership.build(parts.filter("scheme = 'https'").select(F.col("host").alias("domain")).distinct())
    return listed.marked(parts.select("page_id", "host"), "host", "listed")


@_query("""SELECT page_id, len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::DOUBLE AS num_anchors, 0::DOUBLE AS external_anchor_ratio, 0::DOUBLE AS anchor_null_ratio, 0::DOUBLE AS num_forms, 0::DOUBLE AS num_iframes FROM pages""")
def page_anchor_counts(spark, sf_dir):
    """Anchors of pages."""
    out = extract_page(spread(_table(spark, sf_dir, "pages")), **_given(spark))
    return out.select("page_id", *[F.col(c).cast("double").alias(c) for c in ("num_anchors", "external_anchor_ratio", "anchor_null_ratio", "num_forms", "num_iframes")])


_LANGUAGES = ", ".join(f"('{k}', '{v}')" for k, v in LANGUAGE_OF_TLD.items())


@_query(f"""WITH {_U}, l AS (SELECT *, lower(regexp_extract(html, '<html lang="([a-z]*)', 1)) AS lang FROM u)
    SELECT page_id, coalesce(lang <> '' AND lang <> e.language, false)::INT::DOUBLE AS lang_mismatch_tld FROM l LEFT JOIN (VALUES {_LANGUAGES}) e(tld, language) ON e.tld = suffix""")
def page_language(spark, sf_dir):
    """Pages whose language isn't that of their country."""
    return extract_page(spread(_table(spark, sf_dir, "pages")), **_given(spark)).select("page_id", F.col("lang_mismatch_tld").cast("double").alias("lang_mismatch_tld"))


def _s_terms(terms):
    import re

    return " + ".join(f"regexp_matches(lower(coalesce(text, '')), '(?:^|[^a-z0-9]){re.escape(t)}(?:[^a-z0-9]|$)')::INT".replace("mother's", "mother''s") for t in terms)


@_query(f"SELECT doc_id, {_s_terms(URGENCY_TERMS)} AS urgency, {_s_terms(CREDENTIAL_TERMS)} AS credential, {_s_terms(FINANCIAL_TERMS)} AS financial FROM documents")
def document_terms(spark, sf_dir):
    """Terms of urgency, credentials and money in documents."""
    count = lambda terms: text_functions.term_count(F.col("text"), terms)
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", count(URGENCY_TERMS).alias("urgency"), count(CREDENTIAL_TERMS).alias("credential"), count(FINANCIAL_TERMS).alias("financial"))


@_query(f"WITH {_U}, {_F} {_FIRED}")
def rule_fired_long(spark, sf_dir):
    """One row for each rule that fires on a URL."""
    return fired_codes(extract_url(_urls(spark, sf_dir), **_given(spark)).select("page_id", *URL_FEATURES)).select("page_id", "code", "weight", "ord")


@_query(f"WITH {_U}, {_F} SELECT code, count(*) AS n FROM ({_FIRED}) GROUP BY code")
def rule_histogram(spark, sf_dir):
    """How often each rule fires."""
    return rule_fired_long(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def _scored(spark, sf_dir):
    return score_urls(_urls(spark, sf_dir), **_given(spark)).filter("url_len IS NOT NULL")  # a URL that can't be scored has no features


@_query(f"WITH {_U}, {_F}, {_SCORED} SELECT page_id, round(score, 9) AS score, {_LEVEL} AS level FROM s")
def noisy_or_score(spark, sf_dir):
    """Scores and levels of URLs."""
    return _scored(spark, sf_dir).select("page_id", F.round("verdict.score", 9).alias("score"), "verdict.level")


@_query(f"WITH {_U}, {_F}, {_SCORED} SELECT {_LEVEL} AS level, count(*) AS n, round(avg(score), 6) AS mean_score FROM s GROUP BY 1")
def verdict_levels(spark, sf_dir):
    """URLs by level."""
    return _scored(spark, sf_dir).groupBy("verdict.level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("verdict.score"), 6).alias("mean_score"))


@_query(f"WITH {_U}, {_F}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY weight DESC, ord) AS place FROM ({_FIRED})) SELECT page_id, place - 1 AS place, code, weight FROM r WHERE place <= 5")
def top_reasons_by_page(spark, sf_dir):
    """The five heaviest reasons of each URL."""
    return _scored(spark, sf_dir).select("page_id", F.posexplode(top_reasons(F.col("verdict"), 5)).alias("place", "r")).select("page_id", F.col("place").cast("bigint").alias("place"), "r.code", "r.weight")


@_query(f"WITH {_U}, {_F}, {_SCORED} SELECT host, round(max(score), 9) AS score, count(*) AS n FROM s GROUP BY host ORDER BY max(score) DESC, host LIMIT 20")
def top_hosts_by_score(spark, sf_dir):
    """The twenty hosts with the highest scores (a report)."""
    hosts = with_url_parts(_scored(spark, sf_dir).select("page_id", "url", F.col("verdict.score").alias("score"))).groupBy(F.col("parts.host").alias("host"))
    return hosts.agg(F.max("score").alias("m"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("m"), "host").limit(20).select("host", F.round("m", 9).alias("score"), "n")


@_query(f"WITH {_U}, {_F}, {_SCORED} SELECT page_id, etld1 = 'example.org' AS allowlisted, CASE WHEN etld1 = 'example.org' THEN 0 ELSE round(score, 9) END AS score, CASE WHEN etld1 = 'example.org' THEN 'LOW' ELSE {_LEVEL} END AS level FROM s")
def allowlist_short_circuit(spark, sf_dir):
    """Scores with one domain allowed."""
    out = with_url_parts(score_urls(_urls(spark, sf_dir), settings=Settings(allowlist=("example.org",)), **_given(spark)))
    return out.filter("parts IS NOT NULL").select("page_id", (F.col("parts.etld1") == "example.org").alias("allowlisted"), F.round("verdict.score", 9).alias("score"), "verdict.level")


@_query()
def page_scores(spark, sf_dir):
    """Both stages and their merge, for every page."""
    out = score_pages(spread(_table(spark, sf_dir, "pages")), **_given(spark))
    v = F.col("final")
    shown = ui_action(v, F.lit(False), F.lit(False))
    return out.select("page_id", F.col("stage1.score").alias("stage1"), F.col("stage2.score").alias("stage2"), v["score"].alias("score"), v["level"].alias("level"), F.size(v["reasons"]).alias("n_reasons"), shown.alias("action"), badge(v["level"])["text"].alias("badge"), lead_and_next(v, 3)["lead"]["humanText"].alias("lead"))


@_query()
def page_vectors(spark, sf_dir):
    """The whole feature vector of every page."""
    return vector(extract_page(spread(_table(spark, sf_dir, "pages")), **_given(spark))).select("page_id", *[F.col(c).cast("double").alias(c) for c in FEATURES])


@_query(planted.PARTS_SQL)
def planted_url_parts(spark, sf_dir):
    """Planted URLs taken apart: addresses, ports, user names, private suffixes, other letters."""
    p = with_url_parts(planted.planted_pages(_table(spark, sf_dir, "pages"))).filter("parts IS NOT NULL")
    return p.select("page_id", *[f"parts.{c}" for c in ("scheme", "host", "port", "path", "search", "suffix", "etld1")], F.array_join("parts.labels", ".").alias("labels"), "parts.is_ip", "parts.is_punycode")


@_query(planted.VECTORS_SQL)
def planted_vectors(spark, sf_dir):
    """All features of planted pages: forms, passwords, frames, scripts, terms, brands."""
    out = extract_page(planted.planted_pages(spread(_table(spark, sf_dir, "pages"))), **planted.flags()).filter("url_len IS NOT NULL")
    return out.select("page_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in FEATURES])


@_query(planted.RULES_SQL)
def planted_rules(spark, sf_dir):
    """The rules that fire on planted pages; each one does on some."""
    out = extract_page(planted.planted_pages(spread(_table(spark, sf_dir, "pages"))), **planted.flags()).filter("url_len IS NOT NULL")
    return fired_codes(out.select("page_id", *FEATURES)).select("page_id", "code", "weight", "ord")


@_query(planted.VERDICTS_SQL)
def planted_verdicts(spark, sf_dir):
    """Both stages of planted pages, their merge and what is shown, overrides included."""
    v = F.col("final")
    out = score_pages(planted.planted_pages(spread(_table(spark, sf_dir, "pages"))), **planted.flags()).filter("error IS NULL")
    score = lambda c: F.round(F.col(f"{c}.score"), 9)
    return out.select("page_id", score("stage1").alias("stage1"), score("stage2").alias("stage2"), score("final").alias("score"), v["level"].alias("level"), ui_action(v, F.lit(False), F.lit(False)).alias("action"))


_NORMAL = rf"lower(regexp_extract(url, '^(https?)://', 1)) || '://' || lower(regexp_extract(url, '{_PATTERN}', 2)) || CASE WHEN regexp_extract(url, '{_PATTERN}', 4) = '' THEN '/' ELSE regexp_extract(url, '{_PATTERN}', 4) END || CASE WHEN regexp_extract(url, '{_PATTERN}', 5) = '?' THEN '' ELSE regexp_extract(url, '{_PATTERN}', 5) END"


@_query(f"SELECT page_id, {_NORMAL} AS url FROM pages")
def normalise_urls(spark, sf_dir):
    """URLs in a feed's canonical form."""
    return _urls(spark, sf_dir).select("page_id", feed_url(F.col("url")).alias("url"))


@_query(f"WITH {_U} SELECT host, min(page_id) AS page_id, min_by(url, page_id) AS url FROM u GROUP BY host")
def dedupe_keep_first(spark, sf_dir):
    """The first page of each host."""
    p = _parts(spark, sf_dir).filter("parts IS NOT NULL").select(F.col("parts.host").alias("host"), "page_id", "url")
    return collection.keep_first(p, ["host"], ["page_id"])


@_query(f"WITH n AS (SELECT page_id, {_NORMAL} AS url FROM pages) SELECT DISTINCT url, 'feed' AS source, 1 AS label, '2026-01-02' AS first_seen FROM n WHERE url NOT IN (SELECT url FROM n WHERE page_id % 3 = 0)")
def new_url_anti_join(spark, sf_dir):
    """URLs of a feed that a store with a third of them hasn't seen."""
    urls = normalise_urls(spark, sf_dir)
    found = urls.select(F.col("page_id").alias("ord"), "url")
    return collection.fresh_urls(found, urls.filter("page_id % 3 = 0").select("url"), "feed", 1, "2026-01-02")


_CRAWL = """c AS (SELECT page_id, url, CASE WHEN page_id % 11 = 0 THEN 'timeout' END AS error, CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 5 = 0 THEN 100 ELSE strlen(html) END AS bytes, html FROM pages)"""


@_query(f"WITH {_CRAWL} SELECT CASE WHEN error IS NOT NULL THEN 'error' WHEN status <> 200 THEN 'status' WHEN bytes < 500 THEN 'too_small' END AS drop_reason, count(*) AS n FROM c WHERE error IS NOT NULL OR status <> 200 OR bytes < 500 GROUP BY 1")
def drop_reasons(spark, sf_dir):
    """Why rows of a crawl are dropped; the crawl's results are made up from the pages' ids."""
    p = _table(spark, sf_dir, "pages")
    file = F.concat(F.lit("html/"), F.col("page_id").cast("string"))
    crawl = p.select("page_id", "url", F.col("url").alias("final_url"), F.when(F.col("page_id") % 11 == 0, "timeout").alias("error"), F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("status"), F.when(F.col("page_id") % 5 == 0, 100).otherwise(F.octet_length("html")).cast("bigint").alias("bytes"), file.alias("html_file"))
    return collection.filter_crawl(crawl, p.select(file.alias("html_file"), "html"))[1].withColumnRenamed("count", "n")


@_query(f"WITH {_CRAWL} SELECT count(*) AS n, count(*) FILTER (status = 200) AS ok FROM c")
def http_ok_count(spark, sf_dir):
    """How many rows of the made-up crawl have status 200."""
    p = _table(spark, sf_dir, "pages")
    return collection.ok_count(p.select(F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("status")))


@_query("SELECT page_id, sha256(html) AS html_sha256, strlen(html) AS bytes, sha256(url) AS url_sha256 FROM pages")
def content_address(spark, sf_dir):
    """Pages by their content's hash."""
    p = _table(spark, sf_dir, "pages").withColumn("content", F.col("html"))
    return collection.content_addressed(p).select("page_id", "html_sha256", "bytes", collection.url_digest(F.col("url")).alias("url_sha256"))


@_query("WITH t AS (SELECT min(ts)::DATE + 7 AS t FROM events), s AS (SELECT CASE WHEN ts::DATE < t THEN 'train' WHEN ts::DATE < t + 14 THEN 'val' WHEN ts::DATE < t + 28 THEN 'test' END AS split FROM events, t) SELECT split, count(*) AS n FROM s GROUP BY 1")
def temporal_split(spark, sf_dir):
    """Events by the split of their day, a week after the first one."""
    events = _table(spark, sf_dir, "events")
    start = events.agg(F.date_add(F.min(F.to_date("ts")), 7).cast("string")).first()[0]
    return events.groupBy(collection.temporal_split(F.col("ts"), start).alias("split")).agg(F.count(F.lit(1)).alias("n"))


_S_LEVEL = lambda x: f"CASE WHEN {x} >= 0.75 THEN 'HIGH' WHEN {x} >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END"
_STAGES = f"""t AS (SELECT doc_id, CASE WHEN doc_id % 13 > 0 THEN (n_chars % 100) / 100.0::DOUBLE END AS a, CASE WHEN doc_id % 7 > 0 THEN (doc_id * 37 % 100) / 100.0::DOUBLE END AS b FROM documents),
    v AS (SELECT *, {_S_LEVEL('a')} AS la, {_S_LEVEL('b')} AS lb FROM t),
    m AS (SELECT *, CASE WHEN a IS NULL THEN b WHEN b IS NULL OR la = 'HIGH' THEN a WHEN b < 0.15 AND la = 'MEDIUM' THEN b WHEN lb = 'HIGH' OR lb = la OR la = 'LOW' THEN b ELSE a END AS score FROM v)"""


@_query(f"WITH {_STAGES} SELECT doc_id, score, CASE WHEN score IS NOT NULL THEN {_S_LEVEL('score')} END AS level, CASE WHEN score >= 0.75 AND doc_id % 5 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'proceeded_banner' ELSE 'interstitial' END WHEN score >= 0.35 AND doc_id % 5 <> 0 THEN 'banner' ELSE 'none' END AS action FROM m")
def merge_verdicts(spark, sf_dir):
    """Made-up verdicts of two stages, merged, and what a visitor is shown."""
    k, n = F.col("doc_id"), F.col("n_chars")
    made = lambda score: F.when(score.isNotNull(), F.struct(level_of(score).alias("level"), score.alias("score")))
    first, second = F.when(k % 13 > 0, (n % 100) / 100.0), F.when(k % 7 > 0, (k * 37 % 100) / 100.0)
    docs = _table(spark, sf_dir, "documents").select("doc_id", made(first).alias("a"), made(second).alias("b"))
    out = docs.withColumn("v", merge(F.col("a"), F.col("b")))
    return out.select("doc_id", "v.score", "v.level", ui_action(F.col("v"), k % 3 == 0, k % 5 == 0).alias("action"))


@_query("SELECT url, 'feed' AS source, 1 AS label, '2026-01-0' || (1 + page_id % 5) AS first_seen FROM pages WHERE page_id % 4 <> 0 ORDER BY first_seen, url LIMIT 40")
def crawl_pending(spark, sf_dir):
    """The first forty URLs that a crawl of a quarter of the pages has left (a limit of the planner)."""
    p = _urls(spark, sf_dir)
    raw = p.select("url", F.lit("feed").alias("source"), F.lit(1).alias("label"), F.concat(F.lit("2026-01-0"), (1 + F.col("page_id") % 5).cast("string")).alias("first_seen"))
    return collection.pending(raw, p.filter("page_id % 4 = 0").select("url"), 40)


@_query("WITH r AS (SELECT url, page_id % 2 AS o, '2026-01-0' || (1 + page_id % 5) AS d FROM pages WHERE page_id % 3 > 0 UNION ALL SELECT url, 1 - page_id % 2, '2026-02-0' || (1 + page_id % 5) FROM pages WHERE page_id % 6 = 1) SELECT url, max_by(d, {'o': o, 'd': d}) AS first_seen FROM r GROUP BY url")
def first_seen_lookup(spark, sf_dir):
    """When URLs of two lists were first seen; the second list's entry counts where both have one."""
    p = _urls(spark, sf_dir)
    day = lambda m: F.concat(F.lit(f"2026-{m}-0"), (1 + F.col("page_id") % 5).cast("string")).alias("first_seen")
    rows = p.filter("page_id % 3 > 0").select("url", (F.col("page_id") % 2).alias("o"), day("01")).unionByName(p.filter("page_id % 6 = 1").select("url", (1 - F.col("page_id") % 2).alias("o"), day("02")))
    return collection.first_seen_by_url(rows.filter("o = 0").drop("o"), rows.filter("o = 1").drop("o"))


@_query("SELECT page_id, page_id % 3 = 0 AND regexp_matches(url, '^https?://') AS navigation FROM pages")
def navigation_filter(spark, sf_dir):
    """Events that are navigations, with made-up frames."""
    return _urls(spark, sf_dir).select("page_id", is_navigation((F.col("page_id") % 3).cast("int"), F.col("url")).alias("navigation"))


# A score that says little, but has many ties and different values, of labelled documents.
_LS = "ls AS (SELECT toxic AS label, round((n_chars % 1000) / 1000.0, 2)::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"


def _labelled_scores(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(F.col("toxic").alias("label"), F.round((F.col("n_chars") % 1000) / 1000.0, 2).alias("score"))


def _s_confusion(thresholds):
    return f"""t AS (SELECT unnest([{", ".join(f"{t!r}::DOUBLE" for t in thresholds)}]) AS threshold), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label <> 1) AS fp,
        count(*) FILTER (score < threshold AND label <> 1) AS tn, count(*) FILTER (score < threshold AND label = 1) AS fn FROM ls, t GROUP BY threshold),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM c)"""


@_query(f"WITH {_LS}, {_s_confusion([0.35, 0.75])} SELECT threshold, tp, fp, tn, fn, round(p, 4) AS precision, round(q, 4) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 4) AS f1, round(fp / (fp + tn), 4) AS fpr, round((tp + tn) / (tp + fp + tn + fn), 4) AS accuracy FROM r")
def confusion_at_thresholds(spark, sf_dir):
    """Confusion matrices at the two operating points."""
    return metrics.confusion(_labelled_scores(spark, sf_dir), [metrics.MEDIUM, metrics.HIGH])


@_query(f"WITH {_LS}, {_s_confusion(metrics.sweep_thresholds())} SELECT round(threshold, 2) AS threshold, round(p, 4) AS precision, round(q, 4) AS recall, round(fp / (fp + tn), 4) AS fpr FROM r")
def threshold_sweep(spark, sf_dir):
    """Rates at 21 thresholds."""
    return metrics.threshold_sweep(_labelled_scores(spark, sf_dir))


@_query(f"""WITH {_LS}, g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM ls GROUP BY score),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC))
    SELECT max(p + n)::BIGINT AS n, max(p)::BIGINT AS n_positive, max(n)::BIGINT AS n_negative, round(sum(neg * (tp - pos / 2)) / max(p * n), 4) AS roc_auc, round(sum(pos * tp / (tp + fp)) / max(p), 4) AS pr_auc, round(max_by(fp, score) FILTER (tp / p >= 0.95) / max(n), 4) AS fpr_at_recall FROM c""")
def ranking_metrics(spark, sf_dir):
    """ROC-AUC, average precision and FPR at a recall of 0.95."""
    return metrics.ranking_metrics(_labelled_scores(spark, sf_dir))


@_query("SELECT event_type, list_sort(list(value))[least(count(*) - 1, floor(0.95 * count(*))::BIGINT) + 1] AS p95, round(median(value), 9) AS median FROM events WHERE value IS NOT NULL GROUP BY event_type")
def percentile_floor(spark, sf_dir):
    """Floor-index percentiles of events' values, by type."""
    out = metrics.floor_percentiles(_table(spark, sf_dir, "events"), ["event_type"], "value", 95)
    return out.select("event_type", F.col("percentile").alias("p95"), F.round("median", 9).alias("median"))


@_query("SELECT user_id AS tab_id, max_by(event_type, {'ts': ts, 'id': event_id}) AS last_type, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def tab_state_final(spark, sf_dir):
    """The last event of each tab."""
    events = _table(spark, sf_dir, "events").filter("user_id IS NOT NULL")
    return events.groupBy(F.col("user_id").alias("tab_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count(F.lit(1)).alias("n"))


# The machine step by step: one row for each event of a tab with the state behind it, and a timer that fired ahead of it.
_S_REPLAY = f"""e AS (SELECT user_id::BIGINT AS tab_id, (epoch_us(ts) // 1000)::BIGINT AS ts, ['navigate', 'completed', 'SCORE_REQUEST', 'DISMISS'][event_id % 4 + 1] AS kind, 'https://example.com/' || (event_id % 3) AS url,
        coalesce(abs(value) % 1, 0.0)::DOUBLE AS score, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL),
    l AS (SELECT *, {_S_LEVEL("score")} AS level FROM e),
    s AS (SELECT tab_id, 0::BIGINT AS i, NULL::BIGINT AS ts, '' AS kind, false AS open, NULL::VARCHAR AS url, NULL::DOUBLE AS s1, NULL::VARCHAR AS l1, NULL::VARCHAR AS l2, NULL::DOUBLE AS f, false AS dismissed, NULL::BIGINT AS timer, NULL::BIGINT AS fired FROM (SELECT DISTINCT tab_id FROM e)
        UNION ALL SELECT l.tab_id, l.i, l.ts, CASE WHEN l.kind = 'completed' OR (l.kind = 'DISMISS' AND NOT s.open) THEN '' ELSE l.kind END, s.open OR l.kind IN ('navigate', 'SCORE_REQUEST'),
            CASE WHEN l.kind IN ('navigate', 'SCORE_REQUEST') THEN l.url ELSE s.url END, CASE WHEN l.kind = 'navigate' THEN l.score ELSE s.s1 END, CASE WHEN l.kind = 'navigate' THEN l.level ELSE s.l1 END,
            CASE l.kind WHEN 'navigate' THEN NULL WHEN 'SCORE_REQUEST' THEN l.level ELSE s.l2 END,
            CASE WHEN l.kind = 'navigate' THEN l.score WHEN l.kind <> 'SCORE_REQUEST' THEN s.f WHEN s.l1 IS NULL THEN l.score WHEN s.l1 = 'HIGH' THEN s.s1 WHEN l.score < 0.15 AND s.l1 = 'MEDIUM' THEN l.score
                WHEN l.level = 'HIGH' OR l.level = s.l1 OR s.l1 = 'LOW' THEN l.score ELSE s.s1 END,
            CASE l.kind WHEN 'navigate' THEN s.open AND s.url = l.url AND s.dismissed WHEN 'DISMISS' THEN s.open ELSE s.dismissed END,
            CASE WHEN l.kind = 'completed' THEN l.ts + 1500 WHEN l.kind IN ('navigate', 'SCORE_REQUEST') OR s.timer <= l.ts THEN NULL ELSE s.timer END, CASE WHEN s.timer <= l.ts AND s.open AND s.l2 IS NULL THEN s.timer END
            FROM s JOIN l ON l.tab_id = s.tab_id AND l.i = s.i + 1),
    o AS (SELECT tab_id, ts, kind AS event, url, l1, l2, f, dismissed FROM s WHERE kind <> ''
        UNION ALL SELECT p.tab_id, n.fired, 'timeout', p.url, p.l1, NULL, p.f, p.dismissed FROM s n JOIN s p ON p.tab_id = n.tab_id AND p.i = n.i - 1 WHERE n.fired IS NOT NULL
        UNION ALL SELECT tab_id, timer, 'timeout', url, l1, NULL, f, dismissed FROM (SELECT *, max(i) OVER (PARTITION BY tab_id) AS last FROM s) WHERE i = last AND timer IS NOT NULL AND open AND l2 IS NULL)"""


@_query(f"WITH RECURSIVE {_S_REPLAY} SELECT tab_id, ts, event, url, l1 AS stage1, l2 AS stage2, {_S_LEVEL('f')} AS final, f AS score, dismissed, false AS proceeded, CASE WHEN event <> 'DISMISS' THEN {_S_LEVEL('f')} END AS badge FROM o")
def tab_replay(spark, sf_dir):
    """Tabs' states over a made-up sequence of navigations and scores, from the events."""
    from pagewarden.streaming.tabs import replay

    e = _table(spark, sf_dir, "events").filter("user_id IS NOT NULL")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("navigate", "completed", "SCORE_REQUEST", "DISMISS")]), (F.col("event_id") % 4 + 1).cast("int"))
    url = F.concat(F.lit("https://example.com/"), (F.col("event_id") % 3).cast("string"))
    score = F.coalesce(F.abs("value") % 1, F.lit(0.0))
    level = F.when(score >= 0.75, "HIGH").when(score >= 0.35, "MEDIUM").otherwise("LOW")
    return replay(e.select(F.col("user_id").cast("bigint").alias("tab_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), kind.alias("type"), F.lit(0).alias("frame_id"), url.alias("url"), level.alias("level"), score.alias("score"), F.lit(None).cast("bigint").alias("requested_tab"), F.col("event_id").alias("seq")))


def entry(spark, sf_dir):
    """The flagship: every page scored by both stages, summed up by level."""
    scored = score_pages(spread(_table(spark, sf_dir, "pages")), **_given(spark))
    return scored.groupBy("final.level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("final.score"), 6).alias("mean_score"))
