"""The feature vector: 53 named numbers for each page, 27 from its URL alone."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.data.brands import BRANDS, Brand
from pagewarden.data.terms import CREDENTIAL_TERMS, FINANCIAL_TERMS, LANGUAGE_OF_TLD, SHORTENERS, TLD_RISK, URGENCY_TERMS, URL_KEYWORDS
from pagewarden.functions import text
from pagewarden.functions.dom import page_summary
from pagewarden.functions.hosts import DEFAULT_RULES, SuffixRules
from pagewarden.functions.membership import Membership
from pagewarden.functions.urls import with_url_parts

EXTRACTOR_VERSION = 1
# The vector's names, in order.
URL_FEATURES = (
    "url_len host_len path_len query_len num_dots_host num_subdomains num_hyphens_host num_digits_host host_is_ip has_at_symbol has_double_slash_in_path num_query_params has_punycode host_entropy"
    " tld_risk num_special_chars is_https nonstandard_port brand_in_subdomain brand_in_path brand_lookalike_host is_url_shortener phish_keyword_count in_tranco_50k path_depth has_file_ext_html_php hex_ratio_path"
).split()
PAGE_FEATURES = (
    "num_forms has_password_input password_form_action_external password_form_action_empty_or_js num_external_scripts external_script_ratio num_iframes num_hidden_inputs num_anchors external_anchor_ratio"
    " anchor_null_ratio favicon_external has_meta_refresh title_brand_mismatch copyright_brand_mismatch login_form_on_http dom_node_count form_added_after_load password_field_in_iframe num_onsubmit_handlers"
    " urgency_term_count credential_term_count financial_term_count visible_text_len text_to_html_ratio lang_mismatch_tld"
).split()
FEATURES = URL_FEATURES + PAGE_FEATURES


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("int")


def count_of(col: Column, chars: str) -> Column:
    """Number of characters of a text that are among some."""
    return F.length(col) - F.length(F.translate(col, chars, ""))


def entropy(col: Column) -> Column:
    """Shannon entropy of a text's characters, in bits; 0 up to one character."""
    n = F.length(col).cast("double")
    chars = F.array_distinct(F.split(col, ""))
    share = lambda c: (n - F.length(F.replace(col, c, F.lit("")))) / n
    return F.when(n > 1, F.aggregate(chars, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))).otherwise(0.0)


def segments(col: Column, sep: str) -> Column:
    """The non-empty pieces between separators."""
    return F.filter(F.split(col, sep), lambda x: x != "")


def map_of(table: dict, kind: str) -> Column:
    """A constant map from strings, as one literal."""
    return F.from_json(F.lit(json.dumps(table)), f"map<string,{kind}>")


def url_features(parts: str = "parts", url: str = "url", brands: list[Brand] = BRANDS, popular: Membership | None = None) -> dict[str, Column]:
    """Expressions for URL_FEATURES, from the URL and its parts (see with_url_parts)."""
    raw, p = F.col(url), lambda f: F.col(f"{parts}.{f}")
    host, path, search = p("host"), p("path"), p("search")
    query = F.regexp_replace(search, r"^\?", "")
    steps = segments(path, "/")
    hexed = F.size(F.filter(steps, lambda s: s.rlike("^(?i:[0-9a-f]{4,})$")))
    risk = map_of(TLD_RISK, "double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {
        "url_len": utf16_length(raw),
        "host_len": F.length(host),
        "path_len": F.length(path),
        "query_len": F.length(search),
        "num_dots_host": count_of(host, "."),
        "num_subdomains": F.size(p("labels")),
        "num_hyphens_host": count_of(host, "-"),
        "num_digits_host": count_of(host, "0123456789"),
        "host_is_ip": flag(p("is_ip")),
        "has_at_symbol": flag(raw.contains("@")),
        "has_double_slash_in_path": flag(path.contains("//")),
        "num_query_params": F.size(segments(query, "&")),
        "has_punycode": flag(p("is_punycode")),
        "host_entropy": entropy(host),
        "tld_risk": F.coalesce(F.try_element_at(risk, p("suffix")), F.try_element_at(risk, F.substring_index(host, ".", -1)), F.lit(0.0)),
        "num_special_chars": count_of(F.concat(path, search), "%~=&"),
        "is_https": flag(p("scheme") == "https"),
        "nonstandard_port": flag(p("port") != ""),
        "brand_in_subdomain": flag((F.size(p("labels")) > 0) & text.has_brand(F.array_join(p("labels"), "."), brands)),
        "brand_in_path": flag(text.has_brand(path, brands)),
        "brand_lookalike_host": text.lookalike(f"{parts}.etld1", f"{parts}.suffix", brands),
        "is_url_shortener": flag(text.among(f"{parts}.etld1", SHORTENERS) | text.among(f"{parts}.host", SHORTENERS)),
        "phish_keyword_count": F.expr(" + ".join(f"int(contains(lower({url}), '{k}'))" for k in URL_KEYWORDS)),
        "in_tranco_50k": flag(popular.contains(F.coalesce(p("etld1"), host))) if popular else F.lit(0),
        "path_depth": F.size(steps),
        "has_file_ext_html_php": flag(path.rlike(r"(?i)\.(?:html?|php|aspx?|jsp)$")),
        "hex_ratio_path": F.when(F.size(steps) > 0, hexed / F.size(steps)).otherwise(0.0),
    }


def page_features(dom: str = "dom", parts: str = "parts", brands: list[Brand] = BRANDS, late_form: Column | None = None, sub_frame: Column | None = None) -> dict[str, Column]:
    """Expressions for PAGE_FEATURES, from a page's summary and its URL's parts."""
    d, p = (lambda f: F.col(f"{dom}.{f}")), (lambda f: F.col(f"{parts}.{f}"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    password = d("passwords") > 0

    def foreign(shown: Column) -> Column:
        brand = text.first_brand(shown, brands)
        return flag(brand.isNotNull() & ~F.array_contains(brand["domains"], F.coalesce(p("etld1"), F.lit(""))))

    language = F.lower(F.substring_index(d("lang"), "-", 1))
    expected = F.try_element_at(map_of(LANGUAGE_OF_TLD, "string"), F.substring_index(p("suffix"), ".", -1))
    low = d("body_text")
    return {
        "num_forms": d("forms"),
        "has_password_input": flag(password),
        "password_form_action_external": d("action_external"),
        "password_form_action_empty_or_js": d("action_empty"),
        "num_external_scripts": d("scripts_external"),
        "external_script_ratio": ratio(d("scripts_external"), d("scripts")),
        "num_iframes": d("iframes"),
        "num_hidden_inputs": d("hidden"),
        "num_anchors": d("anchors"),
        "external_anchor_ratio": ratio(d("anchors_external"), d("anchors")),
        "anchor_null_ratio": ratio(d("anchors_null"), d("anchors")),
        "favicon_external": d("icon_external"),
        "has_meta_refresh": d("meta_refresh"),
        "title_brand_mismatch": foreign(d("title")),
        "copyright_brand_mismatch": foreign(d("footer_text")),
        "login_form_on_http": flag(password & (p("scheme") == "http")),
        "dom_node_count": d("nodes"),
        "form_added_after_load": flag(late_form) if late_form is not None else F.lit(0),
        "password_field_in_iframe": flag(password & sub_frame) if sub_frame is not None else F.lit(0),
        "num_onsubmit_handlers": d("onsubmit"),
        "urgency_term_count": text.term_counts(f"{dom}.body_text", URGENCY_TERMS),
        "credential_term_count": text.term_counts(f"{dom}.body_text", CREDENTIAL_TERMS),
        "financial_term_count": text.term_counts(f"{dom}.body_text", FINANCIAL_TERMS),
        "visible_text_len": utf16_length(low),
        "text_to_html_ratio": ratio(utf16_length(low), d("html_len")),
        "lang_mismatch_tld": flag((language != "") & expected.isNotNull() & (language != expected)),
    }


def _vector(columns: dict[str, Column], scorable: Column) -> dict[str, Column]:
    # values are kept in single precision, as thresholds are compared with them
    return {k: F.when(scorable, F.coalesce(c.cast("float"), F.lit(0.0).cast("float"))) for k, c in columns.items()}


def extract_url(df: DataFrame, url_col: str = "url", brands: list[Brand] = BRANDS, popular: Membership | None = None, rules: SuffixRules = DEFAULT_RULES, general: bool = True, keep_parts: bool = False) -> DataFrame:
    """df with the 27 URL features (float); all null, and a warning in `warnings`, for a URL that can't be scored."""
    df = with_url_parts(df, url_col, "parts", rules, general)
    out = df.withColumns(_vector(url_features("parts", url_col, brands, popular), F.col("parts").isNotNull()))
    out = out.withColumn("warnings", F.when(F.col("parts").isNull(), F.array(F.concat(F.lit("unscorable url: "), F.coalesce(F.col(url_col), F.lit(""))))).otherwise(F.array().cast("array<string>")))
    return out if keep_parts else out.drop("parts")


def extract_page(df: DataFrame, url_col: str = "url", html_col: str = "html", late_form: Column | None = None, sub_frame: Column | None = None, brands: list[Brand] = BRANDS, popular: Membership | None = None, rules: SuffixRules = DEFAULT_RULES, general: bool = True, keep_parts: bool = False) -> DataFrame:
    """df with all 53 features (float). Pages without HTML have URL features and zeros behind them.

    Only the page's summary crosses to Python and back. A page that can't be read keeps zeros in its page
    features, and the reason in `warnings`.
    """
    df = extract_url(df, url_col, brands, popular, rules, general, keep_parts=True)
    # an empty string stands for a null: nothing is read from either
    df = df.withColumn("dom", page_summary(F.when(F.col("parts").isNotNull(), F.col(html_col)), F.col(url_col), F.col("parts.etld1"), rules))
    out = df.withColumns(_vector(page_features("dom", "parts", brands, late_form, sub_frame), F.col("parts").isNotNull()))
    out = out.withColumn("warnings", F.when(F.col("dom.error") != "", F.array_append("warnings", F.concat(F.lit("dom: "), F.col("dom.error")))).otherwise(F.col("warnings")))
    return out.drop("dom") if keep_parts else out.drop("dom", "parts")


def vector(df: DataFrame, to: str = "features") -> DataFrame:
    """df with the features also as one array<float> in the vector's order, zeros for those it lacks."""
    known = set(df.columns)
    return df.withColumn(to, F.expr(f"array({', '.join(f'coalesce({c}, float(0))' if c in known else 'float(0)' for c in FEATURES)})"))
