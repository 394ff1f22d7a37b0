"""Weighted rules over the feature vector, combined by noisy-OR, with their reasons in plain words.

Conditions are SQL over the features' names, so that all rules make one piece of SQL: an expression that
Spark parses at once, rather than thousands that Python puts together.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_of(value: str) -> str:
    """A string as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feature(name: str, columns: list[str] | None = None, missing: float = 0.0) -> str:
    """SQL of a feature as the rules read it: single precision, then compared in double; a value for what isn't there."""
    return f"{missing!r}D" if columns is not None and name not in columns else f"coalesce(cast(cast({name} AS float) AS double), {missing!r}D)"


def over_features(condition: str, columns: list[str] | None = None) -> str:
    """SQL of a condition that names features; keywords are in capitals."""
    return re.sub(r"\b[a-z_][a-z0-9_]*\b", lambda m: feature(m[0], columns), condition)


class Rule(NamedTuple):
    """code, weight, a condition in SQL over features' names (or a function of one that reads features by name), and words."""

    code: str
    weight: float
    test: str | Callable[[Callable[[str], Column]], Column]
    words: str = "This page shows a signal that is often used in phishing."

    def fires(self, columns: list[str] | None = None) -> Column:
        """Whether the rule fires, from the features among some columns."""
        if callable(self.test):
            return self.test(lambda name: F.expr(feature(name, columns)))
        return F.expr(over_features(self.test, columns))


# Rules in the order they are multiplied, with weights, conditions and words. {brand} and {site} are filled in.
RULES = [
    Rule("URL_IP_HOST", 0.5, "host_is_ip = 1", "The web address is a raw number instead of a normal site name."),
    Rule("URL_PUNYCODE", 0.35, "has_punycode = 1", "The site name uses characters that only look like ordinary letters."),
    Rule("URL_BRAND_LOOKALIKE", 0.6, "brand_lookalike_host > 0 AND brand_lookalike_host < 0.3D", "The address looks almost exactly like {brand}, but it is {site}."),
    Rule("URL_BRAND_LOOKALIKE_WEAK", 0.35, "brand_lookalike_host >= 0.3D AND brand_lookalike_host < 0.4D", "The address is similar to {brand} but is actually {site}."),
    Rule("URL_BRAND_IN_SUBDOMAIN", 0.3, "brand_in_subdomain = 1", "{brand} appears in the address, but the real site is {site}."),
    Rule("URL_BRAND_IN_PATH", 0.25, "brand_in_path = 1", "{brand} is mentioned in the link, but the real site is {site}."),
    Rule("URL_SHORTENER", 0.25, "is_url_shortener = 1", "The link is a short link that hides where it really goes."),
    Rule("URL_MANY_KEYWORDS", 0.3, "phish_keyword_count >= 2", "The address is full of words that phishing pages tend to use."),
    Rule("URL_NOT_TRANCO", 0.15, "in_tranco_50k = 0 AND brand_lookalike_host < 1", "This site is not one of the most visited sites on the web."),
    Rule("URL_NO_HTTPS", 0.2, "is_https = 0", "The connection is not secure, so anything you type can be read."),
    Rule("URL_RISKY_TLD", 0.3, "tld_risk >= 0.5D", "The site uses an ending that is often used for scams."),
    Rule("URL_AT_SYMBOL", 0.3, "has_at_symbol = 1", 'The address contains an "@" that can hide the real destination.'),
    Rule("URL_NONSTANDARD_PORT", 0.1, "nonstandard_port = 1", "The site is served on an unusual port number."),
    Rule("URL_LONG_HOST", 0.15, "host_len > 30", "The site name is unusually long."),
    Rule("URL_MANY_SUBDOMAINS", 0.2, "num_subdomains >= 3", "The address has many extra parts in front of the real site name."),
    Rule("URL_ENTROPY", 0.2, "host_entropy > 3.5D", "The site name looks randomly generated."),
    Rule("URL_HEX_PATH", 0.2, "hex_ratio_path > 0.4D", "The link contains random-looking code."),
    Rule("URL_EXE_EXT", 0.05, "has_file_ext_html_php = 1", "The link points straight at a page file rather than a normal site page."),
    Rule("DOM_PASSWORD_EXTERNAL_ACTION", 0.7, "password_form_action_external = 1", "The login form sends your password to a different site than the one you are on."),
    Rule("DOM_PASSWORD_EMPTY_ACTION", 0.3, "password_form_action_empty_or_js = 1", "The login form does not say where it will send your details."),
    Rule("DOM_PASSWORD_ON_HTTP", 0.5, "login_form_on_http = 1", "You are being asked for a password on an insecure page."),
    Rule("DOM_TITLE_BRAND_MISMATCH", 0.6, "title_brand_mismatch = 1", "The page title says {brand}, but the site is {site}."),
    Rule("DOM_COPYRIGHT_BRAND_MISMATCH", 0.5, "copyright_brand_mismatch = 1", "The page claims to be {brand} in its footer, but the site is {site}."),
    Rule("DOM_EXTERNAL_SCRIPT_RATIO", 0.15, "external_script_ratio > 0.8D", "Most of the page is loaded from other websites."),
    Rule("DOM_HIDDEN_INPUTS", 0.15, "num_hidden_inputs >= 3", "The form contains many hidden fields."),
    Rule("DOM_FORM_ADDED_AFTER_LOAD", 0.3, "form_added_after_load = 1", "A login form appeared after the page had already loaded."),
    Rule("DOM_META_REFRESH", 0.2, "has_meta_refresh = 1", "The page automatically redirects you somewhere else."),
    Rule("DOM_MANY_IFRAMES", 0.2, "num_iframes >= 5", "The page embeds many other pages inside it."),
    Rule("CONTENT_URGENCY", 0.35, "urgency_term_count >= 2", "The page uses urgent language to pressure you."),
    Rule("CONTENT_CREDENTIAL", 0.3, "credential_term_count >= 2", "The page asks for passwords or other sign-in details."),
    Rule("CONTENT_FINANCIAL", 0.2, "financial_term_count >= 2", "The page talks about payments, bank details or money."),
    Rule("CONTENT_LANG_MISMATCH", 0.1, "lang_mismatch_tld = 1", "The language of the page does not match the country of the site."),
]
REASON = "array<struct<code string, humanText string, weight double>>"


def noisy_or_of(weights: Column) -> Column:
    """1 - the product of (1 - weight) over an array of weights, multiplied in order."""
    return F.aggregate(weights, F.lit(1.0), lambda left, w: left * (F.lit(1.0) - w), lambda left: F.lit(1.0) - left)


def _words(rule: Rule, site: str | None) -> str:
    """SQL of a rule's words, with the site's name where it is known and no brand by name."""
    said = text_of(rule.words.replace("{brand}", "a well-known brand"))
    return said if "{site}" not in rule.words else f"replace({said}, '{{site}}', {'coalesce(' + site + ', ' if site else '('}'this site'))"


def score_rules(columns: list[str], site: str | None = None, rules: list[Rule] = RULES) -> tuple[Column, Column]:
    """(score, reasons) from the features among some columns; site is SQL for the site's name.

    Reasons are those that fired by weight, heaviest first, then in the rules' order.
    """
    own = [r for r in rules if callable(r.test)]
    order = sorted(range(len(rules)), key=lambda k: -rules[k].weight)  # the order is known ahead: nothing is sorted for a row
    told = lambda r: f"named_struct('code', {text_of(r.code)}, 'humanText', {_words(r, site)}, 'weight', {r.weight!r}D)"
    if own:  # functions make columns, which SQL can't hold
        fired = [r.fires(columns) for r in rules]
        weights = F.array(*[F.when(f, F.lit(r.weight)).otherwise(0.0) for f, r in zip(fired, rules, strict=True)])
        said = F.array(*[F.when(fired[k], F.expr(told(rules[k]))) for k in order])
    else:
        tests = [over_features(r.test, columns) for r in rules]
        weights = F.expr(f"array({', '.join(f'CASE WHEN {t} THEN {r.weight!r}D ELSE 0D END' for t, r in zip(tests, rules, strict=True))})")
        said = F.expr(f"array({', '.join(f'CASE WHEN {tests[k]} THEN {told(rules[k])} END' for k in order)})")
    return noisy_or_of(weights), F.filter(said, lambda r: r.isNotNull()).cast(REASON)


def fired_codes(df: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One row for each rule that fired on a row of df, with its ord, code and weight."""
    all_ = F.array(*[F.when(r.fires(df.columns), F.struct(F.lit(k).alias("ord"), F.lit(r.code).alias("code"), F.lit(r.weight).alias("weight"))) for k, r in enumerate(rules)])
    return df.withColumn("__rule", F.explode(F.filter(all_, lambda r: r.isNotNull()))).select(*df.columns, "__rule.*")
