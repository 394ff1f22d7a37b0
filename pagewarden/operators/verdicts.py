"""Levels, overrides, verdicts, and the merge of the two stages."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.data.brands import BRANDS, Brand
from pagewarden.functions.hosts import DEFAULT_RULES, SuffixRules
from pagewarden.functions.membership import Membership
from pagewarden.functions.urls import with_url_parts
from pagewarden.operators.features import EXTRACTOR_VERSION, PAGE_FEATURES, URL_FEATURES, extract_page, extract_url, vector
from pagewarden.operators.rules import REASON, feature, over_features, score_rules, text_of

# Levels in ascending order, from rank -1.
LEVELS = ["UNKNOWN", "LOW", "MEDIUM", "HIGH"]
VERDICT = f"struct<level string, score double, reasons {REASON}, engine string, extractorVersion int>"


class Settings(NamedTuple):
    """What a user can set. Values that make no sense fall back to the defaults."""

    enabled: bool = True
    allowlist: tuple[str, ...] = ()
    medium: float = 0.35
    high: float = 0.75

    @classmethod
    def checked(cls, raw: dict | None) -> Settings:
        try:
            t = raw["thresholds"]
            sound = isinstance(raw["enabled"], bool) and all(isinstance(x, str) for x in raw["allowlist"]) and not isinstance(raw["allowlist"], str)
            sound = sound and all(isinstance(t[k], int | float) and not isinstance(t[k], bool) and 0 <= t[k] <= 1 for k in ("medium", "high"))
            return cls(raw["enabled"], tuple(raw["allowlist"]), float(t["medium"]), float(t["high"])) if sound else cls()
        except (TypeError, KeyError):
            return cls()

    def allowing(self, domain: str, allow: bool = True) -> Settings:
        kept = set(self.allowlist) | {domain} if allow else set(self.allowlist) - {domain}
        return self._replace(allowlist=tuple(sorted(kept)))


def rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level).cast("int") - 2


def level_at(rank_col: Column) -> Column:
    """The level of a rank."""
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), rank_col + 2)


def level_of(score: Column, settings: Settings = Settings()) -> Column:
    return F.when(score >= settings.high, "HIGH").when(score >= settings.medium, "MEDIUM").otherwise("LOW")


def higher(a: Column, b: Column) -> Column:
    """The higher of two levels; a null counts for nothing."""
    return F.when(b.isNull() | (rank(a) >= rank(b)), a).otherwise(b)


def override(columns: list[str]) -> Column:
    """The level that a page has at least, whatever its score, from the features among some columns; null for most."""
    like = feature("brand_lookalike_host", columns, 1.0)
    high = over_features("(host_is_ip = 1 AND has_password_input = 1) OR (has_punycode = 1 AND brand_in_subdomain = 1)", columns)
    near = f"{like} > 0 AND {like} < 0.15D AND {over_features('has_password_input = 1', columns)}"
    return F.expr(f"CASE WHEN {high} OR ({near}) THEN 'HIGH' WHEN {over_features('password_form_action_external = 1', columns)} THEN 'MEDIUM' END")


def _final_level(score: Column, forced: Column, settings: Settings) -> Column:
    # as numbers: a comparison of two choices of names would be multiplied out by the optimizer
    own = F.when(score >= settings.high, 2).when(score >= settings.medium, 1).otherwise(0)
    least = F.when(forced == "HIGH", 2).when(forced == "MEDIUM", 1).otherwise(-1)
    return level_at(F.greatest(own, least))


def unknown() -> Column:
    return F.struct(F.lit("UNKNOWN").alias("level"), F.lit(0.0).alias("score"), F.array().cast(REASON).alias("reasons"), F.lit("heuristic").alias("engine"), F.lit(EXTRACTOR_VERSION).alias("extractorVersion"))


def verdict(columns: list[str], site: str | None = None, settings: Settings = Settings()) -> Column:
    """The verdict of one stage from the features there are in `columns`; site is SQL for the site's domain. An override only raises the level."""
    score, reasons = score_rules(columns, site)
    level = _final_level(score, override(columns), settings)
    made = lambda lv, sc, re: F.struct(lv.alias("level"), sc.alias("score"), re.alias("reasons"), F.lit("heuristic").alias("engine"), F.lit(EXTRACTOR_VERSION).alias("extractorVersion"))
    out = made(level, score, reasons)
    if settings.allowlist and site is not None:
        said = F.array(F.struct(F.lit("ALLOWLISTED").alias("code"), F.lit("You marked this site as safe.").alias("humanText"), F.lit(0.0).alias("weight"))).cast(REASON)
        listed = F.expr(f"coalesce({site} IN ({', '.join(map(text_of, settings.allowlist))}), false)")
        out = F.when(listed, made(F.lit("LOW"), F.lit(0.0), said)).otherwise(out)
    return out


def merge(first: Column, second: Column) -> Column:
    """The verdict of both stages: one of the two as it is.

    A HIGH first stage stays. A second stage below 0.15 clears a MEDIUM first one. Otherwise the higher
    level counts, and the second stage on a tie. If one is null the other counts.
    """
    return (
        F.when(first.isNull(), second)
        .when(second.isNull() | (first["level"] == "HIGH"), first)
        .when((second["score"] < 0.15) & (first["level"] == "MEDIUM"), second)
        .when(rank(second["level"]) >= rank(first["level"]), second)
        .otherwise(first)
    )


def score_urls(df: DataFrame, url_col: str = "url", settings: Settings = Settings(), brands: list[Brand] = BRANDS, popular: Membership | None = None, rules: SuffixRules = DEFAULT_RULES, general: bool = True) -> DataFrame:
    """df with the URL features and `verdict`: UNKNOWN for a URL that can't be scored, or if scoring is off."""
    out = extract_url(df, url_col, brands, popular, rules, general, keep_parts=True)
    scorable = F.col("parts").isNotNull() & F.lit(settings.enabled)
    return out.withColumn("verdict", F.when(scorable, verdict(URL_FEATURES, "parts.etld1", settings)).otherwise(unknown())).drop("parts")


def score_pages(df: DataFrame, url_col: str = "url", html_col: str = "html", settings: Settings = Settings(), late_form: Column | None = None, sub_frame: Column | None = None, brands: list[Brand] = BRANDS, popular: Membership | None = None, rules: SuffixRules = DEFAULT_RULES, general: bool = True, scorer: Callable[[list[str], str, Settings], Column] = verdict) -> DataFrame:
    """df with all features, features (the vector), stage1, stage2, final and error.

    stage2 is null for a page without HTML, and final is stage1 then. For a URL that can't be scored all
    are null and error says so. scorer makes a verdict from named feature columns and SQL for the site's
    domain; another engine can take its place.
    """
    out = extract_page(df, url_col, html_col, late_form, sub_frame, brands, popular, rules, general, keep_parts=True)
    site, scorable = "parts.etld1", F.col("parts").isNotNull()
    out = vector(out)
    out = out.withColumn("features", F.when(scorable, F.col("features")))
    out = out.withColumn("stage1", F.when(scorable, scorer(URL_FEATURES, site, settings)))
    has_page = scorable & F.coalesce(F.col(html_col) != "", F.lit(False))
    out = out.withColumn("stage2", F.when(has_page, scorer(URL_FEATURES + PAGE_FEATURES, site, settings)))
    out = out.withColumn("final", F.when(scorable, merge(F.col("stage1"), F.col("stage2"))))
    return out.withColumn("error", F.when(~scorable, "unscorable url")).drop("parts")


def allowlisted(df: DataFrame, domains: DataFrame, url_col: str = "url", rules: SuffixRules = DEFAULT_RULES, general: bool = True) -> DataFrame:
    """df with `allowlisted`, from a table of domains (column etld1) of any size."""
    parts = with_url_parts(df, url_col, "__parts", rules, general)
    listed = domains.select(F.col("etld1").alias("__listed")).filter("__listed IS NOT NULL").distinct()
    joined = parts.join(listed, F.col("__parts.etld1") == F.col("__listed"), "left")
    return joined.withColumn("allowlisted", F.col("__listed").isNotNull()).drop("__parts", "__listed")


def top_reasons(verdict_col: Column, n: int = 5) -> Column:
    return F.slice(verdict_col["reasons"], 1, n)


def lead_and_next(verdict_col: Column, n: int) -> Column:
    """struct(lead, next): the heaviest reason, and up to n behind it."""
    return F.struct(F.get(verdict_col["reasons"], F.lit(0)).alias("lead"), F.slice(verdict_col["reasons"], 2, n).alias("next"))


def lead_text(verdict_col: Column, fallback: str = "No strong signals found.") -> Column:
    """The words of the heaviest reason, or the fallback if there is none."""
    return F.coalesce(F.get(verdict_col["reasons"], F.lit(0))["humanText"], F.lit(fallback))


def is_navigation(frame_id: Column, url: Column) -> Column:
    """Whether an event is a navigation to score: of the main frame, to an http(s) address."""
    return F.coalesce((frame_id == 0) & url.rlike("^https?://"), F.lit(False))


def frame_is_scored(is_top: Column, has_password: Column) -> Column:
    """The top frame always is; others only with a password field."""
    return F.coalesce(is_top, F.lit(False)) | F.coalesce(has_password, F.lit(False))


def ui_action(verdict_col: Column, proceeded: Column, dismissed: Column) -> Column:
    """What a page's visitor is shown: none, banner, interstitial or proceeded_banner."""
    level = verdict_col["level"]
    return F.when(verdict_col.isNull() | dismissed, "none").when((level == "HIGH") & ~proceeded, "interstitial").when(level == "HIGH", "proceeded_banner").when(level == "MEDIUM", "banner").otherwise("none")


def badge(level: Column) -> Column:
    """struct(icon, background, text) of a level's badge."""
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in zip(LEVELS, values, strict=True) for x in kv]), level)
    return F.struct(pick(["grey", "green", "amber", "red"]).alias("icon"), pick(["#9ca3af", "#16a34a", "#f59e0b", "#dc2626"]).alias("background"), F.when(level == "LOW", "").otherwise("!").alias("text"))


def credential_field(kind: Column, autocomplete: Column) -> Column:
    """Whether an input asks for credentials, by its type and its autocomplete hint."""
    hint = F.lower(F.coalesce(autocomplete, F.lit("")))
    return (F.lower(F.coalesce(kind, F.lit("text"))) == "password") | hint.isin("current-password", "new-password", "one-time-code") | hint.startswith("cc-")
