"""Collecting URLs and pages: new ones only, each once, with what was dropped and why."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.data.terms import PARKED_PATTERNS
from pagewarden.functions.urls import feed_url

RAW = "url string, source string, label int, first_seen string"
CRAWL = "url string, final_url string, status int, html_file string, html_sha256 string, bytes bigint, fetched_at string, error string, source string, label int"
EVAL = "url string, label int, html string, source string, first_seen string"
LEAST_HTML_BYTES, MOST_HTML_BYTES = 500, 2_000_000


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in the order given."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def parse_feed(lines: DataFrame, limit: int = 5000, keep_port: bool = True, skip_comments: bool = False) -> DataFrame:
    """ord, url: canonical URLs of a feed (columns ord, line), the first `limit` that are URLs, repeats included."""
    if skip_comments:
        lines = lines.filter(~F.trim("line").startswith("#"))
    urls = lines.select("ord", feed_url(F.col("line"), keep_port).alias("url")).filter("url IS NOT NULL")
    return urls.orderBy("ord").limit(limit)


def fresh_urls(found: DataFrame, seen: DataFrame, source: str, label: int, day: str) -> DataFrame:
    """The RAW rows of found URLs (ord, url) that aren't in seen (url), each once."""
    # one row for each URL needs no order among them: all other columns are the same
    new = found.select("url").filter("url IS NOT NULL").distinct().join(seen.select("url").filter("url IS NOT NULL"), "url", "left_anti")
    return new.select("url", F.lit(source).alias("source"), F.lit(label).alias("label"), F.lit(day).alias("first_seen"))


def pending(raw: DataFrame, crawled: DataFrame, limit: int | None = None, order: list | None = None) -> DataFrame:
    """Raw rows whose URL hasn't been crawled; the first `limit` of them in the order given."""
    rows = raw.join(crawled.select("url").filter("url IS NOT NULL"), "url", "left_anti")
    return rows if limit is None else rows.orderBy(*(order or ["first_seen", "url"])).limit(limit)


def parked(html: Column) -> Column:
    return F.coalesce(html.rlike("(?i)(?:" + "|".join(PARKED_PATTERNS) + ")"), F.lit(False))


def drop_reason(html: Column, legit_redirect: Callable[[Column, Column], Column] | None = None) -> Column:
    """Why a crawled row isn't usable, by the first test it fails; null if it passes all."""
    small = (F.coalesce("bytes", F.lit(0)) < LEAST_HTML_BYTES) | (F.coalesce("html_file", F.lit("")) == "")
    out = F.when(F.coalesce("error", F.lit("")) != "", "error").when(~F.coalesce(F.col("status") == 200, F.lit(False)), "status").when(small, "too_small").when(parked(html), "parked")
    if legit_redirect is not None:
        moved = ~F.col("final_url").eqNullSafe(F.col("url"))
        out = out.when(moved & legit_redirect(F.col("url"), F.col("final_url")), "legit_redirect")
    return out


def filter_crawl(crawl: DataFrame, html: DataFrame, legit_redirect: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(usable rows, counts by drop_reason) of a crawl; html has the pages by html_file."""
    pages = html.select("html_file", F.col("html").alias("__html"))
    marked = crawl.join(pages, "html_file", "left").withColumn("drop_reason", drop_reason(F.col("__html"), legit_redirect)).drop("__html")
    return marked.filter("drop_reason IS NULL").drop("drop_reason").select(*crawl.columns), marked.filter("drop_reason IS NOT NULL").groupBy("drop_reason").count()


def first_seen_by_url(phishing: DataFrame, benign: DataFrame) -> DataFrame:
    """url, first_seen. The benign list's entry counts where both have one, and the latest within a list."""
    rows = phishing.select("url", "first_seen", F.lit(0).alias("__o")).unionByName(benign.select("url", "first_seen", F.lit(1).alias("__o"))).filter("url IS NOT NULL AND first_seen IS NOT NULL")
    return rows.groupBy("url").agg(F.max_by("first_seen", F.struct("__o", "first_seen")).alias("first_seen"))


def build_eval_rows(crawl: DataFrame, html: DataFrame, first_seen: DataFrame) -> DataFrame:
    """EVAL rows of crawled pages with status 200, a stored page and a label."""
    rows = crawl.filter((F.col("status") == 200) & (F.coalesce("html_file", F.lit("")) != "") & F.col("label").isin(0, 1)).join(html.select("html_file", "html"), "html_file")
    return rows.join(first_seen, "url", "left").select("url", "label", "html", F.lit("collector").alias("source"), "first_seen")


def content_addressed(pages: DataFrame, content: str = "content", most: int = MOST_HTML_BYTES) -> DataFrame:
    """pages with content cut to `most` bytes, html_sha256, html_file and bytes."""
    cut = F.substring(F.col(content).cast("binary"), 1, most)
    return pages.withColumn(content, cut).withColumn("html_sha256", F.sha2(F.col(content), 256)).withColumn("html_file", F.concat(F.lit("html/"), F.col("html_sha256"), F.lit(".html"))).withColumn("bytes", F.length(content).cast("bigint"))


def temporal_split(when: Column, start: str, days: int = 14) -> Column:
    """train before start, val in the `days` from it, test in those after, else null."""
    t, day = F.to_date(F.lit(start)), F.to_date(when)
    return F.when(day < t, "train").when(day < F.date_add(t, days), "val").when(day < F.date_add(t, 2 * days), "test")


def ok_count(crawl: DataFrame) -> DataFrame:
    """One row: n, the crawled rows, and ok, those with HTTP status 200."""
    return crawl.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == 200).alias("ok"))


def reachable(status: Column) -> Column:
    return F.coalesce(status < 500, F.lit(False))


def url_digest(url: Column) -> Column:
    return F.sha2(F.encode(url, "UTF-8"), 256)


def popular_domains(ranks: DataFrame, domain_of: Callable[[Column], Column], count: int) -> DataFrame:
    """ord, domain of a rank list (ord, c0, c1): the first `count` rows that have a registrable domain, then each domain once.

    The name is in the second column if the first is a number and there is a second, else in the first.
    """
    host = F.when(F.col("c0").rlike("^[0-9]+$") & F.col("c1").isNotNull(), F.col("c1")).otherwise(F.col("c0"))
    top = ranks.select("ord", domain_of(host).alias("domain")).filter("domain IS NOT NULL").orderBy("ord").limit(count)
    return top.groupBy("domain").agg(F.min("ord").alias("ord"))
