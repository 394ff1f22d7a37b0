"""Lists, JSON lines, labelled corpora and filters in files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.data.brands import BRANDS, Brand, brands_from_json
from pagewarden.functions.hosts import DEFAULT_RULES, SuffixRules, registrable, suffix
from pagewarden.functions.membership import Membership
from pagewarden.operators.collection import EVAL, popular_domains
from pagewarden.operators.verdicts import Settings


def _whole(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def read_brands(spark: SparkSession, path: str | None) -> list[Brand]:
    """The brand table of a JSON file (see brands_from_json), or the one built in if there is no path."""
    return brands_from_json(_whole(spark, path)) if path else BRANDS


def read_suffixes(spark: SparkSession, path: str | None) -> SuffixRules:
    """The rules of a public suffix list's file, or those built in if there is no path."""
    return SuffixRules.from_list(_whole(spark, path)) if path else DEFAULT_RULES


def read_settings(spark: SparkSession, path: str) -> Settings:
    """What a user has set, from a JSON file; settings that make no sense are the defaults."""
    try:
        return Settings.checked(json.loads(_whole(spark, path)))
    except ValueError:
        return Settings()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """ord, line of a text file of any size, in the file's order."""
    # ids rise along a file: its splits are numbered in order, as are the rows of each
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "\r$", "").alias("line"))


def read_rank_list(spark: SparkSession, path: str, count: int, rules: SuffixRules = DEFAULT_RULES) -> DataFrame:
    """ord, domain of a popularity list (CSV: rank and domain, or the domain alone); names below unknown top domains are left out."""
    rows = spark.read.schema("c0 string, c1 string").option("mode", "PERMISSIVE").csv(path).select(F.monotonically_increasing_id().alias("ord"), "c0", "c1")

    def domain(host):
        low = F.lower(host)
        end = suffix(low, rules, with_private=False)
        known = F.substring_index(end, ".", -1).isin(sorted(rules.top))
        return F.when(known & ~low.rlike(r"^[0-9.]+$"), registrable(low, end))

    return popular_domains(rows, domain, count)


def read_eval_rows(spark: SparkSession, path: str) -> DataFrame:
    """EVAL rows from JSON lines; blank lines are skipped, and the source is 'unknown' where there is none."""
    rows = spark.read.schema(EVAL).json(path)
    return rows.filter("url IS NOT NULL OR label IS NOT NULL OR html IS NOT NULL").withColumn("source", F.coalesce("source", F.lit("unknown")))


def write_eval_rows(rows: DataFrame, path: str) -> None:
    """EVAL rows as JSON lines with all keys, nulls included."""
    rows.select("url", "html", "label", "source", "first_seen").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """url, html, error of JSON lines with a URL and its page; text that isn't JSON gives the error 'invalid json'."""
    lines = spark.read.text(path).filter("trim(value) != ''")
    parsed = F.from_json("value", "url string, html string, _corrupt_record string", {"mode": "PERMISSIVE"})
    rows = lines.select(parsed.alias("r"))
    return rows.select(F.coalesce("r.url", F.lit("")).alias("url"), F.coalesce("r.html", F.lit("")).alias("html"), F.when(F.col("r._corrupt_record").isNotNull(), "invalid json").alias("error"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """EVAL rows of a corpus folder: cases.json (name, group, file, url) and the pages it names; other groups than phish and benign are left out."""
    cases = spark.read.schema("name string, `group` string, file string, url string").option("multiLine", "true").json(f"{path}/cases.json")
    pages = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").text(path).select(F.col("value").alias("html"), F.col("_metadata.file_path").alias("__path"))
    pages = pages.withColumn("__file", F.substring_index("__path", "/", -2))
    labelled = cases.filter(F.col("group").isin("phish", "benign")).join(pages, F.substring_index(F.concat(F.lit("/"), "file"), "/", -2) == F.col("__file"))
    return labelled.select("url", F.when(F.col("group") == "phish", 1).otherwise(0).alias("label"), "html", F.concat(F.lit("corpus:"), "group").alias("source"), F.lit(None).cast("string").alias("first_seen"))


def read_membership(spark: SparkSession, path: str) -> Membership:
    """A filter from its binary file."""
    return Membership.from_bytes(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def write_membership(spark: SparkSession, found: Membership, path: str) -> None:
    """A filter as one binary file, on any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(found.to_bytes()))
    finally:
        out.close()
