"""The collection store: raw URL lists, crawls and pages as Parquet, read with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewarden.operators.collection import CRAWL, MOST_HTML_BYTES, RAW, content_addressed, fresh_urls


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or a pattern) has files, on whatever store the path is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def read_parquet(spark: SparkSession, path: str, schema: str, pattern: str = "*") -> DataFrame:
    """All Parquet files of a folder whose names match, with exactly the schema's columns; missing ones are null.

    A folder that isn't there, or has no such file, gives an empty table.
    """
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    # files may lie in folders for days and runs
    if not (_exists(spark, f"{path}/{pattern}") or _exists(spark, f"{path}/*/{pattern}")):
        return spark.createDataFrame([], wanted)
    return spark.read.schema(wanted).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(path)


class Store:
    """Folders below one path: raw (by kind and day), crawled (by run), html (pages by digest)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def raw(self, kind: str) -> DataFrame:
        return read_parquet(self.spark, f"{self.path}/raw/{kind}", RAW, "*.parquet")

    def crawled(self) -> DataFrame:
        return read_parquet(self.spark, f"{self.path}/crawled", CRAWL, "*.parquet")

    def html(self) -> DataFrame:
        """html_file, html_sha256, bytes, content, html (the content as text)."""
        pages = read_parquet(self.spark, f"{self.path}/html", "html_file string, html_sha256 string, bytes bigint, content binary", "*.parquet")
        return pages.withColumn("html", F.col("content").cast("string"))

    def seen(self) -> DataFrame:
        return self.raw("phishing").select("url").unionByName(self.raw("benign").select("url")).filter("url IS NOT NULL").distinct()

    def collect(self, kind: str, found: DataFrame, source: str, label: int, day: str) -> DataFrame:
        """Add the found URLs (ord, url) that the store hasn't seen, as that day's; returns them. A second run adds nothing."""
        new = fresh_urls(found, self.seen(), source, label, day)
        out = f"{self.path}/raw/{kind}/day={day}"
        before = read_parquet(self.spark, out, RAW, "*.parquet").select("url")
        # appended, since the rows are new by the anti-join: no file of the store is written over
        new.write.mode("append").parquet(out)
        after = read_parquet(self.spark, out, RAW, "*.parquet")
        return after.join(before, "url", "left_anti") if before.head(1) else after

    def add_crawl(self, rows: DataFrame, stamp: str) -> None:
        """One more snapshot of crawl results."""
        rows.select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(CRAWL)]).write.mode("errorifexists").parquet(f"{self.path}/crawled/run={stamp}")

    def add_pages(self, pages: DataFrame, most: int = MOST_HTML_BYTES) -> DataFrame:
        """Store pages (url, content) by their content's hash, each content once; returns url, html_file, html_sha256, bytes."""
        named = content_addressed(pages, "content", most)
        known = read_parquet(self.spark, f"{self.path}/html", "html_sha256 string", "*.parquet")
        new = named.select("html_file", "html_sha256", "bytes", "content").dropDuplicates(["html_sha256"]).join(known, "html_sha256", "left_anti")
        new.select("html_file", "html_sha256", "bytes", "content").write.mode("append").parquet(f"{self.path}/html")
        return named.select("url", "html_file", "html_sha256", "bytes")

    def manifest(self) -> DataFrame:
        """path, sha256 and bytes of every Parquet file of raw and crawled, in order of the path."""
        found = [p for p in (f"{self.path}/raw", f"{self.path}/crawled") if _exists(self.spark, f"{p}/*")]
        schema = "path string, sha256 string, bytes bigint"
        if not found:
            return self.spark.createDataFrame([], schema)
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(found)
        return files.select(F.regexp_replace("path", "^.*?/(?=(raw|crawled)/)", "").alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).orderBy("path")

    def report(self) -> str:
        """What the store holds, as Markdown."""
        phishing, benign, crawled = self.raw("phishing"), self.raw("benign"), self.crawled()
        days = sorted({r[0] for r in phishing.select("first_seen").unionByName(benign.select("first_seen")).distinct().collect() if r[0]})
        lines = ["# Collection store", "", f"- Phishing URLs: **{phishing.count()}**", f"- Benign URLs: **{benign.count()}**", f"- Crawl results: **{crawled.count()}**", f"- Days: {', '.join(days) or 'none'}", ""]
        rows = self.manifest().collect()
        lines += ["| Path | SHA-256 | Bytes |", "| --- | --- | --- |", *(f"| `{r['path']}` | `{r['sha256']}` | {r['bytes']} |" for r in rows)] if rows else ["No files yet."]
        return "\n".join([*lines, ""])
