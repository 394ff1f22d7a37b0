"""python -m pagewarden.cli COMMAND: extract, score, evaluate, gate, bloom, collect, pending, add-crawl, build-eval, manifest."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import functions as F


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pagewarden", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    add = lambda name, *flags: [(c := commands.add_parser(name)), *[c.add_argument(*f[0], **f[1]) for f in flags]]
    arg = lambda *names, **options: (names, options)
    tables = [arg("--brands", help="JSON file of brands"), arg("--suffixes", help="file of a public suffix list")]
    add("extract", arg("--input", required=True, help="JSON lines of url and html"), arg("--out", required=True), *tables)
    add("score", arg("--input", required=True, help="JSON lines of url and html"), arg("--out", required=True), *tables)
    add("evaluate", arg("--input", help="JSON lines of labelled pages"), arg("--corpus", help="folder with cases.json"), arg("--out-dir", required=True), *tables)
    add("gate", arg("results", help="eval-results.json"), arg("--recall", type=float, default=0.9), arg("--fpr", type=float, default=0.1))
    add("bloom", arg("--input", required=True, help="rank list"), arg("--top", type=int, default=50_000), arg("--list-id", default="local"), arg("--out", required=True))
    add("collect", arg("--store", required=True), arg("--feed", required=True), arg("--kind", choices=["phishing", "benign"], default="phishing"), arg("--source", default="feed"), arg("--limit", type=int, default=5000), arg("--day"))
    add("pending", arg("--store", required=True), arg("--limit", type=int), arg("--out", required=True, help="JSON lines of URLs to crawl"))
    add("add-crawl", arg("--store", required=True), arg("--input", required=True, help="JSON lines of crawl results: url, final_url, status, html, error, source, label"), arg("--stamp"))
    add("build-eval", arg("--store", required=True), arg("--out", required=True, help="JSON lines of labelled pages"))
    add("manifest", arg("--store", required=True))
    return parser


def main(argv: list[str] | None = None) -> int:
    """Run a command; 0 if it went well. Results of evaluate and gate are small and go to local files."""
    a = _arguments().parse_args(argv)
    if a.command == "gate":
        from pagewarden.operators.metrics import passes_gate

        good = passes_gate(json.loads(Path(a.results).read_text())["summary"], a.recall, a.fpr)
        print("PASS" if good else "FAIL")
        return 0 if good else 1
    from pagewarden.session import local_session
    from pagewarden.sources import files
    from pagewarden.sources.store import Store

    spark = local_session()
    given = {"brands": files.read_brands(spark, a.brands), "rules": files.read_suffixes(spark, a.suffixes)} if hasattr(a, "brands") else {}
    if a.command == "extract":
        from pagewarden.operators.features import extract_page, vector

        requests = files.read_requests(spark, a.input)
        found = vector(extract_page(requests.filter("error IS NULL"), **given)).select("url", F.when(F.col("url_len").isNotNull(), F.col("features")).alias("features"), "warnings")
        found.unionByName(requests.filter("error IS NOT NULL").select("error"), allowMissingColumns=True).write.mode("overwrite").json(a.out)
    elif a.command == "score":
        from pagewarden.plans.evaluate import score_records

        requests = files.read_requests(spark, a.input)
        scored = score_records(requests.filter("error IS NULL"), **given)
        failed = requests.filter("error IS NOT NULL").select("error")
        scored.unionByName(failed, allowMissingColumns=True).write.mode("overwrite").json(a.out)
    elif a.command == "evaluate":
        from pagewarden.plans.evaluate import evaluate, markdown, results_json

        rows = files.read_eval_rows(spark, a.input) if a.input else files.read_corpus(spark, a.corpus)
        summary, good, bad = evaluate(rows, **given)
        if not summary["n"]:
            print("no scorable rows", file=sys.stderr)
            return 1
        shown, errors = [tuple(r) for r in good.orderBy("url").collect()], [tuple(r) for r in bad.collect()]
        out = Path(a.out_dir)
        out.mkdir(parents=True, exist_ok=True)
        (out / "EVAL.md").write_text(markdown("Evaluation", summary, shown, errors))
        (out / "eval-results.json").write_text(results_json("Evaluation", summary, shown, errors))
    elif a.command == "bloom":
        from pagewarden.functions.membership import Membership

        domains = files.read_rank_list(spark, a.input, a.top).persist()
        found = Membership.build(domains)
        files.write_membership(spark, found, a.out)
        print(json.dumps(found.meta(domains.count(), datetime.now(UTC).date().isoformat(), a.list_id)))
    elif a.command == "collect":
        from pagewarden.operators.collection import parse_feed

        benign = a.kind == "benign"
        found = parse_feed(files.read_lines(spark, a.feed), a.limit, keep_port=not benign, skip_comments=benign)
        new = Store(spark, a.store).collect(a.kind, found, a.source, 0 if benign else 1, a.day or datetime.now(UTC).date().isoformat())
        print(f"{new.count()} new URLs")
    elif a.command == "pending":
        from pagewarden.operators.collection import pending

        store = Store(spark, a.store)
        rows = pending(store.raw("phishing").unionByName(store.raw("benign")), store.crawled(), a.limit)
        rows.write.mode("overwrite").json(a.out)
    elif a.command == "add-crawl":
        from pagewarden.operators.collection import ok_count

        results = spark.read.schema("url string, final_url string, status int, html string, error string, source string, label int").json(a.input).persist()
        store, stamp = Store(spark, a.store), a.stamp or datetime.now(UTC).strftime("%Y-%m-%dT%H%M%S")
        pages = store.add_pages(results.filter("html IS NOT NULL").select("url", F.col("html").cast("binary").alias("content"))).dropDuplicates(["url"])
        store.add_crawl(results.drop("html").join(pages, "url", "left").withColumn("fetched_at", F.lit(stamp)), stamp)
        done = ok_count(results).first()
        print(f"{done['n']} crawled, {done['ok']} with status 200")
    elif a.command == "build-eval":
        from pagewarden.operators.collection import build_eval_rows, first_seen_by_url

        store = Store(spark, a.store)
        files.write_eval_rows(build_eval_rows(store.crawled(), store.html(), first_seen_by_url(store.raw("phishing"), store.raw("benign"))), a.out)
    elif a.command == "manifest":
        store = Store(spark, a.store)
        print(store.manifest().select(F.to_json(F.struct("*"))).toPandas().to_string(index=False, header=False))
        print(store.report())
    return 0


if __name__ == "__main__":
    sys.exit(main())
