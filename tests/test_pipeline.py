import json
import random

import pytest
from pyspark.sql import functions as F

from pagewarden.operators import collection, metrics
from pagewarden.plans.evaluate import evaluate, joined_scores, markdown, results_json, score_records
from pagewarden.sources import files
from pagewarden.sources.store import Store
from pagewarden.streaming.tabs import EVENT, STAGE2_TIMEOUT_MS, advance, latest_settings, replay, rescore_times


def scored(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, scores, strict=True)), "label int, score double")


def test_metrics(spark):
    df = scored(spark, [1, 1, 0, 0, 1], [0.9, 0.4, 0.5, 0.1, 0.9])
    r = metrics.confusion(df, [0.45]).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"], r["precision"], r["recall"]) == (2, 1, 1, 1, 0.6667, 0.6667)
    m = metrics.ranking_metrics(df, 0.95).first()
    assert (m["n"], m["roc_auc"], m["pr_auc"], m["fpr_at_recall"]) == (5, 0.8333, 0.9167, 0.5)
    ties = metrics.ranking_metrics(scored(spark, [1, 0], [0.5, 0.5])).first()
    assert ties["roc_auc"] == 0.5
    one = metrics.ranking_metrics(scored(spark, [0, 0], [0.5, 0.2])).first()
    assert one["roc_auc"] is None and one["fpr_at_recall"] is None
    assert metrics.sweep_thresholds()[7] == 0.35000000000000003 and len(metrics.sweep_thresholds()) == 21
    assert metrics.ranking_metrics(scored(spark, [1], [0.1]).limit(0)).first()["n"] == 0
    s = metrics.summarize(df, extra={"mean_gap": lambda y, p: F.avg(F.when(y == 1, p)) - F.avg(F.when(y == 0, p))})
    assert s["mean_gap"] == pytest.approx(2.2 / 3 - 0.3) and metrics.summarize(df.filter("label = 1"), extra={"m": lambda y, p: F.avg(p)})["m"] is None
    assert s["n_phishing"] == 3 and len(s["sweep"]) == 21 and not metrics.passes_gate(s)


def test_floor_percentile(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(1, 11)] + [("b", 3.0)] * 5 + [("b", 1.0), ("b", None), ("c", None), (None, 7.0), (None, 8.0)], "g string, v double")
    assert {tuple(r) for r in metrics.floor_percentiles(df, ["g"], "v", 95).collect()} == {("a", 10.0, 5.5), ("b", 3.0, 3.0), (None, 8.0, 7.5)}
    assert {r["percentile"] for r in metrics.floor_percentiles(df, ["g"], "v", 50).collect()} == {6.0, 3.0, 8.0}
    rng = random.Random(4)
    many = [(rng.choice("xy"), rng.choice([rng.gauss(0, 1), 5.0, 1e9, -3.0])) for _ in range(900)]
    for r in metrics.floor_percentiles(spark.createDataFrame(many, "g string, v double"), ["g"], "v", 90).collect():
        own = sorted(v for g, v in many if g == r["g"])
        assert r["percentile"] == own[min(len(own) - 1, int(0.9 * len(own)))] and r["median"] == (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2
    assert metrics.floor_percentiles(df.limit(0), ["g"], "v", 50).count() == 0


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.raw("phishing").columns == ["url", "source", "label", "first_seen"] and store.raw("phishing").count() == 0
    assert store.manifest().count() == 0
    lines = spark.createDataFrame([(0, "http://a.test"), (1, "nope"), (2, "http://a.test/"), (3, "http://b.test/x#y")], "ord bigint, line string")
    found = collection.parse_feed(lines, 10)
    assert store.collect("phishing", found, "feed", 1, "2026-01-01").count() == 2
    assert store.collect("phishing", found, "feed", 1, "2026-01-01").count() == 0
    assert store.collect("phishing", found, "feed", 1, "2026-01-02").count() == 0
    assert sorted(r["url"] for r in store.raw("phishing").collect()) == ["http://a.test/", "http://b.test/x"]
    pages = spark.createDataFrame([("http://a.test/", b"x" * 600), ("http://b.test/x", b"x" * 600)], "url string, content binary")
    kept = store.add_pages(pages)
    assert store.html().count() == 1
    store.add_pages(pages)
    assert store.html().count() == 1
    crawl = kept.select("url", F.col("url").alias("final_url"), F.lit(200).alias("status"), "html_file", "html_sha256", "bytes", F.lit("2026-01-01T00:00:00").alias("fetched_at"), F.lit(None).cast("string").alias("error"), F.lit("feed").alias("source"), F.lit(1).alias("label"))
    store.add_crawl(crawl, "2026-01-01T000000")
    assert collection.pending(store.raw("phishing"), store.crawled()).count() == 0
    rows = collection.build_eval_rows(store.crawled(), store.html(), collection.first_seen_by_url(store.raw("phishing"), store.raw("benign")))
    assert {r["first_seen"] for r in rows.collect()} == {"2026-01-01"}
    assert store.manifest().count() >= 2 and "Phishing URLs: **2**" in store.report()


def test_drop_reasons(spark):
    rows = [("a", "error", 200, 900, "f"), ("b", None, 404, 900, "f"), ("c", None, 200, 100, "f"), ("d", None, 200, 900, None), ("e", None, 200, 900, "p"), ("g", None, 200, 900, "f"), ("h", None, None, 900, "f")]
    crawl = spark.createDataFrame(rows, "url string, error string, status int, bytes bigint, html_file string").withColumn("final_url", F.when(F.col("url") == "g", "z").otherwise(F.col("url")))
    html = spark.createDataFrame([("f", "fine"), ("p", "Buy This Domain today")], "html_file string, html string")
    kept, why = collection.filter_crawl(crawl, html)
    assert [r["url"] for r in kept.collect()] == ["g"]
    assert {r[0]: r[1] for r in why.collect()} == {"error": 1, "status": 2, "too_small": 2, "parked": 1}
    kept, why = collection.filter_crawl(crawl, html, lambda a, b: b == "z")
    assert kept.count() == 0 and why.filter("drop_reason = 'legit_redirect'").count() == 1


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("http://a.test/", 1, None, None, None)], collection.EVAL)
    files.write_eval_rows(rows, str(tmp_path / "e"))
    back = files.read_eval_rows(spark, str(tmp_path / "e")).first()
    assert (back["label"], back["source"], back["html"]) == (1, "unknown", None)
    (tmp_path / "req").write_text('{"url": "http://a.test/", "html": "<p>"}\n\nnot json\n')
    got = files.read_requests(spark, str(tmp_path / "req")).collect()
    assert [(r["url"], r["error"]) for r in got] == [("http://a.test/", None), ("", "invalid json")]
    (tmp_path / "rank").write_text("1,www.first.com\n2,second.co.uk\n3,co.uk\n4,a.first.com\n5,host.unlistedtop\n6,third.org\n")
    ranks = files.read_rank_list(spark, str(tmp_path / "rank"), 4).orderBy("ord").collect()
    assert [r["domain"] for r in ranks] == ["first.com", "second.co.uk", "third.org"]
    (tmp_path / "c" / "phish").mkdir(parents=True)
    (tmp_path / "c" / "phish" / "x.html").write_text("<p>x")
    (tmp_path / "c" / "cases.json").write_text(json.dumps([{"name": "x", "group": "phish", "file": "phish/x.html", "url": "http://x.test/"}, {"name": "y", "group": "edge", "file": "phish/x.html", "url": "http://y.test/"}]))
    assert [(r["url"], r["label"], r["html"], r["source"]) for r in files.read_corpus(spark, str(tmp_path / "c")).collect()] == [("http://x.test/", 1, "<p>x", "corpus:phish")]


def test_evaluation(spark):
    login = '<form action="https://other.test/x"><input type=password></form>'
    rows = spark.createDataFrame([("http://127.0.0.1/", 1, login), ("https://plain.test/", 0, "<p>hello"), ("nothing", 1, "")], "url string, label int, html string")
    summary, good, bad = evaluate(rows)
    assert summary["n"] == 2 and summary["roc_auc"] == 1.0 and metrics.passes_gate(summary)
    assert [r["url"] for r in bad.collect()] == ["nothing"]
    lines = [tuple(r) for r in good.collect()]
    report = markdown("T", summary, lines, [("nothing", "x")])
    assert "| nothing | x |" in report and "| 2 | 1 | 1 | 1.0000 |" in report and json.loads(results_json("T", summary, lines, []))["summary"]["n"] == 2
    records = score_records(rows).withColumn("line", F.lit(1))
    worse = records.withColumn("final", F.col("final").withField("level", F.lit("LOW"))).withColumn("line", F.when(F.col("url").contains("127"), 2).otherwise(0))
    joined = joined_scores(rows.unionByName(spark.createDataFrame([("http://lost.test/", 0, "")], rows.schema)), records.unionByName(worse), ["line"]).collect()
    assert {r["url"]: r["error"] for r in joined}["http://lost.test/"] == "no score"
    assert {r["url"]: r["level"] for r in joined}["http://127.0.0.1/"] == "LOW"  # the later of two records


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT)


NAV = (1, 0, "navigate", 0, "https://a.test/", "MEDIUM", 0.5, None)


def test_tabs(spark):
    done = (1, 10, "completed", 0, "https://a.test/", None, None, None)
    out = replay(events(spark, [NAV, done])).orderBy("ts").collect()
    assert [(r["event"], r["ts"], r["final"]) for r in out] == [("navigate", 0, "MEDIUM"), ("timeout", 10 + STAGE2_TIMEOUT_MS, "MEDIUM")]
    late = (1, 9000, "SCORE_REQUEST", 0, "https://a.test/", "HIGH", 0.9, None)
    out = replay(events(spark, [NAV, done, late, (1, 9001, "DISMISS", 0, None, None, None, None), (1, 9002, "navigate", 0, "https://a.test/", "LOW", 0.1, None)]))
    last = latest_settings(out).first()
    assert (last["final"], last["dismissed"]) == ("LOW", True)
    other = replay(events(spark, [NAV, (1, 5, "PROCEED", 0, None, None, None, 2), (1, 6, "removed", 0, None, None, None, None), (1, 7, "DISMISS", 0, None, None, None, None)])).collect()
    assert [r["event"] for r in other] == ["navigate", "removed"]
    off = replay(events(spark, [(1, 0, "SET_ENABLED", 0, None, "UNKNOWN", None, None), (1, 1, "navigate", 0, "https://a.test/", "HIGH", 0.9, None)])).collect()
    assert [r["badge"] for r in off] == ["UNKNOWN", "UNKNOWN"]
    state: dict = {}
    advance(1, state, [dict(zip([c.split()[0] for c in EVENT.split(", ")], NAV, strict=True))])
    assert state["tab"]["stage1"]["level"] == "MEDIUM"


def test_rescores(spark):
    df = spark.createDataFrame([(1, t, True) for t in (0, 100, 300, 700, 1200, 1800)] + [(2, 0, False)], "page_id bigint, ts bigint, has_form boolean")
    assert [r["ts"] for r in rescore_times(df).orderBy("ts").collect()] == [250, 550, 950]


def test_stream(spark, tmp_path):
    from pagewarden.streaming.tabs import track

    src = tmp_path / "in"
    stamp = lambda df: df.withColumn("event_time", (F.col("ts") / 1000).cast("timestamp"))
    t = 1_000_000  # a stream's watermark starts at 0, and what isn't behind it is late
    stamp(events(spark, [(1, t, *NAV[2:]), (1, t + 10, "completed", 0, "https://a.test/", None, None, None)])).write.parquet(str(src))
    stream = spark.readStream.schema(EVENT + ", event_time timestamp").parquet(str(src))
    q = track(stream, delay="0 seconds").writeStream.format("memory").queryName("tabs_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        stamp(events(spark, [(2, t + 60_000, "navigate", 0, "https://b.test/", "LOW", 0.1, None)])).write.mode("append").parquet(str(src))
        q.processAllAvailable()
        stamp(events(spark, [(2, t + 61_000, "DISMISS", 0, None, None, None, None)])).write.mode("append").parquet(str(src))
        q.processAllAvailable()
        got = {(r["tab_id"], r["event"]) for r in spark.table("tabs_out").collect()}
    finally:
        q.stop()
    assert {(1, "navigate"), (1, "timeout"), (2, "navigate")} <= got


def test_collect_stream(spark, tmp_path):
    from pagewarden.streaming.collect import collect_feed

    feed, store = tmp_path / "feed", Store(spark, str(tmp_path / "store"))
    feed.mkdir()
    for k, text in enumerate(["http://a.test/\nhttp://b.test/\n", "http://b.test/\nhttp://c.test/\n"]):
        (feed / f"{k}.txt").write_text(text)
        collect_feed(spark, str(feed), store, "2026-01-01", str(tmp_path / "cp")).awaitTermination()
    assert store.raw("phishing").count() == 3


def test_settings_reach_the_stream(spark, tmp_path):
    """Settings are read anew for each batch, and nothing starts without them."""
    from pagewarden.streaming.score import score_navigations

    src, conf, out = tmp_path / "nav", tmp_path / "settings.json", str(tmp_path / "scores")
    rows = lambda ts: spark.createDataFrame([(1, ts, 0, "https://a.test/login/verify"), (1, ts, 3, "https://frame.test/")], "tab_id bigint, ts bigint, frame_id int, url string").write.mode("append").parquet(str(src))
    rows(1)
    stream = lambda: score_navigations(spark, spark.readStream.schema("tab_id bigint, ts bigint, frame_id int, url string").parquet(str(src)), str(conf), out, str(tmp_path / "cp"), once=True)
    with pytest.raises(Exception, match="settings.json"):
        stream()
    for ts, settings in ((1, "not json"), (2, json.dumps({"enabled": True, "allowlist": ["a.test"], "thresholds": {"medium": 0.1, "high": 0.2}})), (3, json.dumps({"enabled": False, "allowlist": [], "thresholds": {"medium": 0.1, "high": 0.2}}))):
        if ts > 1:
            rows(ts)
        conf.write_text(settings)
        stream().awaitTermination()
    got = {(r["ts"], r["verdict"]["level"], len(r["verdict"]["reasons"])) for r in spark.read.parquet(out).collect()}
    assert {g[:2] for g in got} == {(1, "LOW"), (2, "LOW"), (3, "UNKNOWN")} and (2, "LOW", 1) in got


def test_split(spark):
    df = spark.createDataFrame([("2026-01-01",), ("2026-01-10",), ("2026-01-25",), ("2026-03-01",)], "d string")
    assert [r[0] for r in df.select(collection.temporal_split(F.col("d"), "2026-01-05")).collect()] == ["train", "val", "test", None]


@pytest.mark.parametrize("name", ["url_parts", "noisy_or_score", "page_scores", "drop_reasons"])
def test_registered_queries_run(spark, name):
    from pagewarden.plans.queries import QUERIES

    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_commands(spark, tmp_path, capsys):
    from pagewarden.cli import main

    (tmp_path / "in.json").write_text('{"url": "http://127.0.0.1/", "html": "<form><input type=password></form>", "label": 1}\n{"url": "https://plain.test/", "html": "<p>hi", "label": 0}\n')
    assert main(["evaluate", "--input", str(tmp_path / "in.json"), "--out-dir", str(tmp_path / "e")]) == 0
    assert main(["gate", str(tmp_path / "e" / "eval-results.json")]) == 0
    assert main(["score", "--input", str(tmp_path / "in.json"), "--out", str(tmp_path / "s")]) == 0
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    (tmp_path / "ranks").write_text("1,first.com\n2,second.org\n")
    assert main(["bloom", "--input", str(tmp_path / "ranks"), "--out", str(tmp_path / "f.bloom")]) == 0
    assert '"entries": 2' in capsys.readouterr().out and (tmp_path / "f.bloom").read_bytes()[:4] == b"TBLM"
    assert files.read_membership(spark, str(tmp_path / "f.bloom")).bits > 0
    (tmp_path / "feed").write_text("# comment\nhttps://a.test/\n")
    assert main(["collect", "--store", str(tmp_path / "st"), "--feed", str(tmp_path / "feed"), "--kind", "benign", "--day", "2026-01-01"]) == 0
    assert "1 new URLs" in capsys.readouterr().out
    assert main(["manifest", "--store", str(tmp_path / "st")]) == 0
    assert main(["extract", "--input", str(tmp_path / "in.json"), "--out", str(tmp_path / "x")]) == 0
    assert {len(r["features"]) for r in spark.read.json(str(tmp_path / "x")).collect()} == {53}
    assert main(["pending", "--store", str(tmp_path / "st"), "--out", str(tmp_path / "q")]) == 0
    assert [r["url"] for r in spark.read.json(str(tmp_path / "q")).collect()] == ["https://a.test/"]
    (tmp_path / "crawl").write_text(json.dumps({"url": "https://a.test/", "final_url": "https://a.test/", "status": 200, "html": "<p>" + "x" * 600, "source": "feed", "label": 0}) + "\n")
    assert main(["add-crawl", "--store", str(tmp_path / "st"), "--input", str(tmp_path / "crawl")]) == 0
    assert "1 crawled, 1 with status 200" in capsys.readouterr().out
    assert main(["build-eval", "--store", str(tmp_path / "st"), "--out", str(tmp_path / "ev")]) == 0
    assert [(r["url"], r["label"], r["first_seen"]) for r in files.read_eval_rows(spark, str(tmp_path / "ev")).collect()] == [("https://a.test/", 0, "2026-01-01")]
    assert main(["pending", "--store", str(tmp_path / "st"), "--out", str(tmp_path / "q")]) == 0 and spark.read.schema("url string").json(str(tmp_path / "q")).count() == 0
    (tmp_path / "brands.json").write_text('[{"token": "acme", "etld1s": ["acme.test"]}]')
    (tmp_path / "list.dat").write_text("test\nco.test\n")
    assert main(["score", "--input", str(tmp_path / "in.json"), "--out", str(tmp_path / "s"), "--brands", str(tmp_path / "brands.json"), "--suffixes", str(tmp_path / "list.dat")]) == 0


def test_messages(spark):
    from pagewarden.streaming.tabs import valid_messages

    good, bad = valid_messages(spark.createDataFrame([("DISMISS",), ("nonsense",), (None,)], "type string"))
    assert good.count() == 1 and [r["error"] for r in bad.collect()] == ["UNKNOWN_MESSAGE"] * 2
