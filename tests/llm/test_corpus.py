"""Corpus operators against brute force on small tables."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewarden.llm import common, decontamination, hilbert, jaccard_join, quality, queries, toxicity, url_cascade, warc_audit

SF = "/root/testdata/sf0.001"


def held(k):
    return zlib.crc32(str(k).encode()) % 3 == 1


def test_curve_is_one_walk_through_the_grid():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(1 << bits)] * dims)], 1)
        index = hilbert.hilbert_index(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        walk = cells[np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shards(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, k]), rng.choice([None, "", "text é", "x" * 50]), rng.choice(["en", "de", None]), "src0" if k % 3 else f"s{k}", "extra") for k in range(203)] + [(1, "same", "en", "a", "e")] * 4
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, size string").withColumn("rank", F.lit(3)).withColumn("shard", F.lit("x"))
    placed = hilbert.shards(df, ["lang", "source", "size"]).cache()
    got = placed.collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in rows)
    counts = [sum(r["shard"] == s for r in got) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve_index"] for r in order] == sorted(r["curve_index"] for r in got)
    m = hilbert.manifest(placed, ["lang", "size"])
    chosen = {r["shard"] for r in hilbert.shards_to_read(m, {"lang": ("de", "de"), "size": (51, 60)}).collect()}
    assert {r["shard"] for r in got if r["lang"] == "de" and 51 <= r["size"] <= 60} <= chosen
    assert hilbert.shards(df.limit(0), ["lang", "source"]).count() == 0
    assert hilbert.shards(spark.createDataFrame([(k, None, None) for k in range(9)], "doc_id bigint, text string, lang string"), ["lang", "size"]).select("shard").distinct().count() == 8
    assert hilbert.shards(df.limit(3), ["lang"]).count() == 3


def test_bins_span_the_grid(spark):
    """Few values, a hot one, long common prefixes and one huge number: bins go by the share of rows in front."""
    rows = [("https://example.org/" + "abcd"[k % 4], 1 << 40 if k == 0 else k % 50, "hot" if k % 3 == 0 else f"s{k % 40}") for k in range(400)]
    df = spark.createDataFrame(rows, "url string, n bigint, source string")
    assert [b for _, b in hilbert._steps(df, "url", 16)] == [0, 4, 8, 12]
    for c, i in (("url", 0), ("n", 1), ("source", 2)):
        for v, b in hilbert._steps(df, c, 16):
            assert b == sum(r[i] < v for r in rows) * 16 // len(rows)
    assert len(hilbert._steps(df, "n", 16)) == 16
    few, _ = hilbert.hilbert_order(df, ["url", "n", "source"], 4)
    many, _ = hilbert.hilbert_order(df, ["url", "n", "source"], 6)  # too many cells for a table
    assert many.select("curve_index").distinct().count() >= few.select("curve_index").distinct().count() > 50
    bins = [F.lit(3), F.lit(9), F.lit(14)]
    assert spark.range(1).select(hilbert._on_curve(bins, 4)).first()[0] == hilbert.hilbert_index(np.array([[3, 9, 14]]), 4)[0]
    assert hilbert._steps(df.filter("n < 0"), "n", 16) == []


def test_filters_leave_shards_out(spark):
    """Half of a dimension's values are in half of the shards or little more, and two halves at once in fewer."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dims = queries.SHARD_DIMENSIONS
    placed = hilbert.shards(docs, dims).cache()
    m = hilbert.manifest(placed, dims).cache()
    read = lambda box: hilbert.shards_to_read(m, box).count()
    size = placed.agg(F.expr("percentile(size, 0.5)")).first()[0]
    langs = sorted(r[0] for r in placed.select("lang").distinct().collect())
    assert read({"lang": (langs[-1], langs[-1])}) <= 5
    assert read({"size": (size * 2, 1 << 40)}) <= 6
    assert read({"lang": (langs[-1], langs[-1]), "size": (size * 2, 1 << 40)}) <= 4
    for box in ({"lang": (langs[0], langs[0])}, {"size": (0, size)}):
        (c, (low, high)), *_ = box.items()
        held = {r[0] for r in placed.filter((F.col(c) >= low) & (F.col(c) <= high)).select("shard").distinct().collect()}
        assert held <= {r["shard"] for r in hilbert.shards_to_read(m, box).collect()}


def test_ranks(spark):
    df = spark.createDataFrame([(k % 7, k) for k in range(500)], "a int, b int")
    out, n = common.ranked(df, ["a", "b"], "r")
    assert n == 500 and [r["r"] for r in out.orderBy("a", "b").collect()] == list(range(500))


def test_urls(spark):
    urls = ["http://www.EXAMPLE.com/en/x", "http://a.example.com/en/", "http://example.com/de/", "http://m.b.net/es/1", "http://b.net/fr", "http://b.net/fr/", "https://spam-farm.example.org/x", "http://xspam-farm.example.org/x", "http://bad.example.org", "example.com/en/", None, "", "http://com/", "http://notexample.com/en/x", "http://u@example.com:80/en/", "a://b://c/d?e#f", "http://net/es/?q"] * 2
    df = spark.createDataFrame([(k, u, "r") for k, u in enumerate(urls)], "page_id bigint, url string, rule string")
    listed = spark.createDataFrame([("spam-farm.example.org/",), ("lists.example.org/a/",), ("absent.example/",)], "key string")
    got = url_cascade.judge_urls(df, queries.URL_RULES, listed).collect()
    for r in got:
        u = r["url"] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        fits = lambda rule: path.startswith(rule[rule.index("/") :]) and ("." + host).endswith("." + rule[: rule.index("/")])  # noqa: B023, E731
        rule = max((x for x in queries.URL_RULES if fits(x)), key=len, default=None)
        verdict = queries.URL_RULES[rule] if rule else "block" if fits("spam-farm.example.org/") or fits("lists.example.org/a/") else "allow"
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), r
    assert url_cascade.judge_urls(df.limit(0), queries.URL_RULES, listed).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter(F.crc32("key") % 20 == 0)
    c = url_cascade.Cascade.build(listed, universe)
    assert len(c.levels) > 1
    wrong = universe.filter(c.contains(F.col("key")) != (F.crc32("key") % 20 == 0))
    assert wrong.isEmpty()
    with pytest.raises(ValueError, match="listed keys"):
        url_cascade.Cascade.build(listed, universe, max_listed=10)
    parts = url_cascade.Cascades.build(listed, universe, max_listed=100)
    assert len(parts.parts) == 3 and universe.filter(parts.contains(F.col("key")) != (F.crc32("key") % 20 == 0)).isEmpty()


def test_audit(spark):
    rows = [(k, f"http://x/{k}", "p" * (k % 13)) for k in range(300)] + [(None, None, None), (5, "http://x/5", "again")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    record = warc_audit.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    assert bytes(pages.select(record).first()[0]) == b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:0>\r\nWARC-Target-URI: http://x/0\r\nContent-Type: text/html\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    mine = pages.select("page_id", record.alias("record"))
    same = warc_audit.audit(mine, mine, "page_id", segment_records=64).collect()
    assert len(same) == len(rows) and not any(r["damaged"] for r in same)
    flipped = mine.withColumn("record", F.when(F.col("page_id").isin(7, 200), F.concat(F.expr("substring(record, 1, length(record) - 1)"), F.lit(b"?"))).otherwise(F.col("record")))
    told = lambda replica, **o: {(r["page_id"], r["status"]) for r in warc_audit.audit(mine, replica, "page_id", **o).filter("damaged").collect()}
    assert told(flipped, segment_records=64) == {(7, "changed"), (200, "changed")}
    # the very records that are lost or added are named, though others move
    short = mine.filter("page_id NOT IN (10, 290) OR page_id IS NULL")
    assert told(short, segment_records=64) == {(10, "lost"), (290, "lost")}
    more = mine.unionByName(spark.createDataFrame([(1000, b"new"), (None, b"odd")], "page_id bigint, record binary"))
    assert told(more, segment_records=16) == {(1000, "added"), (None, "added")}
    assert told(flipped.filter("page_id != 0 OR page_id IS NULL").unionByName(spark.createDataFrame([(-5, b"x")], "page_id bigint, record binary")), segment_records=8) == {(0, "lost"), (-5, "added"), (7, "changed"), (200, "changed")}
    assert warc_audit.audit(mine.limit(0), mine.limit(0), "page_id").count() == 0
    assert told(mine.limit(0)) == {(r[0], "lost") for r in rows}
    # null records, records alike in id and content, and more copies of one
    odd = spark.createDataFrame([(1, None, 0), (1, None, 0), (2, b"a", 0), (2, b"b", 0), (None, None, 0)], "page_id bigint, record binary, leaf int")
    first = warc_audit.audit(odd, odd, "page_id").orderBy("page_id", "record_sha256").collect()
    assert [(r["page_id"], r["copies"], r["end"] - r["start"]) for r in first] == [(None, 1, 0), (1, 2, 0), (2, 1, 1), (2, 1, 1)]
    fewer = spark.createDataFrame([(1, None, 0), (2, b"a", 0), (2, b"c", 0), (None, None, 0)], odd.schema)
    assert {(r["page_id"], r["status"]) for r in warc_audit.audit(odd, fewer, "page_id").filter("damaged").collect()} == {(1, "changed"), (2, "changed")}


def test_audit_descends_only_where_needed(spark):
    """A lost record leaves other segments' trees alone."""
    mine = spark.range(2000).select(F.col("id").alias("page_id"), F.encode(F.repeat(F.lit("r"), (F.col("id") % 50).cast("int")), "UTF-8").alias("record"))
    a, b = (warc_audit.leaves(x, "page_id", "record", 32) for x in (mine, mine.filter("page_id != 777")))
    width = a.agg(F.max("leaf")).first()[0] + 1
    bad = warc_audit.mismatching_leaves(warc_audit.tree(a, width), warc_audit.tree(b, width))
    assert a.select("border").distinct().count() > 30 and bad.select("border").distinct().count() <= 2


def test_decontamination(spark):
    items = [(0, "The train from Berlin to Paris took 7 hours and cost Maria 120 euros in total last spring"), (1, "short item"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (4, None), (5, "")]
    docs = [
        (10, "Before it. The train from Berlin to Paris took 7 hours and cost Maria 120 euros in total last spring. After."),
        (11, "We know the train from Lyon to Vienna took 9 hours and cost Ahmed 340 euros in total last spring, they said."),
        (12, "THE TRAIN FROM BERLIN TO PARIS TOOK 7 HOURS AND COST MARIA 120 EUROS IN TOTAL LAST SPRING"),
        (13, "x alpha beta gamma delta epsilon zeta eta y"), (14, "nothing to see here at all in this clean document"), (15, None), (16, ""), (17, "a b " + "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3), (18, "short item"), (None, "q alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    ]
    d, b = spark.createDataFrame([(*r, "e") for r in docs], "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string")
    d = d.withColumnRenamed("item_id", "extra")
    want = {(10, 0), (11, 0), (12, 0), (17, 2), (None, 2), (18, 1)}
    for most in (10**6, 0):  # with and without the hashes sent ahead
        got = decontamination.contamination(d, b, max_sent=most).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert {r["doc_id"]: r["reworded"] for r in got}[11] and not {r["doc_id"]: r["reworded"] for r in got}[10]
    twisted = spark.createDataFrame([(1, "now the sum of 5 apples and 5 pears and 5 plums is what we want to know here")], "doc_id bigint, text string")
    item = lambda t: spark.createDataFrame([(9, t)], "item_id bigint, text string")
    assert decontamination.contamination(twisted, item("now the sum of 3 apples and 3 pears and 3 plums is what we want to know here")).count() == 1
    broken = twisted.withColumn("text", F.lit("now the sum of 5 apples and 6 pears and 7 plums is what we want to know here"))
    assert decontamination.contamination(broken, item("now the sum of 3 apples and 3 pears and 3 plums is what we want to know here")).count() == 0
    assert decontamination.without_contaminated(d, b).count() == len(docs) - len(want)
    assert decontamination.contamination(d.limit(0), b).count() == 0 and decontamination.contamination(d, b.limit(0)).count() == 0


def test_decontamination_of_openers_and_numbers(spark):
    """Names that open sentences and numbers with separators are slots like others."""
    item = spark.createDataFrame([(1, "Tom has 3 apples in a box. Ann has 5 pears in a bag. Joe buys all of them for 1,250 coins. How much did each of the three get for 4.5 percent of them?")], "item_id bigint, text string")
    texts = ["Sue has 8 apples in a box. Bob has 2 pears in a bag. Kim buys all of them for 950 coins. How much did each of the three get for 40 percent of them?", "The sky is blue today and 7 birds sing. Nobody knows for whom the 3 bells toll in a town by the sea."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r["doc_id"] for r in decontamination.contamination(docs, item).collect()] == [0]


def test_decontamination_of_partial_copies(spark):
    """A long run of an item's words counts whatever its share; a short or scattered one doesn't."""
    words = [f"w{k}" for k in range(100)]
    item = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    texts = ["before " + " ".join(words[20:60]) + " after", " ".join(words[20:45]), " ".join(" ".join(words[k : k + 12]) + " x" for k in range(0, 60, 15))]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id bigint, text string")
    got = decontamination.contamination(docs, item).collect()
    assert {(r["doc_id"], r["n_found"], r["n_exact"], r["n_windows"]) for r in got} == {(0, 36, 36, 96), (None, 36, 36, 96)}


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    return sorted(((k, len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def near_copies(seed, families, size, changes):
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, changes)):
                w[rng.randrange(len(w))] = f"z{rng.randint(0, 10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    return rows


@pytest.mark.parametrize(("crowd", "pairs", "often"), [(16, 2000, 3), (2, 3, 10**9), (2, 5, 2)])
def test_jaccard_components(spark, monkeypatch, crowd, pairs, often):
    monkeypatch.setattr(jaccard_join, "PAIRS", pairs)
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    rows = near_copies(4, 25, 14, 4) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "a b"), (5004, "A  b"), (5005, "a a a a a a"), (5006, "a a a a a a a"), (None, "a b"), (5003, "a b")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id bigint, text string, node string")
    got = jaccard_join.jaccard_components(df, crowd=crowd).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)


def test_jaccard_in_truncated_crowds(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LOCAL", 3)
    monkeypatch.setattr(jaccard_join, "PAIRS", 4)
    monkeypatch.setattr(jaccard_join, "FEW_BYTES", -1)
    monkeypatch.setattr(jaccard_join, "FEW_LINKS", -1)
    monkeypatch.setattr(jaccard_join, "OFTEN", 10**9)
    rows = near_copies(6, 4, 30, 3)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard_join.jaccard_components(df, crowd=2).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)
    kept = jaccard_join.without_near_duplicates(df)
    assert kept.count() == len({c for _, _, c in brute(rows)}) and kept.columns == df.columns
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_jaccard_chains_and_clean_neighbours(spark, monkeypatch):
    """Links that no region's first pairs show: chains whose ends are far apart, next to texts that share a passage only."""
    rng = random.Random(11)
    words = [f"c{rng.randint(0, 9999)}" for _ in range(400)]
    rows = [(k, " ".join(words[5 * k : 5 * k + 70])) for k in rng.sample(range(60), 60)]
    passage = " ".join(f"p{k}" for k in range(30))
    rows += [(1000 + k, " ".join([passage, *(f"u{rng.randint(0, 99999)}" for _ in range(rng.randint(5, 20)))])) for k in range(12)]
    seen = []
    across = jaccard_join._across
    monkeypatch.setattr(jaccard_join, "_across", lambda *a: seen.append(out := across(*a)) or out)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, __row int, row int")
    got = jaccard_join.jaccard_components(df).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)
    assert seen[0].count() > 0  # pairs that were left open and are looked at
    kept = jaccard_join.without_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len({c for _, _, c in brute(rows)})


def test_bitmaps_bound_the_difference():
    rng = random.Random(9)
    for _ in range(50):
        words = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(5, 200))]
        other = [w if rng.random() > 0.1 else "q" for w in words] + ["t"] * rng.randint(0, 40)
        s = jaccard_join.Sets([" ".join(words).encode(), " ".join(other).encode()])
        a, b = s.bitmaps()
        assert jaccard_join.bitmap_distance(a, b) <= len(set(s.of(0).tolist()) ^ set(s.of(1).tolist()))


def labelled(spark, make, n=600):
    rng = random.Random(12)
    docs, labels = [], []
    for k in range(n):
        y = rng.random() < 0.4
        docs.append((k, make(rng, y)))
        labels.append((k, int(y), int(y)))
    docs += [(n, None), (n + 1, ""), (None, "plain words"), (3, docs[3][1])]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*labels, (None, 1, 1), (n + 1, None, None)], "doc_id bigint, quality int, toxic int")


def accuracy(out, labels, col):
    rows = out.join(labels, "doc_id").filter(F.col(col).isNotNull()).collect()
    test = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows) and len(test) > 100
    return sum(r["predicted"] == r[col] for r in test) / len(test)


def test_toxicity(spark):
    stem = ["grumf", "blorg", "snarx"]
    make = lambda rng, y: " ".join(rng.choice(["the", "of", "a", "house", "river", "green", "walks", "often"]) + rng.choice(["", "s", "ing"]) if not (y and rng.random() < 0.08) else rng.choice(stem) + rng.choice("abcdefgh") * rng.randint(0, 3) for _ in range(60))
    docs, labels = labelled(spark, make)
    out = toxicity.toxicity(docs, labels)
    assert out.count() == docs.count()
    assert accuracy(out, labels, "toxic") > 0.95
    scores = [r["score"] for r in out.collect()]
    assert all(0 <= s <= 1 for s in scores)
    none = toxicity.toxicity(docs, labels.filter("toxic = 0")).collect()
    assert len(none) == docs.count() and not any(r["predicted"] for r in none)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_keeps_all_grams(spark):
    """More grams than go to the driver give the same scores, down to the words seen once."""
    make = lambda rng, y: " ".join(rng.choice(["the", "house", "river", "élan"]) + rng.choice("abcdefgh") * rng.randint(0, 3) if not (y and rng.random() < 0.1) else "gru" + "".join(rng.choice("mfx") for _ in range(4)) for _ in range(rng.randint(0, 30)))
    docs, labels = labelled(spark, make, 200)
    rows = lambda most: sorted(((str(r["doc_id"]), r["score"], r["mean_ratio"], r["peak_ratio"]) for r in toxicity.toxicity(docs, labels, max_grams=most).collect()))
    many, few = rows(0), rows(10**6)
    assert [r[0] for r in many] == [r[0] for r in few] and len(many) == docs.count()
    assert np.allclose([r[1:] for r in many], [r[1:] for r in few], rtol=0, atol=1e-5)


def test_toxicity_counts_repeated_expressions(spark):
    """Toxic texts repeat expressions that ordinary ones have once at most, among noise that peaks as high."""
    word = lambda r: "".join(r.choice(["en", "ou", "ch", "re", "an", "le", "ié"]) for _ in range(r.randint(1, 5)))

    def make(r, y):
        words = [word(r) for _ in range(r.randint(60, 240))]
        for _ in range(max(3, len(words) // 30) if y else int(r.random() < 0.2)):
            words[r.randrange(len(words))] = "réeux" + word(r)
        return " ".join(words)

    docs, labels = labelled(spark, make)
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out AND toxic IS NOT NULL").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    assert sum(toxic) > 0.95 * len(toxic)
    assert sum(r["predicted"] for r in rows if not r["toxic"]) < 0.02 * len(rows)


def test_shared_backoff_sums_to_one():
    """The shared model's probabilities of all bytes after a context add up to no more than 1."""
    gram, _, _, _ = toxicity.grams_of([b"abc abd xbc", b"bcd"])
    keys = np.unique(gram)
    p = toxicity.KneserNeyPair._shared(np.sort(keys))
    for c in np.unique(keys >> np.uint64(8)):
        assert p[np.sort(keys) >> np.uint64(8) == c].sum() <= 1 + 1e-9


def plain_kneser_ney(words, order=5, low=0.75, own=3.0):
    """Log-ratios of words by class-conditional Kneser-Ney models over bytes, with nothing but dictionaries.

    words: (word, class) pairs, as often as they come up. The longest contexts have counts of each class,
    the shorter ones numbers of different bytes in front, over both classes.
    """
    def grams(word):
        marked = (2, *word, 3)
        for i in range(1, len(marked)):
            yield marked[max(0, i - order) : i], marked[i]

    counts: dict = {}
    for w, c in words:
        for h, x in grams(w):
            counts.setdefault(h, {}).setdefault(x, [0, 0])[c] += 1
    tables: dict = {n: {} for n in range(order)}  # context length -> context -> byte -> number of bytes seen in front
    seen = {(h, x) for h, row in counts.items() for x in row}
    for n in range(order, 0, -1):
        level = {(h, x) for h, x in seen if len(h) == n}
        for h, x in level:
            row = tables[n - 1].setdefault(h[1:], {})
            row[x] = row.get(x, 0) + 1
        seen |= {(h[1:], x) for h, x in level}

    def shared(h, x):
        row = tables[len(h)][h]
        total = sum(row.values())
        lower = shared(h[1:], x) if h else 1 / 256
        return max(row[x] - low, 0) / total + low * len(row) / total * lower

    def ratio(word):
        out = 0.0
        for h, x in grams(word):
            row = counts.get(h)
            if row is None:
                continue
            p = []
            for c in (0, 1):
                n = sum(v[c] for v in row.values())
                rate = sum(min(v[c], own) for v in row.values()) / n if n else 1.0
                # a byte that neither class has seen here has the same lower probability in both, and it cancels
                p.append(rate if x not in row else (max(row[x][c] - own, 0) / n if n else 0) + rate * shared(h[1:], x))
            out += np.log(p[1] / p[0])
        return out

    return ratio


def test_models_against_plain_ones():
    rng = random.Random(3)
    letters = "abcé"
    text = lambda: [["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))).encode() for _ in range(rng.randint(0, 40))] for _ in range(20)]
    rows = [(ws + ([b"grmpf"] * 9 if c else []), c) for c in (0, 1) for ws in text()]
    want = plain_kneser_ney([(w, c) for ws, c in rows for w in ws])
    keys = []
    for c in (0, 1):
        g, _, _, _ = toxicity.grams_of([b" ".join(ws) for ws, k in rows if k == c])
        keys.append(g)
    gram = np.unique(np.concatenate(keys))
    n = [np.array([np.sum(k == g) for g in gram]) for k in keys]
    model = toxicity.KneserNeyPair(gram, *n)
    texts = [[b"grmpf", b"abc", b"zz", "éa".encode()], [b"ab"], [], [b"cab"] * 3 + [b"grm"]]
    got = model.evidence([b" ".join(t) for t in texts])
    for t, e in zip(texts, got, strict=True):
        r = [want(w) for w in t]
        expected = [sum(r) / len(r), max(r), *(sum(x for x in r if x > bar) / len(r) for bar in toxicity.BARS)] if r else [0.0] * 5
        assert np.allclose(e, expected, atol=1e-5), (t, e, expected)


def test_logistic_on_separable_sets():
    """Classes that a line parts, by little or by much, are told apart, and with scores beyond the threshold."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(40, 400))
        y = np.zeros(n)
        y[: int(rng.integers(4, n // 2))] = 1
        x = np.log(rng.uniform(0, 0.02, (n, 3)) + y[:, None] * rng.uniform(0.05, 0.5) + 0.02)
        p = toxicity.sigmoid(np.column_stack([x, np.ones(n)]) @ toxicity._logistic(x, y))
        assert p[y == 1].min() > 0.7 > 0.5 > p[y == 0].max()


@pytest.mark.parametrize("copies", [1, 6])
def test_toxic_rows_go_at_any_size(spark, copies):
    import corpus_pipeline

    make = lambda rng, y: " ".join(rng.choice(["the", "river", "élan", "walks"]) + rng.choice("abcdefgh") * rng.randint(0, 3) if not (y and rng.random() < 0.08) else rng.choice(["grumf", "blorg"]) + rng.choice("abcd") for _ in range(60))
    docs, labels = labelled(spark, make, 200 * copies)
    kept = corpus_pipeline.toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("toxic IS NOT NULL")
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in kept.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] > 0.9 * (counts[1, 1] + counts.get((1, 0), 0)) and counts.get((0, 1), 0) < 0.03 * counts[0, 0]


def test_quality(spark):
    make = lambda rng, y: " ".join(rng.choice(["the", "river", "runs", "far", "and", "wide."]) for _ in range(50)) if y else rng.choice(["BUY!! " * 40, "x | y | " * 30, "same same " * 30, "$$ %% ## " * 20])
    docs, labels = labelled(spark, make)
    out = quality.quality(docs, labels)
    assert out.count() == docs.count() and accuracy(out, labels, "quality") > 0.97
    flat = quality.quality(docs, labels.filter("quality = 1")).select("score").distinct().collect()
    assert len(flat) == 1 and quality.quality(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}


def plain_measures(raw):
    """The measures of one text, with nothing but Python."""
    words = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", raw) if w]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    size, n = max(len(raw), 1), max(len(words), 1)
    share = lambda chars: sum(raw.count(bytes([c])) for c in chars) / size
    alnum = lambda c: chr(c).isalnum() or c > 127
    lines = raw.split(b"\n")
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / n, math.log1p(max(map(len, words), default=0)),
        share(range(65, 91)), share(range(48, 58)), share(b".,;:'\"()-?!"), share(b"#$%&*+/<=>@[\\]^_`{|}~"), share(b"\n"), share(range(128, 256)),
        len(set(low)) / n, sum(a == b for a, b in itertools.pairwise(low)) / n, sum(not alnum(w[-1]) and w[-1] not in b".,;:" for w in words) / n,
        -sum(raw.count(bytes([c])) / size * math.log2(raw.count(bytes([c])) / size) for c in set(raw)), len(set(lines)) / len(lines) * bool(raw), math.log1p(len(words) / (1 + sum(raw.count(c) for c in (b".", b"!", b"?")))),
    ]


def test_quality_against_plain_python(spark):
    """Measures and sums of table entries as plain loops have them, through the operator, odd rows included."""
    rng = random.Random(21)
    texts = ["", " ", "a", "One two. two\nTwo!", "é" * 40, "x" * 3000, "#$ %% a,b; c"] + ["".join(rng.choice("ab C1.,#\n é") for _ in range(rng.randint(1, 300))) for _ in range(120)]
    got = quality.measures([t.encode() for t in texts])
    assert np.allclose(got, [plain_measures(t.encode()) for t in texts])
    docs = spark.createDataFrame([(k, t, "s", 0.5) for k, t in enumerate(texts)] + [(None, None, "s", 0.5)], "doc_id bigint, text string, label string, score double")
    y = {k: int("#" in t) for k, t in enumerate(texts)}
    labels = spark.createDataFrame(list(y.items()), "doc_id bigint, quality int")
    train = [k for k in sorted(y) if not held(k)]
    model = quality.AdditiveModel.fit(got[train], np.array([float(y[k]) for k in train]))

    def plain(row):
        at = [sum(c <= v for c in cuts) for v, cuts in zip(row, model.cuts, strict=True)]
        z = model.constant + sum(t[b] for t, b in zip(model.tables, at, strict=True)) + sum(t[at[i], at[j]] for (i, j), t in model.pairs.items())
        return 1 / (1 + math.exp(-max(-35, min(35, z))))

    want = {k: plain(plain_measures(t.encode())) for k, t in enumerate(texts)} | {None: plain(plain_measures(b""))}
    # the operator reads the rows in another order, which bins don't depend on
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == len(want) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-9 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def plain_contamination(docs, items, window=5, literal=2):
    """Matches of items in documents by the rules as they are stated, with dictionaries; texts of ASCII words."""
    def words(text):
        out, opens = [], True
        for m in re.finditer(r"[A-Za-z]+|[0-9]+|[.!?]", text):
            w = m[0]
            if w in ".!?":
                opens = True
                continue
            after = bool(out) and out[-1][1] == 1
            kind = 1 if w.isdigit() else 3 if after and w.lower() in decontamination.UNITS else 2 if w[0].isupper() and not opens else 0
            out.append((w.lower(), kind, w[0].isupper() and opens and kind == 0))
            opens = False
        return out

    def views(ws):
        """(place, whether a template, what is matched, slots) of all windows."""
        for at in range(max(1, len(ws) - window + 1) if ws else 0):
            some = ws[at : at + window]
            yield at, False, tuple(w for w, _, _ in some), ()
            for opening in (False, True):
                kinds = [4 if opening and o else k for _, k, o in some]
                n = sum(k > 0 for k in kinds)
                if n and len(some) - n >= literal and (not opening or 4 in kinds):
                    yield at, True, tuple(("slot", 2 if k == 4 else k) if k else w for (w, _, _), k in zip(some, kinds, strict=True)), tuple((k, w) for (w, _, _), k in zip(some, kinds, strict=True) if k)

    found, first = set(), {}
    for i, t in sorted(items):
        first.setdefault(tuple(words(t)) and tuple(w for w, _, _ in words(t)), i)
    for key, i in first.items():
        if not key:
            continue
        item = next(list(views(words(t))) for k, t in items if k == i)
        n = max(v[0] for v in item) + 1
        for d, t in docs:
            shifts: dict = {}
            for da, dt, dw, ds in views(words(t)):
                for a, tt, w, s in item:
                    if dt == tt and dw == w:
                        shifts.setdefault(da - a, []).append((a, tt, s, ds))
            at, runs = {}, 0
            for hits in shifts.values():
                values: dict = {}
                for _, template, s, ds in hits:
                    for (k, w), (_, x) in zip(s, ds, strict=True):
                        values.setdefault((2 if k == 4 else k, w), []).append((k != 4, x))
                torn = any(len({x for sure, x in v if sure}) > 1 for v in values.values())
                loose = {w for (k, w), v in values.items() if k == 2 and len({x for _, x in v}) > 1}
                good = [(a, template) for a, template, s, _ in hits if not template or not (torn or any(k == 4 and w in loose for k, w in s))]
                for a, template in good:
                    at[a] = min(at.get(a, True), template)
                places = sorted({a for a, _ in good})
                runs = max([runs, *(len(list(g)) for _, g in itertools.groupby(places, key=lambda a, p=places: a - p.index(a)))])
            if at and (len(at) / n >= 0.75 or runs >= decontamination.MIN_RUN - window + 1):
                found.add((d, i, len(at), sum(not x for x in at.values()), n))
    return found


def test_decontamination_against_plain_python(spark):
    rng = random.Random(8)
    common = ["the", "train", "took", "and", "cost", "of", "sold", "box", "red", "ran", "to", "for"]

    def text(n):
        out, start = [], True
        for _ in range(n):
            x = rng.random()
            w = str(rng.randint(1, 9)) if x < 0.15 else rng.choice(["Tom", "Ann", "Bob", "Sue"]) if x < 0.3 else rng.choice(["km", "kg"]) if x < 0.36 else rng.choice(common)
            out.append(w.capitalize() if start and rng.random() < 0.7 else w)
            start = rng.random() < 0.12
            if start:
                out[-1] += "."
        return " ".join(out)

    items = [(k, text(rng.randint(3, 45))) for k in range(12)]
    items.append((20, items[3][1].lower()))

    def reworded(t):
        names, numbers = dict(zip(["Tom", "Ann", "Bob", "Sue"], rng.sample(["Kim", "Joe", "Eva", "Tom"], 4), strict=True)), rng.random() < 0.8
        return re.sub(r"Tom|Ann|Bob|Sue", lambda m: names[m[0]], re.sub(r"[0-9]", lambda m: str((int(m[0]) + 3) % 10) if numbers else str(rng.randint(0, 9)), t))

    docs = [(k, text(rng.randint(0, 60))) for k in range(10)]
    for _, t in items:
        ws = t.split()
        for made in (t, reworded(t), " ".join(ws[: len(ws) * 4 // 5]), " ".join(w if rng.random() > 0.08 else "zz" for w in ws)):
            docs.append((len(docs), f"{text(6)}. {made} {text(5)}"))
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = plain_contamination(docs, items)
    assert {(r["doc_id"], r["item_id"], r["n_found"], r["n_exact"], r["n_windows"]) for r in got} == want
    assert sum(e < f for _, _, f, e, _ in want) > 3  # some are only found as templates


def test_pairs_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # neither measure says anything alone
    model = quality.AdditiveModel.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.9


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_run_whole(spark, name):
    table = "pages" if name in ("op7_url_cascade", "op10_warc_audit") else "documents"
    out = queries.QUERIES[name](spark, SF)
    n = out.count()
    assert n > 0 and (name.startswith(("op6", "op10")) or n == spark.read.parquet(f"{SF}/{table}.parquet").count())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, SF).cache()
        assert after.columns == docs.columns and 0 < after.count() <= left.count(), name
        left = after
    assert corpus_pipeline.run(spark, SF).count() == left.count()
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated rows, empty texts, long texts, clashing names and empty tables, for every stage."""
    import corpus_pipeline

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    names = ["__id", "__hash", "__gone", "k", "row", "node", "text_hash", "id", "raw", "hash"]
    toxic = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1"), "doc_id").filter("lang = 'en'").select("doc_id", "text").limit(2).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    texts = [(None, None), (1, None), (1, ""), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "A  b c d e f g"), (4, "a b c d e f g"), (None, "a b c d e f g"), (5, "long " * 200_000 + "end"), (6, "before it " + item + " after it"), (7, "quiet words about a river and its banks in spring"), *[(r[0], r[1]) for r in toxic]]
    df = spark.createDataFrame([(*r, "x") for r in texts], "doc_id bigint, text string, lang string").withColumns({n: F.lit(None).cast("string") for n in names})
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        kept[name] = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    gone = lambda name: sorted(((i, t) for i, t in texts if (i, t) not in kept[name]), key=str)
    assert gone("toxicity") == []  # hardly any of these rows has a label to learn from
    assert len(kept["exact dedup"]) == len({" ".join((t or "").split()) for _, t in texts})
    assert (2, "a b c d e f g") in kept["exact dedup"] and (1, None) in kept["exact dedup"] or (1, "") in kept["exact dedup"]
    assert [i for i, _ in gone("n-gram Jaccard join")] == [3, 4, None]
    assert [i for i, _ in gone("benchmark decontamination")] == [6]
    assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() == len(texts)
