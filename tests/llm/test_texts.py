"""Tokens, copies and pieces of text against the libraries themselves and plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewarden.llm import bpe, exact_dedup, textwords, token_counts
from pagewarden.llm.queries import tokenizer_path

BPE, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "\n", "a", "  two  spaces ", "it's  we're", "<|endoftext|>", "a<|endoftext|>b <|endof", "é́ ｆ 梦😀", "x" * 300, " " * 90 + "y", "日本語テキスト" * 20, "a▁b", "<s> </s><0x0A>", "\x00\x7f"]


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(BPE)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(PIECES)


def noise(seed, n, chars="ab the 　\n\t've梦😀ßñ0123.,;:<>%$#\"-=_  "):
    rng = random.Random(seed)
    return ["".join(rng.choice(chars) for _ in range(rng.randint(0, 200))) for _ in range(n)]


def test_tree_encodes_like_the_library(coder):
    plain = lambda t: coder.tok.encode(t, add_special_tokens=False).ids
    rng = random.Random(2)
    texts = ODD + noise(1, 300) + ["".join(rng.choice("abetheinro") for _ in range(700)) for _ in range(40)]
    for t in texts:
        want = plain(t)
        assert coder.many([t])[0] == want
        for leaf in (3, 17, 64):
            assert coder.long(t, leaf) == want
        assert coder.decoded_bytes(want).decode() == coder.decode(want)


def test_fast_path_agrees_on_all_it_takes(coder):
    for cp in range(0x240):
        c = chr(cp)
        for t in (f"a{c}b", f" {c}", c * 2, f"1{c}2", f"{c} x", f"'{c}s", f"  {c}", f"{c}  {c}", f"x\n{c}"):
            assert coder.fast.encode_ordinary(t) == coder.tok.encode(t, add_special_tokens=False).ids


def test_encoding_of_tables(spark, coder):
    rows = [(k, t, "x") for k, t in enumerate(ODD + noise(3, 30))] + [(None, None, "x"), (3, "a", "x"), (3, "a", "x"), (5, "word " * 200, "y"), (5, "word " * 200, "y"), (None, "x" * 90, "x"), (None, "x" * 90, "x"), (6, "ab<|endoftext|>" * 40, "z")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, ids string, leaf int")
    want = sorted(((k, tuple(coder.tok.encode(t or "", add_special_tokens=False).ids)) for k, t, _ in rows), key=str)
    got = bpe.encode(df, BPE, leaf_chars=40)
    deep = bpe.encode(df, BPE, leaf_chars=7, branch_leaves=3)
    assert sorted(((r["doc_id"], tuple(r["ids"])) for r in deep.collect()), key=str) == want
    assert sorted(((r["doc_id"], tuple(r["ids"])) for r in got.collect()), key=str) == want
    assert {r["text"] for r in bpe.decode(got, BPE).collect()} == {t or "" for _, t, _ in rows}
    digests = bpe.encode_digests(df, BPE, leaf_chars=40).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in digests), key=str) == sorted(((k, len(i), sha(",".join(map(str, i)))) for k, i in want), key=str)
    assert bpe.encode_digests(df.limit(0), BPE).count() == 0


def test_every_prefix_has_its_count(counter):
    for t in ODD + noise(4, 150):
        counts = counter.prefix_counts(t)
        assert counter.count(t) == counts[-1] == len(counter.sp.encode(t))
        for i in random.Random(len(t)).sample(range(len(t) + 1), min(len(t) + 1, 12)):
            assert counts[i] == len(counter.sp.encode(t[:i]))


def test_tables_in_blocks(counter, monkeypatch):
    """Blocks of any size give the same table; long words and long texts without spaces aren't kept."""
    texts = [t * 3 for t in ODD + noise(6, 40)] + ["x" * 5000, "日本" * 3000, "ab" * 40 + " " + "cd" * 40, " \n " * 50]
    whole = [counter.prefix_counts(t) for t in texts]
    for size in (1, 3):
        monkeypatch.setattr(token_counts, "BLOCK_WORDS", size)
        assert all(np.array_equal(counter.prefix_counts(t), w) for t, w in zip(texts, whole, strict=True))
    assert all(len(w) <= token_counts.KEPT_CHARS for w in counter.words)
    for t, w in zip(texts, whole, strict=True):
        assert len(w) == len(t) + 1 and w[-1] == len(counter.sp.encode(t))
        for budget in (0, 1, 7, 40):
            assert counter.answers(t, budget) == (w[-1], int(np.flatnonzero(w <= budget)[-1]))


def test_token_counts_of_tables(spark, counter):
    rows = [(k, t) for k, t in enumerate(ODD + noise(5, 20))] + [(None, None), (1, "a b"), (1, "a b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_tokens int")
    got = token_counts.token_counts(df, PIECES, 5).collect()
    want = [(k, len((t or "").encode()), len(counter.sp.encode(t or ""))) for k, t in rows]
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["over_limit"] == (r["n_tokens"] > 5) for r in got)
    fits = {str(r["doc_id"]): r["prefix_chars"] for r in got if r["doc_id"] != 1}
    assert all(fits[str(k)] == max(i for i in range(len(t or "") + 1) if len(counter.sp.encode((t or "")[:i])) <= 5) for k, t in rows if k != 1)
    assert token_counts.token_counts(df.limit(0), PIECES, 5).count() == 0
    tables = token_counts.prefix_tables(df.filter("text IS NOT NULL"), PIECES)
    for r in token_counts.truncate_to_budget(tables.select("doc_id", "text", "prefix_tokens"), 4).collect():
        assert len(counter.sp.encode(r["text"])) <= 4
    assert counter.truncate("one two three four", 2) == max((t for t in ("one two three four"[:i] for i in range(19)) if len(counter.sp.encode(t)) <= 2), key=len)


@pytest.mark.parametrize("bound", [400, 1 << 20])
def test_trie_against_a_dictionary(bound):
    rng = random.Random(7)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) * rng.choice([1, 1, 5]) for _ in range(800)]
    trie, want = exact_dedup.PatriciaTrie(bound), {}
    for i, k in enumerate(keys):
        least = None if i % 50 == 0 else rng.randint(0, 10_000)
        trie.add(k.encode(), least)
        known = want.setdefault(k.encode(), [None, 0])
        known[0] = least if known[0] is None else known[0] if least is None else min(known[0], least)
        known[1] += 1
    got = list(trie.items())
    assert len(got) == len(want) and {k: [a, n] for k, a, n in got} == want


def test_exact_duplicates(spark):
    rng = random.Random(8)
    texts = [None, "", " ", "\t\n", "a  b", "a b", "a\x0bb", "a\xa0b", "A b", "x" * 5000, "x" * 5000 + " ", "long " * 3000]
    rows = [(rng.randint(0, 10**6), rng.choice(texts), "z") for _ in range(300)] + [(7, "a b", "z")] * 3 + [(None, "a b", "z"), (None, "alone", "z"), (None, "alone", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, keep_id string")
    got = exact_dedup.exact_duplicates(df, trie_bytes=2000).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict = {}
    for k, t, _ in rows:
        groups.setdefault(norm(t), []).append(k)
    want = sorted(((k, min((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for k, t, _ in rows), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    assert sum(r["kept"] for r in got) == len(groups)
    clashing = df.withColumn("__id", F.lit(1)).withColumn("k", F.lit(2)).withColumn("row_hash", F.lit("h"))
    kept = exact_dedup.without_duplicates(clashing.drop("__id"))
    assert kept.columns == [*df.columns, "k", "row_hash"] and kept.count() == len(groups)
    assert {(norm(r["text"]), r["doc_id"]) for r in kept.collect()} == {(g, min((x for x in ids if x is not None), default=None)) for g, ids in groups.items()}
    assert exact_dedup.without_duplicates(df.limit(0)).count() == 0
    many = spark.createDataFrame([(k, "same") for k in range(400)] + [(1000, "other")], "doc_id bigint, text string")
    assert {(r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(many).collect()} == {(0, 400), (1000, 1)}
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


def test_words_and_windows():
    table = textwords.byte_table()
    texts = [b"", b" a  Bc\td ", b"one", b"\n", b"x" * 1000 + b" y", "é à".encode(), b"a Bc d", b"a\xc2\xa0b"]
    w = textwords.split_words(texts, table)
    words = [t.lower().split() for t in texts]
    assert [w.folded[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)] == [x for ws in words for x in ws]
    assert w.counts.tolist() == [len(ws) for ws in words]
    flat = [x for ws in words for x in ws]
    assert all((flat[i] == flat[j]) == (w.hash[i] == w.hash[j]) for i in range(len(flat)) for j in range(len(flat)))
    h, text, at = textwords.windows(w.hash, w.text, w.counts, 3)
    grams = [tuple(ws[k : k + 3]) for ws in words for k in range(max(1, len(ws) - 2)) if ws]
    assert len(h) == len(grams) and all((grams[i] == grams[j]) == (h[i] == h[j]) for i in range(len(h)) for j in range(len(h)))
    assert textwords.lowered("ÀÉİx".encode()) == "àéİx".encode()
    assert sum(len(c) for _, c in textwords.chunks([b"a"] * 10, 4)) == 10
    assert np.all(np.diff(at) >= 0) and zlib.crc32(b"") == 0
