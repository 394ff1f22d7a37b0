"""Byte-level BPE encoding and decoding by tree concatenation.

Texts up to a leaf's length are encoded as they are. A longer text is cut into leaves that are dealt
over the tasks and encoded apart from each other, whatever the cut goes through; the leaves' tokens are
then put together pairwise, as a tree, whose branches are joined in tasks of their own. At each join the words around it are split anew over a window
that doubles until both sides agree: on the left it starts at a word start that the cut can't have moved,
on the right it has reached a word start that the right side has, too, and from there on both split
alike. A word that goes through the join is put together from the tokens of its two parts in the same
way: growing windows of tokens are encoded again until the first and the last token of the window are
those that the sides have. Then each two neighbours in the result are neighbours in an encoding, which
for byte-pair merges means that the result is the encoding of the whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Characters of a leaf (longer texts are cut), and leaves of a branch that one task joins.
LEAF_CHARS, BRANCH_LEAVES = 32_768, 32
#: The split pattern looks no further ahead than this many characters.
_REACH = 3
#: Fixed value: how byte-level BPE splits text into words before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters behind the Latin letters.
_BEHIND_LATIN = re.compile("[\u0240-\U0010ffff]")


class Coder:
    """Encodes as the tokenizer file says: special tokens in a text count as such, none are added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        added = self.tok.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()) or self.tok.normalizer is not None:
            raise ValueError("only plain added tokens and no normaliser")
        self.special = {t.content: i for i, t in added.items()}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}
        own = self.tok.get_vocab()
        self.token_bytes = {i: (t.encode() if t in self.special else bytes(byte_of[c] for c in t)) for t, i in own.items()}
        self.names = {i: str(i) for i in self.token_bytes}
        self.fast = self._ranked(path)

    def _ranked(self, path: str):
        """A coder that merges by rank, if the file's merges are ranks of the merged tokens; else None.

        Any two neighbours whose bytes are a token merge then, while the file names one pair for each
        token; both come to the same since each token's bytes are encoded as that token.
        """
        import tiktoken

        with open(path) as f:
            told = json.load(f)
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        vocab, split = told["model"]["vocab"], told["pre_tokenizer"]
        if split != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or [vocab.get(a + b) for a, b in merges] != [256 + i for i in range(len(merges))]:
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={self.token_bytes[i]: i for i in vocab.values()}, special_tokens={})

    def many(self, texts: list[str]) -> list[list[int]]:
        """Tokens of each text. Text of no more than Latin letters goes to the faster coder: on those, all
        libraries agree about what is a letter, a digit or a space."""
        out: list = [None] * len(texts)
        if self.fast is not None:
            for i, t in enumerate(texts):
                if not _BEHIND_LATIN.search(t) and not any(s in t for s in self.special):
                    out[i] = self.fast.encode_ordinary(t)
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def decode(self, ids: list[int]) -> str:
        return self.tok.decode(ids, skip_special_tokens=False)

    def decoded_bytes(self, ids: list[int]) -> bytes:
        """The UTF-8 bytes of decode()."""
        raw = b"".join(map(self.token_bytes.__getitem__, ids))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return self.decode(ids).encode()
        return raw

    def parts(self, text: str):
        """Pieces of a text between special tokens, and the special tokens' ids."""
        if not any(s in text for s in self.special):
            return [text]
        out, at = [], 0
        while True:
            found = min(((k, -len(s), s) for s in self.special if (k := text.find(s, at)) >= 0), default=None)
            if found is None:
                return [*out, text[at:]]
            out += [text[at : found[0]], self.special[found[2]]]
            at = found[0] + len(found[2])

    def leaf(self, text: str) -> Segment:
        e = self.tok.encode(text, add_special_tokens=False)
        words, offsets = np.array(e.word_ids, np.int64), e.offsets
        first = np.flatnonzero(np.diff(words, prepend=-1))
        return Segment(text, np.array(e.ids, np.int32), np.array([offsets[i][0] for i in first], np.int64), first.astype(np.int64))

    def word_starts(self, text: str) -> list[int]:
        return [span[0] for _, span in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def one_word(self, left: np.ndarray, right: np.ndarray) -> list[int]:
        """Tokens of a word from those of its two parts."""
        k = 2
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            raw = b"".join(self.token_bytes[int(i)] for i in (*left[a:], *right[:b]))
            k *= 2
            try:
                ids = self.many([raw.decode()])[0]
            except UnicodeDecodeError:
                if a or b < len(right):
                    continue
                raise
            if (a == 0 or ids[0] == left[a]) and (b == len(right) or ids[-1] == right[b - 1]):
                return [*left[:a].tolist(), *ids, *right[b:].tolist()]

    def join(self, x: Segment, y: Segment) -> Segment:
        if not len(x.ids) or not len(y.ids):
            return y if not len(x.ids) else x
        seam, k = len(x.text), 2
        while True:
            # a word start of the left side that the cut can't have moved
            near = np.searchsorted(x.starts, seam - _REACH, "right") - 1
            p = max(0, near - k + 1)
            a = int(x.starts[p]) if near >= 0 else 0
            q = min(len(y.starts), k)
            b = seam + (int(y.starts[q]) if q < len(y.starts) else len(y.text))
            window = x.text[a:] + y.text[: b - seam]
            found = [a + s for s in self.word_starts(window)]
            theirs = {seam + int(s): i for i, s in enumerate(y.starts)}
            meet = next((s for s in found if s >= seam and s in theirs and s + _REACH <= b), None)
            whole = q == len(y.starts)
            if meet is not None or whole:
                break
            k *= 2
        stop, q = (meet, theirs[meet]) if meet is not None else (seam + len(y.text), len(y.starts))
        found = [s for s in found if s < stop]
        ends = [*found[1:], stop]
        p = p if near >= 0 else 0
        head, tail = int(x.firsts[p]) if near >= 0 else 0, int(y.firsts[q]) if q < len(y.starts) else len(y.ids)
        ids: list[int] = []
        starts, firsts = [], []
        plain = []
        for s, e in zip(found, ends, strict=True):
            starts.append(s)
            if s < seam < e and s == x.starts[-1] and (len(y.starts) == 1 or e == seam + y.starts[1]) and e - s > 64:
                t = int(y.firsts[1]) if len(y.starts) > 1 else len(y.ids)
                plain.append(self.one_word(x.ids[x.firsts[-1] :], y.ids[:t]))
            else:
                plain.append(window[s - a : e - a])
        encoded = iter(self.many([w for w in plain if isinstance(w, str)]))
        for w in plain:
            firsts.append(head + len(ids))
            ids += next(encoded) if isinstance(w, str) else w
        shift = head + len(ids) - tail
        return Segment(
            x.text + y.text,
            np.concatenate([x.ids[:head], np.array(ids, np.int32), y.ids[tail:]]),
            np.concatenate([x.starts[:p], np.array(starts, np.int64), y.starts[q:] + seam]),
            np.concatenate([x.firsts[:p], np.array(firsts, np.int64), y.firsts[q:] + shift]),
        )

    def tree(self, leaves: list[Segment]) -> Segment:
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0]

    def long(self, text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
        """Tokens of a text of any length, in this task alone."""
        ids: list[int] = []
        for part in self.parts(text):
            if isinstance(part, int):
                ids.append(part)
            elif part:
                ids += self.tree([self.leaf(part[i : i + leaf_chars]) for i in range(0, len(part), leaf_chars)]).ids.tolist()
        return ids


class Segment:
    """Text with its tokens, the character each word starts at, and the index of each word's first token."""

    __slots__ = ("firsts", "ids", "starts", "text")

    def __init__(self, text, ids, starts, firsts):
        self.text, self.ids, self.starts, self.firsts = text, ids, starts, firsts


def _packed(a: np.ndarray, ascending: bool) -> bytes:
    """The numbers, or their differences, in the smallest type that holds them."""
    if ascending:
        a = np.diff(a, prepend=0)
    size = next(n for n in (1, 2, 4) if not len(a) or int(a.max()) < 1 << (8 * n))
    return bytes([size]) + a.astype(f"<u{size}").tobytes()


def _unpacked(raw: bytes, ascending: bool) -> np.ndarray:
    a = np.frombuffer(raw[1:], f"<u{raw[0]}").astype(np.int64)
    return np.cumsum(a) if ascending else a


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """This worker's coder for a tokenizer file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _digests(own: Coder, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(",".join(map(own.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(own.decoded_bytes(ids)).hexdigest()


def _encoded(df: DataFrame, path: str, id_col: str, text_col: str, leaf_chars: int, outputs: list[tuple[str, str]], finish, branch_leaves: int = BRANCH_LEAVES) -> DataFrame:
    """finish(coder, ids) gives the values of the output columns for a row's tokens."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = ", ".join([f"id {kind}", *(f"{n} {t}" for n, t in outputs)])
    arrow = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def short(batches):
        own = coder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                piece = batch.slice(i, 256)
                done = [finish(own, ids) for ids in own.many(piece.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([piece.column("id"), *(pa.array([d[k] for d in done], arrow[t]) for k, (_, t) in enumerate(outputs))], ["id", *(n for n, _ in outputs)])

    def cut(batches):
        own = coder(path)
        for batch in batches:
            for i in range(batch.num_rows):
                one, text = batch.slice(i, 1), batch.column("text")[i].as_py()
                mark = hashlib.sha256(text.encode()).hexdigest()
                cells = []
                for n, part in enumerate(own.parts(text)):
                    if isinstance(part, int):
                        cells.append((n, 0, part, ""))
                    else:
                        cells += [(n, k // leaf_chars, -1, part[k : k + leaf_chars]) for k in range(0, len(part), leaf_chars)]
                at = pa.array([0] * len(cells))
                yield pa.RecordBatch.from_arrays([one.column("id").take(at), pa.array([mark] * len(cells)), *(pa.array([c[k] for c in cells], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.string())))], ["id", "mark", "part", "leaf", "special", "text"])

    def leaves(batches):
        own = coder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                piece = batch.slice(i, 64)
                made = [own.leaf(t) if s < 0 else Segment("", np.array([s], np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)) for t, s in zip(piece.column("text").to_pylist(), piece.column("special").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *(pa.array([_packed(getattr(m, f), f != "ids") for m in made], pa.binary()) for f in ("ids", "starts", "firsts"))], [*piece.schema.names, "ids", "starts", "firsts"])

    def segments(pdf: pd.DataFrame) -> list[Segment]:
        return [Segment(t, _unpacked(i, False).astype(np.int32), _unpacked(s, True), _unpacked(f, True)) for t, i, s, f in zip(pdf["text"], pdf["ids"], pdf["starts"], pdf["firsts"], strict=True)]

    def branch(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.drop_duplicates("leaf").sort_values("leaf")  # rows alike in id and text come with the same leaves
        one = coder(path).tree(segments(first))
        packed = {f: [_packed(getattr(one, f), f != "ids")] for f in ("ids", "starts", "firsts")}
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "mark": [pdf["mark"].iloc[0]], "part": [pdf["part"].iloc[0]], "leaf": [first["leaf"].iloc[0]], "copies": [len(pdf) // len(first)], "text": [one.text]} | packed)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        own, copies = coder(path), int(pdf["copies"].iloc[0])
        ids: list[int] = []
        for _, part in pdf.sort_values(["part", "leaf"]).groupby("part", sort=True):
            ids += own.tree(segments(part)).ids.tolist()
        done = finish(own, ids)
        return pd.DataFrame({"id": [pdf["id"].iloc[0]] * copies} | {n: [done[k]] * copies for k, (n, _) in enumerate(outputs)})

    piece, tokens = f"id {kind}, mark string, part int, leaf int", "ids binary, starts binary, firsts binary"
    few = rows.filter(F.length("text") <= leaf_chars).mapInArrow(short, schema)
    many = rows.filter(F.length("text") > leaf_chars).mapInArrow(cut, f"{piece}, special int, text string").repartition("id", "mark", "part", "leaf")
    many = many.mapInArrow(leaves, f"{piece}, special int, text string, {tokens}").drop("special")
    many = many.groupBy("id", "mark", "part", F.expr(f"leaf div {branch_leaves}")).applyInPandas(branch, f"{piece}, copies int, text string, {tokens}")
    many = many.groupBy("id", "mark").applyInPandas(whole, schema)
    return few.unionAll(many).withColumnRenamed("id", id_col)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, branch_leaves: int = BRANCH_LEAVES) -> DataFrame:
    """One row for each input row: the id and ids: array<int>, the tokens of the whole text.

    A null text counts as empty and has no tokens. Null ids and repeated rows stay as they are, an empty
    table gives none. A very long text is encoded and joined in many tasks, and its tokens come together in
    one at last, as the row that they are. Only the two named columns are read, whatever others are called.
    """
    return _encoded(df, path, id_col, text_col, leaf_chars, [("ids", "array<int>")], lambda own, ids: (ids,), branch_leaves)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """df with the text of its tokens; null tokens give a null text."""

    @F.pandas_udf("string")
    def text(ids):
        own = coder(path)
        return ids.map(lambda x: None if x is None else own.decode([int(i) for i in x]))

    return df.withColumn(text_col, text(F.col(ids_col)))


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """As encode(), then decoded: the id, n_tokens, ids_sha256, decoded_sha256; the tokens stay in their task."""
    return _encoded(df, path, id_col, text_col, leaf_chars, [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")], _digests)
