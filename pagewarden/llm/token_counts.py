"""Exact token counts at every prefix, by dynamic programming.

The vocabulary is a sentencepiece BPE model. No piece of such a model holds a word start behind another
character, and a character without a piece of its own stands alone (as its bytes), so text falls into
segments that are encoded independently: a run of spaces with the word behind it, which two characters
part further if no piece holds them side by side. Within a segment the table is filled from left to right. The encoding of a prefix
that ends at i is the encoding of a shorter prefix, that ends at j, followed by one piece [j:i], and it
is that one exactly when the last piece of the shorter prefix and the new piece stay as they are when
only the two are encoded together. So count[i] = count[j] + 1, and every prefix has its exact count.
A text's table is put together from those of its words, which are kept in a bounded cache, in blocks of
bounded size; its last entry is the text's count, and a budget is looked up in it. No text is encoded a
second time to answer a question.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import utf8

_SPACE = "▁"
#: Entries of each cache before it is emptied (of words, those before the last emptying are at hand, too), and characters of a word that is kept.
CACHE, KEPT_CHARS = 300_000, 64
#: Words of a block of a text's table.
BLOCK_WORDS = 200_000


def n_spaces(s: str) -> int:
    return len(s) - len(s.lstrip(_SPACE))


class _Cached(dict):
    """Values of a function, computed as they are asked for; a bounded number is kept."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, key):
        if len(key) > KEPT_CHARS:
            return self.compute(key)
        if len(self) >= CACHE:
            self.older = self.copy()
            self.clear()
        n = self.older.get(key)
        if n is None:
            n = self.compute(key)
        self[key] = n
        return n


class PrefixCounter:
    """Counts of tokens for a sentencepiece BPE model with byte fallback and without special tokens."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = [i for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        self.pieces = {self.sp.id_to_piece(i) for i in ids}
        if any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in self.pieces):
            raise ValueError("a piece of this model holds a word start behind another character")
        self.trie: dict = {}
        for p in self.pieces:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        probe = self.sp.encode("\n", out_type=str)
        self.dummy = bool(probe) and probe[0] == _SPACE
        self.lead = len(probe)
        self.stable: dict[str, dict[str, bool]] = {}
        self.n_stable = 0
        self.inner = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.words = _Cached(self._word)

    def _alone(self, joined: str) -> list[str]:
        """The pieces of a short string that isn't at a text's start; a line end before it keeps it apart."""
        return self.sp.encode("\n" + joined, out_type=str)[self.lead :]

    def _stays(self, last: str, piece: str) -> bool:
        if self.n_stable >= CACHE:
            self.stable.clear()
            self.n_stable = 0
        self.n_stable += 1
        stays = self.stable.setdefault(last, {})[piece] = self._alone(last + piece) == ([last, piece] if last else [piece])
        return stays

    def _word(self, word: str) -> bytes:
        """The table of a word behind one space, without its first entry. Two characters that no piece holds side by side part it."""
        s, inner, out, begin = _SPACE + word, self.inner, [0], 0
        for i in range(1, len(s) + 1):
            if i == len(s) or s[i - 1 : i + 1] not in inner:
                base = out[-1]
                out += [base + n for n in self._table(s[begin:i])[0][1:]]
                begin = i
        return np.array(out[1:], np.int32).tobytes()

    def segment_table(self, s: str) -> list[int]:
        """Token counts of the prefixes of a segment: entry i is that of s[:i]."""
        spaces = n_spaces(s)
        if spaces < 2:
            return self._table(s)[0]
        # Pieces of several spaces rank below all others: the spaces merge among themselves at the end,
        # and the last one is with them unless it has become part of the word's first piece by then.
        runs = [len(self._alone(_SPACE * i)) for i in range(1, spaces + 1)]
        tail, begin = self._table(s[spaces - 1 :])
        bare = [False, True]
        for j in begin[2:]:
            bare.append(j == 1 or (j > 1 and bare[j]))
        return [0, *runs, *(runs[-1] + t - 1 if b else runs[-2] + t for t, b in zip(tail[2:], bare[2:], strict=True))]

    def _table(self, s: str) -> tuple[list[int], list[int]]:
        """Counts of the prefixes of a segment with one leading space at most, and where their last pieces begin."""
        n, stable, start = len(s), self.stable, self.trie
        counts, last, begin = [-1] * (n + 1), [""] * (n + 1), [0] * (n + 1)
        counts[0] = 0
        for j in range(n):
            node = start.get(s[j])
            if node is None:  # a character without a piece
                counts[j + 1], begin[j + 1] = counts[j] + len(s[j].encode()), j
                continue
            before, i = last[j], j + 1
            known = stable.get(before)
            while True:
                piece = node.get("")
                if piece is not None and counts[i] < 0:
                    stays = known.get(piece) if known is not None else None
                    if stays is None:
                        stays = self._stays(before, piece)
                        known = stable.get(before)
                    if stays:
                        counts[i], last[i], begin[i] = counts[j] + 1, piece, j
                if i == n:
                    break
                node = node.get(s[i])
                if node is None:
                    break
                i += 1
        if min(counts) < 0:
            raise AssertionError(f"no piece ends a prefix of {s!r}")
        return counts, begin

    def _pieces(self, text: str):
        """Lists of tables, as bytes and without their first entries, that follow each other; the first holds the model's leading space."""
        table = lambda segment: np.array(self.segment_table(segment)[1:], np.int32).tobytes()
        line_end, held = np.array([1], np.int32).tobytes(), []
        for k, line in enumerate(text.replace(_SPACE, " ").split("\n")):
            if k:
                held.append(line_end)
            words = line.split(" ")
            if "" in words[1:] or (not words[0] and not k and self.dummy):  # several spaces in a row
                for s in re.findall(f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+", (_SPACE if self.dummy and not k else "") + line.replace(" ", _SPACE)):
                    held.append(self.words[s[1:]] if s[0] == _SPACE and len(s) > 1 and s[1] != _SPACE else table(s))
                    if len(held) >= BLOCK_WORDS:
                        yield held
                        held = []
            else:
                if k or not self.dummy:
                    if words[0]:
                        held.append(table(words[0]))
                    del words[0]
                for i in range(0, len(words), BLOCK_WORDS):
                    held += map(self.words.__getitem__, words[i : i + BLOCK_WORDS])
                    if len(held) >= BLOCK_WORDS:
                        yield held
                        held = []
            if len(held) >= BLOCK_WORDS:
                yield held
                held = []
        if held:
            yield held

    def blocks(self, text: str):
        """The text's table in blocks: arrays whose entries are the counts of the prefixes that end at consecutive characters, from the first."""
        base, skip = 0, int(self.dummy and bool(text))
        for held in self._pieces(text) if text else ():
            out = np.frombuffer(b"".join(held), np.int32).astype(np.int64)
            size = np.fromiter(map(len, held), np.int64, len(held)) // 4
            last = out[np.cumsum(size) - 1]
            ahead = base + np.cumsum(last) - last
            out += np.repeat(ahead, size)
            base = int(out[-1])
            yield out[skip:]
            skip = 0

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of all prefixes of a text by characters; entry i is that of text[:i]."""
        return np.concatenate([np.zeros(1, np.int64), *self.blocks(text)])

    def answers(self, text: str, budget: int) -> tuple[int, int]:
        """(tokens of the text, characters of its longest prefix within the budget), both read from its table."""
        total, fits, at = 0, 0, 0
        for block in self.blocks(text):
            if len(block):
                total = int(block[-1])
                within = np.flatnonzero(block <= budget)
                fits = at + int(within[-1]) + 1 if len(within) else fits
                at += len(block)
        return total, fits

    def count(self, text: str) -> int:
        """The last entry of the text's table."""
        return self.answers(text, 0)[0]

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most budget tokens, read from the table of prefixes."""
        return text[: self.answers(text, budget)[1]]


_counters: dict[str, PrefixCounter] = {}


def counter(model_path: str) -> PrefixCounter:
    """This worker's counter for a model."""
    if model_path not in _counters:
        _counters[model_path] = PrefixCounter(model_path)
    return _counters[model_path]


def token_counts(df: DataFrame, model_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), prefix_chars.

    All are read from the table of the text's prefixes: n_tokens is its last entry, prefix_chars the number
    of characters of the longest prefix of at most `limit` tokens. A null text counts as empty, with no
    tokens. Texts of any length are read whole, their tables in blocks; words of more than KEPT_CHARS
    characters aren't kept. Strings that name special tokens are ordinary text. Repeated rows give repeated
    results, an empty table none. Other columns are not read, whatever their names.
    """

    def run(batches):
        own = counter(model_path)
        for batch in batches:
            n = [own.answers(t.decode(), limit) for t in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *(pa.array([x[k] for x in n], pa.int64()) for k in (0, 1))], ["id", "n_bytes", "n_tokens", "prefix_chars"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), utf8(text_col).alias("raw")).withColumn("n_bytes", F.length("raw").cast("bigint"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, prefix_chars bigint").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "prefix_chars")


def prefix_tables(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """df with prefix_tokens: array<int>, whose entry i is the token count of the first i characters."""

    @F.pandas_udf("array<int>")
    def tables(texts):
        own = counter(model_path)
        return texts.map(lambda t: own.prefix_counts(t or "").tolist())

    return df.withColumn("prefix_tokens", tables(F.col(text_col)))


def fits_budget(table: F.Column, start: F.Column, end: F.Column, budget: int) -> F.Column:
    """Whether the tokens that text[:end] has more than text[:start] are at most budget, from a prefix table."""
    return F.element_at(table, end + 1) - F.element_at(table, start + 1) <= budget


def truncate_to_budget(df: DataFrame, budget: int, text_col: str = "text", table_col: str = "prefix_tokens") -> DataFrame:
    """df with the text cut to its longest prefix of at most budget tokens, from its prefix table alone."""
    within = F.array_max(F.filter(F.sequence(F.lit(0), F.size(table_col) - 1), lambda i: F.element_at(F.col(table_col), i + 1) <= budget))
    return df.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.substring(F.col(text_col), F.lit(1), within)))
