"""Quality by a generalised additive model with pairwise interactions.

Every text is described by a few measures. Boosting goes round the measures again and again and gives
each in turn a shallow tree on what the others leave unexplained; all trees of a measure add up to one
lookup table over its bins. Then the pairs of measures that explain most of the rest get tables over two
dimensions in the same way. A score is a sum of one table entry for each measure and each chosen pair.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import held_out, utf8
from pagewarden.llm.labelled import sample, sigmoid, training_labels
from pagewarden.llm.textwords import CHUNK, WHITE, byte_table, chunks, split_words

#: Labelled rows that the model is fitted on.
SAMPLE_ROWS = 30_000
MEASURES = ["log_bytes", "log_words", "word_bytes", "longest_word", "upper", "digit", "punctuation", "rare_signs", "line_ends", "non_ascii", "distinct_words", "repeated_words", "signs_at_word_end", "entropy", "distinct_lines", "words_per_stop"]
_TABLE = byte_table(WHITE)
_CLASS = np.zeros(256, np.int64)
for _k, _signs in enumerate((range(65, 91), range(48, 58), b".,;:'\"()-?!", b"#$%&*+/<=>@[\\]^_`{|}~", b"\n", range(128, 256)), 1):
    _CLASS[list(_signs)] = _k
_ALNUM = np.array([chr(b).isalnum() or b > 127 for b in range(256)])
_STOP = np.isin(np.arange(256), list(b".!?"))


def _histogram(text: bytes) -> np.ndarray:
    """How often each byte comes up, a megabyte at a time."""
    return sum((np.bincount(np.frombuffer(text, np.uint8, min(CHUNK, len(text) - i), i), minlength=256) for i in range(0, len(text), CHUNK)), np.zeros(256, np.int64))


def measures(raws: list[bytes]) -> np.ndarray:
    """One row for each text, one column for each of MEASURES; all 0 for an empty text."""
    out = np.zeros((len(raws), len(MEASURES)))
    for begin, some in chunks(raws):
        n = len(some)
        w = split_words(some, _TABLE)
        sizes = np.fromiter(map(len, some), np.int64, n)
        hist = np.stack([_histogram(x) for x in some])
        kinds = np.stack([hist[:, _CLASS == k].sum(1) for k in range(7)], 1)
        total, words = np.maximum(sizes, 1), np.maximum(w.counts, 1)
        length = w.end - w.start
        has = np.flatnonzero(w.counts)
        first = (np.cumsum(w.counts) - w.counts)[has]
        longest = np.zeros(n)
        if len(has):
            longest[has] = np.maximum.reduceat(length, first)
        order = np.lexsort((w.hash, w.text))
        t, h = w.text[order], w.hash[order]
        new = np.ones(len(h), bool)
        new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
        same = (w.text[1:] == w.text[:-1]) & (w.hash[1:] == w.hash[:-1])
        share = np.where(hist > 0, hist / total[:, None], 1.0)
        lines = [x.split(b"\n") for x in some]
        out[begin : begin + n] = np.stack(
            [
                np.log1p(sizes),
                np.log1p(w.counts),
                np.bincount(w.text, length, n) / words,
                np.log1p(longest),
                *(kinds[:, k] / total for k in range(1, 7)),
                np.bincount(t[new], minlength=n) / words,
                np.bincount(w.text[1:][same], minlength=n) / words,
                np.bincount(w.text, ~_ALNUM[w.raw[w.end - 1]] & ~np.isin(w.raw[w.end - 1], list(b".,;:")), n) / words,
                -(share * np.log2(share)).sum(1),
                np.array([len(set(x)) / len(x) for x in lines]) * (sizes > 0),
                np.log1p(w.counts / (1 + hist[:, _STOP].sum(1))),
            ],
            1,
        )
    return out


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, penalty: float = 1.0) -> np.ndarray:
    """Values over the bins of a tree of a few leaves, from sums of gradients and curvatures by bin."""
    parts = [(0, len(g))]
    gain = lambda a, b: a * a / (b + penalty)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            sg, sh = g[a:b].sum(), h[a:b].sum()
            gains = gain(cg, ch) + gain(sg - cg, sh - ch) - gain(sg, sh)
            i = int(gains.argmax())
            if gains[i] > best[0]:
                best = (gains[i], k, a + 1 + i)
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + penalty)
    return out


def _square(g: np.ndarray, h: np.ndarray, penalty: float = 1.0) -> tuple[float, np.ndarray]:
    """The best cut of a two-dimensional grid into four leaves, as its gain and the values over the grid."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gain, out = 0.0, np.zeros_like(g)

    def quarters(c):
        a, top, left, whole = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return a, top - a, left - a, whole - top - left + a

    q = [(x, y) for x, y in zip(quarters(cg), quarters(ch), strict=True)]
    gains = sum(x * x / (y + penalty) for x, y in q) - cg[-1, -1] ** 2 / (ch[-1, -1] + penalty)
    if gains.size:
        i, j = np.unravel_index(gains.argmax(), gains.shape)
        gain = float(gains[i, j])
        values = [x[i, j] / (y[i, j] + penalty) for x, y in q]
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return gain, out


class AdditiveModel:
    """Lookup tables over the bins of each measure and of a few pairs of measures."""

    def __init__(self, cuts, constant, tables, pairs):
        self.cuts, self.constant, self.tables, self.pairs = cuts, constant, tables, pairs

    @staticmethod
    def _binned(x, cuts):
        return [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8, rate: float = 0.1) -> AdditiveModel:
        cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]
        at = cls._binned(x, cuts)
        share = (y.sum() + 0.5) / (len(y) + 1)
        constant = float(np.log(share / (1 - share)))
        score = np.full(len(y), constant)
        tables = [np.zeros(len(c) + 1) for c in cuts]
        for _ in range(rounds):
            for j, table in enumerate(tables):
                p = sigmoid(score)
                step = rate * _tree(np.bincount(at[j], y - p, len(table)), np.bincount(at[j], p * (1 - p), len(table)))
                table += step
                score += step[at[j]]
        p = sigmoid(score)

        def grid(i, j, p):
            shape = (len(tables[i]), len(tables[j]))
            flat = at[i] * shape[1] + at[j]
            return _square(np.bincount(flat, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(flat, p * (1 - p), shape[0] * shape[1]).reshape(shape))

        ranked = sorted(itertools.combinations(range(len(cuts)), 2), key=lambda ij: -grid(*ij, p)[0])[:n_pairs]
        pairs = {ij: np.zeros((len(tables[ij[0]]), len(tables[ij[1]]))) for ij in ranked}
        for _ in range(pair_rounds):
            for (i, j), table in pairs.items():
                step = rate * grid(i, j, sigmoid(score))[1]
                table += step
                score += step[at[i], at[j]]
        return cls(cuts, constant, tables, pairs)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self._binned(x, self.cuts)
        z = np.full(len(x), self.constant)
        for j, table in enumerate(self.tables):
            z += table[at[j]]
        for (i, j), table in self.pairs.items():
            z += table[at[i], at[j]]
        return sigmoid(z)


def with_measures(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the kept columns and the measures of each row."""
    kinds = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            x = measures(batch.column("raw").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", *keep)), *(pa.array(x[:, k]) for k in range(len(MEASURES)))], ["id", *keep, *MEASURES])

    rows = df.select(F.col(id_col).alias("id"), *keep, utf8(text_col).alias("raw"))
    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}{kinds}, " + ", ".join(f"{m} double" for m in MEASURES))


def quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of docs: the id, held_out, score (0 to 1, higher is better), predicted.

    Labels of held-out rows, null labels and null ids are not learned from. A null text counts as empty;
    empty texts are scored like others, from measures that are all 0. Without labelled rows of both
    classes every score is the (smoothed) share of label 1, or 0.5 without any. Repeated rows get equal
    scores, an empty table none. A long text is measured whole, in arrays of one entry for each of its
    words. Other columns of docs are not read, whatever their names.
    """
    drawn = sample(docs.select(id_col).join(training_labels(labels, label_col, id_col), id_col), sample_rows, id_col).dropDuplicates([id_col])
    seen = with_measures(docs.select(id_col, text_col).join(F.broadcast(drawn.select(id_col, "label")), id_col), id_col, text_col, ("label",)).toPandas()
    y = seen["label"].to_numpy().astype(float)
    kind = docs.schema[id_col].dataType.simpleString()
    if len(set(y)) < 2:
        share = float((y.sum() + 0.5) / (len(y) + 1))
        scored = docs.select(F.col(id_col), F.lit(share).alias("score"))
    else:
        given = docs.sparkSession.sparkContext.broadcast(AdditiveModel.fit(seen[MEASURES].to_numpy(), y))

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(given.value.score(measures(batch.column("raw").to_pylist())))], ["id", "score"])

        scored = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("raw")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
    return scored.select(F.col(id_col), held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
