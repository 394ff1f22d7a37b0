"""Toxicity by class-conditional Kneser-Ney models of how words are written.

A word is a sequence of bytes between a start and an end mark, and a model gives each byte's probability
from up to five before it. The two classes have interpolated Kneser-Ney models with counts of their own
for the longest contexts, and one shared model behind them: continuation counts over both classes, which
smooth whatever is rare in either. Counts come from every labelled row that isn't held out. A class's own
counts are discounted by more than the shared ones, so what a class has seen two or three times, by chance
as likely as not, is left to the shared model. Where both classes back off, it cancels out of the ratio of
the likelihoods, so a byte's log-ratio is known from two tables: one of the grams that a class has seen,
one of the contexts.

A document is judged by the log-ratio of its likelihoods, divided by its number of words. The ratios of
ordinary words add up to noise, which would drown a few toxic expressions in a long text; so the sum is
taken over the words whose own ratio is above a bar, once for each of a few bars, and always divided by the
number of all words. A logistic curve turns these ratios into a score; it is fitted on a bounded sample of
labelled rows, each scored by models that haven't seen its fold.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm.common import frozen, held_out, utf8
from pagewarden.llm.labelled import sample, sigmoid, training_labels
from pagewarden.llm.textwords import PUNCTUATION, WHITE, byte_table, chunks, mix, split_words

#: Labelled rows on which the logistic curve is fitted.
SAMPLE_ROWS = 20_000
#: Grams (40 bytes each) up to which they go to the driver and the texts; with more, the texts' words go to them.
MAX_GRAMS = 4_000_000
#: Labels (about 24 bytes each) up to which they go to the texts rather than the texts to them.
MAX_SENT_LABELS = 2_000_000
THRESHOLD = 0.7
#: Log-ratios above which a word's own counts, and what is added to the normalised ratios ahead of the logarithm.
BARS, RATIO_FLOOR = (1.0, 2.0, 3.0), 0.02
_CONTEXT, _START, _END = 5, 2, 3
#: What is taken off the shared model's counts, and off those of a class.
_DISCOUNT, _CLASS_DISCOUNT = 0.75, 3.0
_TABLE = byte_table(WHITE + PUNCTUATION)
_CONTEXT_BITS = np.uint64(8)
#: A document's normalised ratios, one for each bar, and with them two that are only told.
_RATIOS = [f"ratio_above_{k}" for k in range(len(BARS))]
_EVIDENCE = ["mean_ratio", "peak_ratio", *_RATIOS]


def grams_of(raws: list[bytes]):
    """(gram, text, word) of each byte and end mark of each word: the context's bytes above that byte, as one number."""
    w = split_words(raws, _TABLE)
    size = w.end - w.start
    at = np.cumsum(size + 2) - (size + 2)
    total = int((size + 2).sum())
    marked = np.empty(total, np.uint64)
    word = np.repeat(np.arange(len(size)), size + 2)
    rel = np.arange(total) - at[word]
    inner = (rel > 0) & (rel <= size[word])
    marked[inner] = w.folded[(w.start[word] + rel - 1)[inner]]
    marked[at], marked[at + size + 1] = _START, _END
    gram = marked.copy()
    for j in range(1, _CONTEXT + 1):
        has = rel >= j
        has[:j] = False
        gram[has] |= marked[np.flatnonzero(has) - j] << np.uint64(8 * j)
    keep = rel > 0
    return gram[keep], w.text[word[keep]], word[keep], w


def _lengths(contexts: np.ndarray) -> np.ndarray:
    return sum(((contexts >> np.uint64(8 * j)) > 0).astype(np.int64) for j in range(_CONTEXT))


class Lookup:
    """Values by 64-bit key, for whole arrays of keys at once; 0 for other keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        slot = (mix(keys) >> self.shift).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        self.keys, self.values = np.append(keys[order], np.uint64(0)), np.append(values[order], 0.0).astype(np.float32)
        self.begin = np.searchsorted(slot[order], np.arange((1 << bits) + 1)).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)"""
        slot = (mix(keys) >> self.shift).astype(np.int64)
        at, end = self.begin[slot], self.begin[slot + 1]
        hit = (at < end) & (self.keys[at] == keys)
        values = np.where(hit, self.values[at], np.float32(0))
        rest = np.flatnonzero(~hit & (at + 1 < end))
        at = at[rest] + 1
        while len(rest):
            same = self.keys[at] == keys[rest]
            values[rest[same]] = self.values[at[same]]
            hit[rest[same]] = True
            at += 1
            going = ~same & (at < end[rest])
            rest, at = rest[going], at[going]
        return values, hit


class KneserNeyPair:
    """Log-ratios of the toxic to the ordinary model, from counts of grams in either class."""

    def __init__(self, gram: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray):
        order = np.argsort(gram)
        gram, counts = gram[order], (ordinary[order].astype(float), toxic[order].astype(float))
        context, at = np.unique(gram >> _CONTEXT_BITS, return_inverse=True)
        shared = self._shared(gram)
        rates, p = [], []
        for c in counts:
            n = np.bincount(at, c, len(context))
            rate = np.where(n > 0, np.bincount(at, np.minimum(c, _CLASS_DISCOUNT), len(context)) / np.maximum(n, 1), 1.0)
            rates.append(rate)
            p.append(np.maximum(c - _CLASS_DISCOUNT, 0) / np.maximum(n, 1)[at] + rate[at] * shared)
        self.grams = Lookup(gram, np.log(p[1] / p[0]))
        self.contexts = Lookup(context, np.log(rates[1] / rates[0]))

    @staticmethod
    def _shared(gram: np.ndarray) -> np.ndarray:
        """The shared model's probability of each gram's byte after its context without the first byte."""
        longest = _lengths(gram >> _CONTEXT_BITS)
        seen = [np.zeros(0, np.uint64)] * (_CONTEXT + 1)  # grams by length of the context, seen or left over from longer ones
        after: list[tuple[np.ndarray, np.ndarray]] = []  # for each length: grams and numbers of different bytes before them
        for n in range(_CONTEXT, 0, -1):
            seen[n] = np.unique(np.concatenate([seen[n], gram[longest == n]]))
            shorter, times = np.unique(seen[n] & np.uint64((1 << (8 * n)) - 1), return_counts=True)
            seen[n - 1] = shorter
            after.append((shorter, times.astype(float)))
        below: tuple[np.ndarray, np.ndarray] | None = None
        uniform = 1 / 256
        by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, (keys, times) in zip(range(_CONTEXT), reversed(after), strict=True):  # contexts of n bytes
            ctx, at = np.unique(keys >> _CONTEXT_BITS, return_inverse=True)
            total, types = np.bincount(at, times), np.bincount(at)
            if below is None:
                lower = np.full(len(keys), uniform)
            else:
                lower = below[1][np.searchsorted(below[0], keys & np.uint64((1 << (8 * n)) - 1))]
            p = np.maximum(times - _DISCOUNT, 0) / total[at] + _DISCOUNT * types[at] / total[at] * lower
            below = by_length[n] = (keys, p)
        out = np.full(len(gram), uniform)
        for n in range(1, _CONTEXT + 1):
            own = np.flatnonzero(longest == n)
            keys, p = by_length[n - 1]
            out[own] = p[np.searchsorted(keys, gram[own] & np.uint64((1 << (8 * n)) - 1))]
        return out

    def evidence(self, raws: list[bytes]) -> np.ndarray:
        """For each text: mean log-ratio of its words, the largest of one word, and the mean with only those above each of BARS."""
        out = np.zeros((len(raws), len(_EVIDENCE)))
        for begin, some in chunks(raws):
            gram, _, word, w = grams_of(some)
            ratio, found = self.grams(gram)
            rest = np.flatnonzero(~found)
            ratio[rest] = self.contexts(gram[rest] >> _CONTEXT_BITS)[0]
            if not len(w.start):
                continue
            by_word = np.bincount(word, ratio, len(w.start))
            n = w.counts
            has = np.flatnonzero(n)
            out[begin + has, 0] = np.bincount(w.text, by_word, len(some))[has] / n[has]
            out[begin + has, 1] = np.maximum.reduceat(by_word, (np.cumsum(n) - n)[has])
            for k, bar in enumerate(BARS):
                out[begin + has, 2 + k] = np.bincount(w.text, np.where(by_word > bar, by_word, 0), len(some))[has] / n[has]
        return out


def _counted(batches):
    """Counts of grams by fold and class in this task's rows: gram, n00, n01, n20, n21."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        keys = np.concatenate([k for k, _ in held]) if held else np.zeros(0, np.uint64)
        gram, at = np.unique(keys, return_inverse=True)
        n = np.stack([np.bincount(at, np.concatenate([c[:, k] for _, c in held]), len(gram)) for k in range(4)], 1) if held else np.zeros((0, 4))
        return gram, n

    for batch in batches:
        raws, kinds = batch.column("raw").to_pylist(), batch.column("kind").to_numpy()
        for begin, some in chunks(raws):
            gram, text, _, _ = grams_of(some)
            key, at = np.unique(gram, return_inverse=True)
            kind = kinds[begin : begin + len(some)][text]
            held.append((key, np.stack([np.bincount(at[kind == k], minlength=len(key)) for k in range(4)], 1)))
            if sum(len(k) for k, _ in held) > 2_000_000:
                held = [merged()]
    gram, n = merged()
    for i in range(0, len(gram), 100_000):
        part = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(gram[part].astype(np.int64)), *(pa.array(n[part, k].astype(np.int64)) for k in range(4))], ["gram", "n00", "n01", "n20", "n21"])


def gram_counts(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of all grams in all training rows, by fold (0, 2) and class (0, 1)."""
    few = train.count() <= MAX_SENT_LABELS
    rows = docs.select(F.col(id_col), utf8(text_col).alias("raw")).join(F.broadcast(train) if few else train, id_col).select("raw", (F.col("fold") + F.col("label")).cast("int").alias("kind"))
    counts = rows.mapInArrow(_counted, "gram bigint, n00 bigint, n01 bigint, n20 bigint, n21 bigint")
    return counts.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n00", "n01", "n20", "n21")])


def _tail(gram: str, n: int):
    """The gram's last n bytes."""
    return F.col(gram).bitwiseAND(F.lit((1 << (8 * n)) - 1))


def ratio_tables(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """KneserNeyPair's two tables (gram, ratio and context, ratio) from gram, ordinary, toxic, for any number of grams.

    All sums are over the bytes that follow or precede a context, 256 rows at most.
    """
    context = F.shiftright("gram", 8)
    longest = sum(((F.shiftright("gram", 8 * (j + 1)) > 0).cast("int") for j in range(_CONTEXT)), F.lit(0))
    grams = frozen(counts.filter("ordinary + toxic > 0").select("gram", "ordinary", "toxic", context.alias("context"), longest.alias("longest")))
    left, after = None, []
    for n in range(_CONTEXT, 0, -1):
        own = grams.filter(F.col("longest") == n).select("gram")
        seen = own if left is None else left.select("gram").unionByName(own).distinct()
        left = frozen(seen.groupBy(_tail("gram", n).alias("gram")).agg(F.count(F.lit(1)).cast("double").alias("times")))
        after.append(left)
    uniform = F.lit(1 / 256)
    parts, below = [grams.filter("longest = 0").withColumn("shared", uniform)], None
    group = Window.partitionBy(context)
    for n, rows in enumerate(reversed(after)):  # contexts of n bytes
        rows = rows.select("gram", "times", F.sum("times").over(group).alias("total"), F.count(F.lit(1)).over(group).alias("types"))
        if below is None:
            rows = rows.withColumn("lower", uniform)
        else:
            rows = rows.withColumn("tail", _tail("gram", n)).join(below.select(F.col("gram").alias("tail"), F.col("p").alias("lower")), "tail")
        p = F.greatest(F.col("times") - _DISCOUNT, F.lit(0.0)) / F.col("total") + F.lit(_DISCOUNT) * F.col("types") / F.col("total") * F.col("lower")
        below = frozen(rows.select("gram", p.alias("p")))
        own = grams.filter(F.col("longest") == n + 1).withColumn("tail", _tail("gram", n + 1))
        parts.append(own.join(below.select(F.col("gram").alias("tail"), F.col("p").alias("shared")), "tail").select(*grams.columns, "shared"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)

    def rate(c, over):
        n, left = F.sum(c), F.sum(F.least(F.col(c).cast("double"), F.lit(_CLASS_DISCOUNT)))
        n, left = (n, left) if over is None else (n.over(over), left.over(over))
        return F.when(n > 0, left / F.greatest(n, F.lit(1))).otherwise(F.lit(1.0)), F.greatest(n, F.lit(1))

    def p(c):
        share, n = rate(c, Window.partitionBy("context"))
        return F.greatest(F.col(c) - _CLASS_DISCOUNT, F.lit(0.0)) / n + share * F.col("shared")

    contexts = grams.groupBy("context").agg(F.log(rate("toxic", None)[0] / rate("ordinary", None)[0]).cast("float").alias("ratio"))
    return frozen(rows.select("gram", F.log(p("toxic") / p("ordinary")).cast("float").alias("ratio"))), frozen(contexts)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weights of the columns of x and a constant, by Newton steps on the penalised likelihood, halved until it grows."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    loss = lambda w: (np.logaddexp(0, x @ w) - y * (x @ w)).sum() + w @ ridge @ w / 2
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        while np.abs(step).max() >= 1e-6 and loss(w + step) > loss(w):
            step = step / 2
        if np.abs(step).max() < 1e-6:
            break
        w += step
    return w


def _scored(docs: DataFrame, model: KneserNeyPair, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            e = given.value.evidence(batch.column("raw").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ["id", *keep]), *(pa.array(x) for x in e.T)], ["id", *keep, *_EVIDENCE])

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(F.col(id_col).alias("id"), *keep, utf8(text_col).alias("raw"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}{kinds}, {', '.join(f'{c} double' for c in _EVIDENCE)}")


def _words(batches):
    """The different words of each text and how often it has them."""
    for batch in batches:
        for begin, some in chunks(batch.column("raw").to_pylist()):
            w = split_words(some, _TABLE)
            n = Counter((t, w.folded[a:b].tobytes()) for t, a, b in zip(w.text.tolist(), w.start.tolist(), w.end.tolist(), strict=True))
            at = pa.array([begin + t for t, _ in n], pa.int64())
            cols = [pa.array([word for _, word in n], pa.binary()), pa.array(n.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("hash").take(at), *cols], ["id", "hash", "word", "n"])


def _spelt(batches):
    """The grams of each word."""
    for batch in batches:
        for begin, some in chunks(batch.column("word").to_pylist()):
            gram, text, _, _ = grams_of(some)
            for i in range(0, len(gram), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(begin + text[part])), pa.array(gram[part].astype(np.int64))], ["word", "gram"])


def _joined(docs: DataFrame, grams: DataFrame, contexts: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """What _scored gives, with the tables of the models joined to the grams of the texts' different words."""
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), *keep, F.xxhash64(utf8(text_col)).alias("hash"), utf8(text_col).alias("raw"))
    words = docs.select("id", "hash", "raw").mapInArrow(_words, f"id {kind}, hash bigint, word binary, n bigint")
    spelt = words.select("word").distinct().mapInArrow(_spelt, "word binary, gram bigint").withColumn("context", F.shiftright("gram", 8))
    spelt = spelt.join(grams.withColumnRenamed("ratio", "own"), "gram", "left").join(contexts.withColumnRenamed("ratio", "backed"), "context", "left")
    ratios = spelt.groupBy("word").agg(F.sum(F.coalesce("own", "backed", F.lit(0.0)).cast("double")).alias("ratio"))
    # equal rows count each word as many times more, which leaves means and maxima as they are
    found = words.join(ratios, "word").groupBy(F.col("id").alias("__id"), F.col("hash").alias("__hash"))
    found = found.agg((F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("mean_ratio"), F.max("ratio").alias("peak_ratio"), *[(F.sum(F.when(F.col("ratio") > bar, F.col("n") * F.col("ratio")).otherwise(F.lit(0.0))) / F.sum("n")).alias(c) for c, bar in zip(_EVIDENCE[2:], BARS, strict=True)])
    rows = docs.drop("raw").join(found, F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")), "left")
    return rows.select("id", *keep, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in _EVIDENCE])


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, max_grams: int = MAX_GRAMS, keep_text_hash: bool = False) -> DataFrame:
    """One row for each row of docs: the id, held_out, score (0 to 1), predicted, mean_ratio, peak_ratio.

    Labels of held-out rows, null labels and null ids are not learned from. A null text counts as empty;
    a text without words has ratios of 0. Without labelled rows of both classes every score is the
    (smoothed) share of toxic ones, or 0 if there are no labels. Repeated rows get equal scores, those with
    a null id included. An empty table gives an empty result. Very long texts are read whole, one at a time
    in a few arrays of their length. With keep_text_hash there is also text_hash, the xxhash64 of the text's
    bytes, to tell rows with one id apart. Columns of docs other than the two named ones are not read, so
    they may be called like those that come out.
    """
    labelled = frozen(training_labels(labels, label_col, id_col))
    hashed = {"text_hash": F.xxhash64(utf8(text_col))} if keep_text_hash else {}
    counts = frozen(gram_counts(docs, labelled, id_col, text_col))
    drawn = frozen(sample(docs.select(id_col).join(labelled, id_col), sample_rows, id_col).dropDuplicates([id_col]))
    size = drawn.agg(F.count(F.lit(1)), F.sum("label")).first()
    rows, positive = size[0], size[1] or 0
    out_id = F.col("id").alias(id_col)
    if positive in (0, rows):
        share = (positive + 0.5) / (rows + 1) if rows else 0.0
        flat = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.lit(share).alias("score"), *[c.alias(k) for k, c in hashed.items()])
        return flat.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("mean_ratio", F.lit(0.0)).withColumn("peak_ratio", F.lit(0.0))
    drawn = docs.select(id_col, text_col).join(F.broadcast(drawn), id_col)
    if few := counts.count() <= max_grams:
        known = counts.toPandas()

    def judged(rows, folds, keep):
        """rows by the models of these folds' counts."""
        if few:
            n = [sum(known[f"n{f}{c}"].to_numpy() for f in folds) for c in (0, 1)]
            has = n[0] + n[1] > 0
            return _scored(rows, KneserNeyPair(known["gram"].to_numpy().astype(np.uint64)[has], n[0][has], n[1][has]), id_col, text_col, keep)
        n = [sum((F.col(f"n{f}{c}") for f in folds), F.lit(0)) for c in (0, 1)]
        return _joined(rows, *ratio_tables(counts.select("gram", n[0].alias("ordinary"), n[1].alias("toxic"))), id_col, text_col, keep)

    # each fold by the counts of the other
    seen = [judged(drawn.filter(F.col("fold") == fold), [other], ["label"]).toPandas() for fold, other in ((0, 2), (2, 0))]
    x = np.log(np.concatenate([p[_RATIOS].to_numpy() for p in seen]) + RATIO_FLOOR)
    y = np.concatenate([p["label"].to_numpy() for p in seen])
    w = _logistic(x, y)
    both = judged(docs.withColumns(hashed) if hashed else docs, [0, 2], [*hashed])
    z = F.lit(float(w[-1]))
    for k, c in enumerate(_RATIOS):
        z = z + F.lit(float(w[k])) * F.log(F.col(c) + RATIO_FLOOR)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))
    both = both.withColumn("score", score)
    return both.select(out_id, held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "mean_ratio", "peak_ratio", *hashed)
