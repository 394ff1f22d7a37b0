"""Benchmark decontamination by templates.

Texts are brought into a canonical form twice: as their plain words, and as a template in which numbers,
names and the units behind numbers are typed placeholders. Windows of words of either form are hashed and
joined with those of the benchmark's items. A window that matches as a template counts only if its slots
are filled consistently: along one alignment of document and item, each value of the item always stands
for the same value of the document. An item is in a document if enough of the item's windows are, or a
long run of them along one alignment.

A window that many items share and many documents hold would make a row for each two of them. So documents
first meet items by anchors alone: the item's rarest windows, so many of them and so placed that any match
that counts holds one. All windows are then compared between documents and the items they have an anchor of.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm.common import frozen, utf8, without_rows
from pagewarden.llm.textwords import PUNCTUATION, WHITE, byte_table, chunks, lowered, split_words, windows

#: Words of a window, and the share of an item's windows that make a document contaminated.
WINDOW, MIN_SHARE = 5, 0.75
#: Words of an item in a row that make a document contaminated, whatever their share.
MIN_RUN = 30
#: Words in a template window that aren't placeholders.
MIN_LITERAL = 2
#: Windows of the benchmark up to which its hashes (8 bytes each) go to all tasks ahead of the join.
MAX_SENT = 4_000_000
#: Names of units.
UNITS = "mm cm m km in ft yd mi mile miles inch inches foot feet yard yards metre metres meter meters kilometre kilometres kilometer kilometers mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl l litre litres liter liters gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur kb mb gb tb hz khz mhz ghz w kw mw v kv j kj mph kph degree degrees".split()
_TABLE = byte_table(WHITE + PUNCTUATION)
_NUMBER, _NAME, _UNIT = (np.uint64(0xA5A5_0000_0000_0001 + k) for k in range(3))
#: Numbers with separators or decimals; "1,2,3" stays a list. Within them separators become bytes that don't split words.
_JOINED = re.compile(rb"(?<![0-9a-z.,])(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+[.,]\d+)(?![0-9a-z]|[.,]\d)")
_INNER = bytes.maketrans(b".,", b"\x1e\x1f")
#: The kind of a sentence's opening word with a capital, where it is taken as a name.
_OPENER = 4
_STOP = np.isin(np.arange(256), list(b".!?:;\n"))
_UNIT_HASHES = np.sort(split_words([" ".join(UNITS).encode()], _TABLE).hash)


def _in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _capital(w, words: np.ndarray) -> np.ndarray:
    """Whether the words' first character has a lower case of its own."""
    at = w.start[words]
    wide = (w.raw[at] >= 0xC3) & (at + 1 < w.end[words])
    return (w.raw[at] != w.folded[at]) | (wide & (w.raw[at + wide] != w.folded[at + wide]))


def _folded(text: bytes) -> bytes:
    return _JOINED.sub(lambda m: m[0].translate(_INNER), lowered(text))


def canonical(texts: list[bytes]):
    """The words of texts, for each whether it is a number, a name or a unit, and whether it may be a name, too.

    A number is a word of digits, with separators or decimals as they may be. A unit stands behind a
    number. A name starts with a capital letter and doesn't start a sentence or a text; a capital that
    does may be one.
    """
    w = split_words(texts, _TABLE, _folded)
    digits = np.concatenate([[0], np.cumsum((w.raw >= 48) & (w.raw <= 57) | ((w.raw == 44) | (w.raw == 46)) & (w.folded != 32))])
    stops = np.concatenate([[0], np.cumsum(_STOP[w.raw])])
    number = digits[w.end] - digits[w.start] == w.end - w.start
    first = np.ones(len(w.start), bool)
    first[1:] = w.text[1:] != w.text[:-1]
    opens = first.copy()
    opens[1:] |= stops[w.start[1:]] > stops[w.end[:-1]]
    capital = _capital(w, np.arange(len(w.start)))
    name = capital & ~opens
    unit = np.zeros(len(w.start), bool)
    unit[1:] = number[:-1] & ~first[1:] & _in(w.hash[1:], _UNIT_HASHES)
    kind = np.where(number, 1, np.where(unit, 3, np.where(name, 2, 0)))
    return w, kind, capital & opens & (kind == 0)


def _template(w, kind):
    return np.where(kind == 1, _NUMBER, np.where((kind == 2) | (kind == _OPENER), _NAME, np.where(kind == 3, _UNIT, w.hash)))


def window_rows(texts: list[bytes], width: int, wanted=None):
    """(text, first word, hash, whether it has placeholders, the values of its slots) of each window.

    wanted keeps the windows with those hashes. Windows with words that open a sentence with a capital
    come twice: with these as words and as names.
    """
    for begin, some in chunks(texts):
        w, kind, maybe = canonical(some)
        forms = [kind, np.where(maybe, _OPENER, kind)]
        starts = np.cumsum(w.counts) - w.counts
        h, text, at = windows(w.hash, w.text, w.counts, width)
        keep = slice(None) if wanted is None else wanted(h)
        for t, a, x in zip(text[keep].tolist(), (at - starts[text])[keep].tolist(), h[keep].view(np.int64).tolist(), strict=True):
            yield begin + t, a, x, False, []
        for kinds in forms:
            if not kinds.any():
                continue
            openers = np.concatenate([[0], np.cumsum(kinds == _OPENER)])
            h, text, at = windows(_template(w, kinds), w.text, w.counts, width)
            slots = np.concatenate([[0], np.cumsum(kinds > 0)])
            size = np.minimum(width, w.counts[text])
            n = slots[at + size] - slots[at]
            keep = (n > 0) & (size - n >= MIN_LITERAL)
            if kinds is not kind:
                keep &= openers[at + size] > openers[at]
            if wanted is not None:
                keep &= wanted(h)
            for i in np.flatnonzero(keep).tolist():
                words = [k for k in range(at[i], at[i] + size[i]) if kinds[k]]
                yield begin + int(text[i]), int(at[i] - starts[text[i]]), int(h[i].view(np.int64)), True, [f"{kinds[k]} {w.folded[w.start[k] : w.end[k]].tobytes().decode(errors='replace')}" for k in words]


def _windows(df: DataFrame, keys: list[str], width: int, wanted) -> DataFrame:
    """keys, at, hash, template, slots (and n_windows for items) of the windows of the column raw."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            rows: list = []

            def packed():
                at = pa.array([r[0] for r in rows], pa.int64())
                cols = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.bool_()), (4, pa.list_(pa.string())))]
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *cols], [*keys, "at", "hash", "template", "slots"])

            for row in window_rows(raws, width, wanted):
                rows.append(row)
                if len(rows) == 20_000:
                    yield packed()
                    rows = []
            if rows:
                yield packed()

    return df.mapInArrow(run, f"{kinds}, at bigint, hash bigint, template boolean, slots array<string>")


class _Wanted:
    """Whether hashes are among some, for arrays: a table of bits first, then a search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(hashes >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = self.bits[(h >> np.uint64(42)).astype(np.int64)]
        some = np.flatnonzero(out)
        out[some] = _in(h[some], self.hashes)
        return out


def _anchors(rows: DataFrame, item_col: str, min_share: float, least_run: int) -> DataFrame:
    """hash, template, item of windows of which a document holds at least one if the item is in it.

    With f windows that may be missing these are the f + 1 that fewest items share, and the rarest of each
    half as many places in a row as a run must have, since any such run holds one of those stretches whole.
    """
    shared = rows.groupBy("hash", "template").agg(F.count(F.lit(1)).alias("k"))
    places = rows.join(shared, ["hash", "template"]).groupBy(item_col, "item_at", "n_windows").agg(F.sum("k").alias("cost"))
    missing = F.floor((1 - min_share) * F.col("n_windows") + 1e-9)
    rarest = F.row_number().over(Window.partitionBy(item_col).orderBy("cost", "item_at")) <= missing + 1
    stretch = F.row_number().over(Window.partitionBy(item_col, F.expr(f"item_at div {max(1, (least_run + 1) // 2)}")).orderBy("cost", "item_at")) == 1
    chosen = places.withColumn("__rarest", rarest).withColumn("__stretch", stretch).filter("__rarest OR __stretch").select(item_col, "item_at")
    return rows.join(chosen, [item_col, "item_at"], "left_semi").select("hash", "template", item_col).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, min_share: float = MIN_SHARE, max_sent: int = MAX_SENT, min_run: int = MIN_RUN) -> DataFrame:
    """One row for each document and item that is in it: the document's id and text_hash, the item's id,
    n_windows, n_found, n_exact, share, reworded (whether slots had to be filled differently).

    A text with fewer words than a window is one window. Null and empty texts and items match nothing.
    Items of equal words count as the one with the smallest id. Documents that are equal in id and text
    come once, others with the same id each for themselves. A long text is read whole, in a few arrays of
    its length. An empty table on either side gives an empty result. Columns of other names are not read.
    """
    items = benchmark.select(F.col(item_col), utf8("text").alias("raw"))
    rows = frozen(_windows(items, [item_col], window, None))
    whole = rows.filter("NOT template").groupBy(item_col).agg(F.sort_array(F.collect_list(F.struct("at", "hash"))).alias("all"), F.max("at").alias("last"))
    one = whole.groupBy("all").agg(F.min(item_col).alias(item_col), (F.first("last") + 1).alias("n_windows")).drop("all")
    rows = frozen(rows.join(one, item_col).select(F.col(item_col), "n_windows", F.col("at").alias("item_at"), "hash", "template", F.col("slots").alias("item_slots")).dropDuplicates([item_col, "item_at", "hash", "template"]))
    wanted = None
    if rows.count() <= max_sent:
        hashes = rows.select("hash").distinct().toPandas()["hash"].to_numpy().view(np.uint64)
        sent = docs.sparkSession.sparkContext.broadcast(_Wanted(hashes))
        wanted = lambda h: sent.value(h)
    key = [id_col, "text_hash"]
    source = docs.select(F.col(id_col), F.xxhash64(utf8(text_col)).alias("text_hash"), utf8(text_col).alias("raw"))
    held = frozen(_windows(source, key, window, wanted))
    least_run = max(min_run - window + 1, 1)
    near = held.join(_anchors(rows, item_col, min_share, least_run), ["hash", "template"]).select(*[F.col(k).alias(f"__{k}") for k in key], F.col(item_col).alias("__item")).distinct()
    # equal rows give equal windows; the matches are counted by position, so they count once
    met = held.join(near, F.col(id_col).eqNullSafe(F.col(f"__{id_col}")) & (F.col("text_hash") == F.col("__text_hash")))
    own = rows.select(F.col(item_col), "n_windows", "item_at", F.col("hash").alias("__hash"), F.col("template").alias("__template"), "item_slots")
    hits = met.join(own, (F.col("__item") == F.col(item_col)) & (F.col("hash") == F.col("__hash")) & (F.col("template") == F.col("__template")))
    hits = frozen(hits.select(*key, item_col, "n_windows", "item_at", "template", (F.col("at") - F.col("item_at")).alias("shift"), "slots", "item_slots"))
    pair = [*[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], F.col(item_col) == F.col("__item"), F.col("shift") == F.col("__shift")]
    filled = hits.filter("template").select(*key, item_col, "shift", F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
    # an opening word may be no name: if it stands for several values, only the windows with it fall out
    opener, value = F.col("s.item_slots").startswith(f"{_OPENER} "), F.substring("s.slots", 3, 1 << 30)
    filled = filled.select(*key, item_col, "shift", F.regexp_replace("s.item_slots", f"^{_OPENER} ", "2 ").alias("slot"), opener.alias("opener"), value.alias("value"))
    sure = F.when(~F.col("opener"), F.col("value"))
    torn = filled.groupBy(*key, item_col, "shift", "slot").agg((F.min(sure) != F.max(sure)).alias("all"), F.min("value").alias("least"), F.max("value").alias("most")).filter("least != most")
    torn = torn.groupBy(*key, item_col, "shift").agg(F.coalesce(F.max("all"), F.lit(False)).alias("__all"), F.transform(F.collect_set("slot"), lambda x: F.regexp_replace(x, "^2 ", f"{_OPENER} ")).alias("__slots"))
    torn = torn.select(*[F.col(k).alias(f"__{k}") for k in key], F.col(item_col).alias("__item"), F.col("shift").alias("__shift"), "__all", "__slots")
    cond = pair[0]
    for p in pair[1:]:
        cond = cond & p
    cond = cond & (F.col("__all") | F.arrays_overlap("item_slots", "__slots"))
    sound = hits.filter("NOT template").unionByName(hits.filter("template").join(torn, cond, "left_anti"))
    found = sound.groupBy(*key, item_col, "n_windows", "item_at").agg(F.min("template").alias("template"))
    found = found.groupBy(*key, item_col, "n_windows").agg(F.count(F.lit(1)).alias("n_found"), F.count(F.when(~F.col("template"), 1)).alias("n_exact"))
    line = [*key, item_col, "shift"]
    runs = sound.select(*line, "item_at").distinct().withColumn("run", F.col("item_at") - F.row_number().over(Window.partitionBy(*line).orderBy("item_at")))
    runs = runs.groupBy(*line, "run").agg(F.count(F.lit(1)).alias("length")).filter(F.col("length") >= least_run)
    runs = runs.groupBy(*[F.col(k).alias(f"__{k}") for k in key], F.col(item_col).alias("__item")).agg(F.max("length").alias("longest"))
    found = found.join(runs, pair[0] & pair[1] & pair[2], "left").withColumn("share", F.col("n_found") / F.col("n_windows"))
    found = found.filter((F.col("share") >= min_share) | F.col("longest").isNotNull()).drop("longest", *[f"__{k}" for k in key], "__item")
    return found.withColumn("reworded", F.col("n_exact") < F.col("n_found"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs that no item is in, with all their columns, whatever their names.

    Rows with null or empty texts stay, and so do all if the benchmark is empty. Rows alike in id and text
    stay or go together.
    """
    bad = contamination(docs, benchmark, id_col, text_col, item_col).select(id_col, "text_hash").distinct()
    return without_rows(docs, bad, id_col, text_col)
