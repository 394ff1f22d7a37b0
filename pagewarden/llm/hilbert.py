"""Sharding along a Hilbert curve.

Several columns are quantised by the exact share of all rows in front of a value, so the bins of a column
span the whole grid however few or skewed its values are; the bins of a row are a cell of the grid, and the
cell's index on the Hilbert curve orders the rows. Runs of that order are the shards. Neighbours on the
curve are neighbours in the grid, so each shard covers a compact box of the columns, and a reader who asks
for ranges of several of them at once can leave out most shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewarden.llm.common import frozen, long_array, ranked

#: Bits of a cell up to which all cells' places on the curve are one constant.
TABLE_BITS = 16


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of grid cells (one row each, one column for each dimension), by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for i in range(dims):
            turned = (x[i] & step) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        step >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, step = np.zeros_like(x[0]), 1 << (bits - 1)
    while step > 1:
        flip ^= np.where((x[-1] & step) != 0, step - 1, 0)
        step >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _steps(df: DataFrame, col: str, bins: int) -> list[tuple]:
    """(smallest value, bin) of each bin that a column's values fall into, in order; nulls come first, in bin 0.

    A value's bin is the share of all rows in front of it, times bins. Values are counted, the counts are
    summed up along the values' order within ranges and over the ranges, and the first value of each bin
    comes to the driver, so there are at most `bins` of them whatever the column holds.
    """
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    pieces = frozen(counts.filter("value IS NOT NULL").repartitionByRange("value").withColumn("piece", F.spark_partition_id()))
    totals = {r[0]: r[1] for r in pieces.groupBy("piece").agg(F.sum("n")).collect()}  # a number for each range
    nulls = counts.filter("value IS NULL").agg(F.sum("n")).first()[0] or 0
    starts, seen = [], nulls
    for p in range(max(totals, default=-1) + 1):
        starts.append(seen)
        seen += totals.get(p, 0)
    before = F.sum("n").over(Window.partitionBy("piece").orderBy("value")) - F.col("n")
    at = F.expr(f"cast((ahead * {bins}L) div {max(seen, 1)}L as int)")
    rows = pieces.withColumn("ahead", F.element_at(long_array(starts or [0]), F.col("piece") + 1) + before)
    return sorted(((r["value"], r["bin"]) for r in rows.groupBy(at.alias("bin")).agg(F.min("value").alias("value")).collect()), key=lambda r: r[1])


def _bin(value: Column, steps: list[tuple], kind: T.DataType) -> Column:
    """The bin of a value: that of the last step it has reached."""
    out = F.lit(0)
    for least, b in steps:
        out = F.when(value >= F.lit(least).cast(kind), b).otherwise(out)
    return out


def _on_curve(bins: list[Column], bits: int) -> Column:
    """The curve's index of a cell: looked up in a table of all cells if they are few, so that no row leaves the JVM."""
    if bits * len(bins) <= TABLE_BITS:
        cells = np.indices((1 << bits,) * len(bins)).reshape(len(bins), -1).T
        code = F.lit(0)
        for b in bins:
            code = code * F.lit(1 << bits) + b
        return F.element_at(long_array(hilbert_index(cells, bits)), (code + 1).cast("int"))

    @F.pandas_udf("bigint")
    def index(*bins: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([b.to_numpy() for b in bins], 1), bits))

    return index(*bins)


def hilbert_order(df: DataFrame, dims: list[str], bits: int, rank: str = "rank") -> tuple[DataFrame, int]:
    """df (slim: it is written to the shared folder) with curve_index and its rows' rank on the curve."""
    rows = frozen(df)
    bins = [_bin(F.col(c), _steps(rows, c, 1 << bits), rows.schema[c].dataType) for c in dims]

    rows = rows.withColumn("curve_index", _on_curve(bins, bits))
    # rows of one cell are spread by a hash, so a cell with a large share of the rows is still cut
    rows = rows.withColumn("__tie", F.xxhash64(*df.columns))
    out, total = ranked(rows, ["curve_index", "__tie", *df.columns], rank)
    return out.drop("__tie"), total


def shards(df: DataFrame, dims: list[str], n_shards: int = 8, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id, size, text_crc32, law, shard, slot, grown_shard, curve_index, dims.

    The law is 'rows': the shards' numbers of rows differ by one at most. size is the text's UTF-8 bytes
    (none for null) plus 1. slot numbers a shard's rows in the order of the curve, without gaps. Nulls
    in a dimension come first. Repeated rows get slots of their own; an empty table gives none, and with
    fewer rows than shards some shards stay empty. Only a text's size and checksum are kept, so long texts
    cost no more than short ones. A dimension `size` is the size made here, and other columns of df that
    are called like columns made here aren't read.
    """
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    named = {id_col, "size", "text_crc32"}
    slim = df.select(F.col(id_col), (F.length(raw).cast("bigint") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), *[F.col(c) for c in dims if c not in named])
    rows, total = hilbert_order(slim, dims, bits)
    shard = F.expr(f"cast((rank * {n_shards}L) div {max(total, 1)}L as int)")
    start = F.expr(f"(shard * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}L")
    rows = rows.withColumn("shard", shard).withColumn("slot", F.col("rank") - start)
    return rows.select(F.col(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index", *[c for c in dims if c not in named])


def manifest(placed: DataFrame, dims: list[str]) -> DataFrame:
    """One row for each shard: rows, bytes, and the smallest and largest value of each dimension."""
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"), *[f(c).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))])


def shards_to_read(shard_manifest: DataFrame, box: dict[str, tuple]) -> DataFrame:
    """The shards that can hold rows with every named dimension within its (lowest, highest) value."""
    out = shard_manifest
    for c, (low, high) in box.items():
        out = out.filter((F.col(f"max_{c}") >= low) & (F.col(f"min_{c}") <= high))
    return out


def write_shards(df: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write df as Parquet with a folder for each shard; ids must be unique, rows with a null id are left out."""
    df.join(placed.select(id_col, "shard"), id_col).write.partitionBy("shard").parquet(path)
