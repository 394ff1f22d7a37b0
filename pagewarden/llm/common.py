"""Helpers that several corpus operators share."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Low bits of monotonically_increasing_id() that number the rows of a partition.
_ROW_BITS = (1 << 33) - 1


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that spark.checkpoint.dir names; make one only for a local session without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(named)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of results that nothing reads any more, on whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def frozen(df: DataFrame) -> DataFrame:
    """df with its rows written to the shared checkpoint folder and its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def long_array(values) -> F.Column:
    """A constant array<bigint>, folded to one literal by the optimizer. For data with a proven bound."""
    return F.from_json(F.lit(json.dumps([int(v) for v in values])), "array<bigint>")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them as long as df has columns called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def without_rows(df: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df, with all their columns, whose id and xxhash64 of the text's bytes aren't a row of gone (id, hash)."""
    key, mark = unused(df, "__id", "__hash")
    gone = gone.toDF(key, mark)
    return df.join(gone, df[id_col].eqNullSafe(F.col(key)) & (F.xxhash64(utf8(df[text_col])) == F.col(mark)), "left_anti")


def utf8(col: str | F.Column) -> F.Column:
    """The UTF-8 bytes of a text column; a null text counts as empty."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("binary"), F.lit(b""))


def crc32_of_id(col: str = "doc_id") -> F.Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def held_out(col: str = "doc_id") -> F.Column:
    """The rows whose labels no model may learn from."""
    return F.pmod(crc32_of_id(col), F.lit(3)) == 1


def ranked(df: DataFrame, keys: list[str], rank: str) -> tuple[DataFrame, int]:
    """Number all rows 0, 1, 2, ... in the order of the keys, and count them.

    The rows are dealt by ranges of the keys, sorted within each range and written to the shared
    checkpoint folder with their place in it, so the numbering can't change when a task runs again.
    Only one count for each range reaches the driver. Rows that tie on all keys are numbered in any
    order, so give keys that tell all different rows apart.
    """
    pieces = frozen(
        df.repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys])
        .sortWithinPartitions(*[F.col(k).asc_nulls_last() for k in keys])
        .withColumn("__piece", F.spark_partition_id())
        .withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    )
    counts = {r[0]: r[1] for r in pieces.groupBy("__piece").count().collect()}
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    start = F.element_at(long_array(starts or [0]), F.col("__piece") + 1)
    return pieces.withColumn(rank, start + F.col("__place")).drop("__piece", "__place"), total


#: Keys that more than one in so many rows hold: there are no more of them than that.
HOT_SHARE = 2000


def joined_by_group(rows: DataFrame, groups: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows (left) with the columns of their group; groups has one row for each key, and how many rows hold it.

    Groups of more than one in HOT_SHARE of all rows, HOT_SHARE at most, go to all tasks, so that no task
    gets all rows of a large group; the others are dealt out by the key.
    """
    others = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(weight) * HOT_SHARE > total).select(F.col(key).alias("__hot"), F.struct(*others).alias("__of_hot"))
    # a zero that isn't a constant, which would be taken out of the join's keys
    zero = F.least(F.col(weight), F.lit(0)).cast("int")
    rest = groups.select(F.col(key).alias("__key"), zero.alias("__zero"), F.struct(*others).alias("__of"))
    # rows of hot groups have theirs already: a number keeps them apart from the other join's keys
    number = F.when(F.col("__hot").isNull(), 0).otherwise((1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))).cast("int"))
    out = rows.join(F.broadcast(hot), rows[key] == F.col("__hot"), "left").withColumn("__salt", number)
    out = out.join(rest, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__zero")), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col("__of_hot")[c], F.col("__of")[c]).alias(c) for c in others])
