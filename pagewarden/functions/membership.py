"""A Bloom filter of popular domains, built and asked in expressions, byte for byte in the TBLM format."""

from __future__ import annotations

import json
import math
import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The format's mark and version, and the FNV-1a constants.
MAGIC, VERSION, SEED, PRIME, SECOND = b"TBLM", 1, 0x811C9DC5, 0x01000193, 0x9E3779B9
_HEAD = struct.Struct("<HIBI")


#: Bits of a filter that is built, and of one that is a constant of the plan; larger ones are joined.
MAX_BITS, MAX_CONSTANT_BITS = 1 << 27, 1 << 23


def _hashed(text: Column, seeds: list[int], finish) -> Column:
    """finish() of the 32-bit FNV-1a of a text's UTF-8 bytes from each seed, as an array<bigint>, in one walk over the bytes."""
    # one character for each byte, so that each step reads one code
    codes = F.filter(F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), ""), lambda c: c != "")
    step = lambda h, c: F.transform(h, lambda x: (x.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))
    first = F.array(*[F.lit(s & 0xFFFFFFFF).cast("bigint") for s in seeds])
    return F.when(text.isNotNull(), F.aggregate(codes, first, step, finish))


def fnv1a(text: Column, seed: int = SEED) -> Column:
    """32-bit FNV-1a of a text's UTF-8 bytes, as a bigint."""
    return _hashed(text, [seed], lambda h: F.get(h, F.lit(0)))


def best_bits(n: int, rate: float) -> int:
    return max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2))


def best_hashes(bits: int, n: int) -> int:
    return max(1, round(bits / n * math.log(2)))


def positions(text: Column, bits: int, hashes: int, seed: int = SEED) -> Column:
    """The bits of a text in a filter, as array<bigint>."""
    at = lambda h: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (F.get(h, F.lit(0)) + i * F.get(h, F.lit(1)).bitwiseOR(F.lit(1).cast("bigint"))) % F.lit(bits))
    return _hashed(text, [seed, seed ^ SECOND], at)


def _holds(word: Column, position: Column) -> Column:
    """Whether a word of 64 bits has the bit of a position; a null word has none."""
    return F.coalesce(F.getbit(word, position.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1, F.lit(False))


@dataclass
class Membership:
    """A filter: its size in bits, number of hashes, seed, and its bytes (lowest bit first)."""

    bits: int
    hashes: int
    seed: int
    data: bytes

    @classmethod
    def build(cls, items: DataFrame, col: str = "domain", rate: float = 0.01, seed: int = SEED) -> Membership:
        """The filter of a column's values (nulls are left out). Its words of 64 bits come to the driver, of MAX_BITS at most."""
        rows = items.select(F.col(col).alias("v")).filter("v IS NOT NULL")
        n = max(1, rows.count())
        bits = best_bits(n, rate)
        if bits > MAX_BITS:
            raise ValueError(f"a filter of {n} values has {bits} bits, over {MAX_BITS}; join them as a table instead")
        hashes = best_hashes(bits, n)
        at = rows.select(F.explode(positions(F.col("v"), bits, hashes, seed)).alias("p"))
        filled = at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("set")).toPandas()
        words = np.zeros((bits + 63) // 64, "<i8")
        words[filled["word"].to_numpy(np.int64)] = filled["set"].to_numpy(np.int64)
        return cls(bits, hashes, seed, words.tobytes()[: (bits + 7) // 8])

    @property
    def words(self) -> np.ndarray:
        return np.frombuffer(self.data + bytes(-len(self.data) % 8), "<i8")

    def contains(self, text: Column) -> Column:
        """Whether a text may be in the filter; false for null. The filter is one constant of the plan, so of MAX_CONSTANT_BITS at most."""
        if self.bits > MAX_CONSTANT_BITS:
            raise ValueError(f"{self.bits} bits are too many for a constant; use marked()")
        words = F.from_json(F.lit(json.dumps(self.words.tolist())), "array<bigint>")
        hit = F.forall(positions(text, self.bits, self.hashes, self.seed), lambda p: _holds(F.get(words, F.shiftright(p, 6).cast("int")), p))
        return F.coalesce(hit, F.lit(False))

    def marked(self, df: DataFrame, col: str, to: str, constant_bits: int = MAX_CONSTANT_BITS) -> DataFrame:
        """df with a column that says what contains() does, for a filter of any size: beyond a constant's, its words are joined."""
        if self.bits <= min(constant_bits, MAX_CONSTANT_BITS):
            return df.withColumn(to, self.contains(F.col(col)))
        spark = df.sparkSession
        words = spark.createDataFrame(pd.DataFrame({"__word": np.flatnonzero(self.words), "__set": self.words[self.words != 0]}), "__word bigint, __set bigint")
        at = df.select(F.col(col).alias("__v")).filter("__v IS NOT NULL").distinct().withColumn("__p", F.explode(positions(F.col("__v"), self.bits, self.hashes, self.seed)))
        found = at.withColumn("__word", F.shiftright("__p", 6)).join(words, "__word", "left").groupBy("__v").agg(F.bool_and(_holds(F.col("__set"), F.col("__p"))).alias(to))
        return df.join(found, df[col] == F.col("__v"), "left").drop("__v").withColumn(to, F.coalesce(to, F.lit(False)))

    def to_bytes(self) -> bytes:
        return MAGIC + _HEAD.pack(VERSION, self.bits, self.hashes, self.seed) + self.data

    @classmethod
    def from_bytes(cls, raw: bytes) -> Membership:
        if len(raw) < 4 + _HEAD.size:
            raise ValueError("the header is cut short")
        if raw[:4] != MAGIC:
            raise ValueError("not a TBLM file")
        version, bits, hashes, seed = _HEAD.unpack_from(raw, 4)
        if version != VERSION:
            raise ValueError(f"version {version} isn't supported")
        data = raw[4 + _HEAD.size :][: (bits + 7) // 8]
        if len(data) < (bits + 7) // 8:
            raise ValueError("the bits are cut short")
        return cls(bits, hashes, seed, data)

    def meta(self, items: int, listed_on: str, list_id: str = "local", rate: float = 0.01) -> dict:
        return {"date": listed_on, "listId": list_id, "entries": items, "m": self.bits, "k": self.hashes, "hashSeed": self.seed, "falsePositiveRate": rate, "bytes": len(self.data) + 15}
