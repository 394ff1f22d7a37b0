"""URL filters with Bloom filter cascades, in DataFrame functions only.

A rule is a host and a path prefix. The keys that a URL could be listed under are few: each suffix of its
host by labels, with each prefix of its path that is as long as some rule's path. A cascade holds a set of
listed keys exactly over the complete set of keys that the corpus can ask for: level 1 is a Bloom filter
of the listed keys, level 2 one of the other keys that level 1 wrongly reports, level 3 one of the listed
keys that level 2 wrongly reports, and so on until no error is left. A key is listed if the first level
that doesn't report it is an even one. The levels are constants in the plan, so judging a URL takes no
join and no shuffle. Their size follows the number of listed keys (times the logarithm of the corpus's
keys), which is checked; all that grows with the corpus stays in DataFrames.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import frozen, long_array

#: Listed keys that one cascade takes.
MAX_LISTED = 2_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path of a URL; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def split_rule(rule: str) -> tuple[str, str]:
    """Host and path of a rule like 'example.com/en/'."""
    at = rule.find("/")
    return (rule, "/") if at < 0 else (rule[:at], rule[at:])


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All keys that a URL could be listed under, longest first; then by host length."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.transform(F.array(*[F.lit(n) for n in path_lengths]), lambda n: F.when(F.length(path) >= n, F.substring(path, F.lit(1), n))), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(-(F.length(s) + F.length(p)), -F.length(s), F.concat(s, p).alias("key")))))
    return F.when(host != "", F.transform(F.array_sort(keys), lambda k: k["key"])).otherwise(F.array().cast("array<string>"))


@dataclass
class Level:
    words: list[int]
    bits: int
    hashes: int
    seed: int


def _places(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    a, b = F.xxhash64(key, F.lit(seed)), F.xxhash64(F.lit(seed), key).bitwiseOR(F.lit(1))
    # shifted to be positive, so the sums can't overflow
    a, b = F.shiftrightunsigned(a, 8), F.shiftrightunsigned(b, 24)
    return [F.pmod(a + b * i, F.lit(bits)) for i in range(hashes)]


def _reports(key: Column, level: Level) -> Column:
    words = long_array(level.words)
    out = F.lit(True)
    for place in _places(key, level.bits, level.hashes, level.seed):
        word = F.element_at(words, (F.shiftright(place, 6) + 1).cast("int"))
        out = out & (F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return out


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    hashes = max(1, round(-math.log2(rate)))
    place = F.explode(F.array(*_places(F.col("key"), bits, hashes, seed)))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    rows = keys.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    words = [0] * (bits // 64 + 1)
    for r in rows:  # one row for each word of the filter
        words[r["word"]] = r["bits"]
    return Level(words, bits, hashes, seed)


class Cascade:
    """Exact membership of the keys in `listed`, for every key in the universe it was built over."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, max_listed: int = MAX_LISTED) -> Cascade:
        """listed, universe: DataFrames with a string column key; nulls are left out.

        Listed keys outside the universe are left out, since nobody can ask for them.
        """
        listed = listed.select("key").filter("key IS NOT NULL").distinct()
        n = listed.count()
        if n > max_listed:
            raise ValueError(f"{n} listed keys; a cascade takes {max_listed}. Use Cascades, which cuts the list by a hash of the key")
        universe = universe.select("key").filter("key IS NOT NULL").distinct()
        marked = frozen(universe.join(listed.withColumn("listed", F.lit(True)), "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False))))
        sizes = {r["listed"]: r["count"] for r in marked.groupBy("listed").count().collect()}
        inside, outside = sizes.get(True, 0), sizes.get(False, 0)
        if not inside:
            return cls([])
        rate = min(0.5, max(1e-9, math.sqrt(0.5) * inside / max(outside, 1)))
        levels: list[Level] = []
        held, n = marked.filter("listed").select("key"), inside
        asked = marked.filter("NOT listed").select("key")
        while True:
            levels.append(_level(held, n, rate, seed=1 + len(levels)))
            wrong = frozen(asked.filter(_reports(F.col("key"), levels[-1])))
            n = wrong.count()
            if not n:
                return cls(levels)
            held, asked, rate = wrong, held, 0.5

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(_reports(key, self.levels[i]), out).otherwise(F.lit(i % 2 == 1))
        return out


class Cascades:
    """Cascades for the parts of a list that one is too small for; the parts are cut by a hash of the key."""

    def __init__(self, parts: list[Cascade]):
        self.parts = parts

    @staticmethod
    def _part(key: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(n))

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, max_listed: int = MAX_LISTED) -> Cascades:
        """As Cascade.build(), for lists of any size; the parts' sizes differ by chance, so each is given three quarters of what it may hold."""
        n = listed.select("key").filter("key IS NOT NULL").distinct().count()
        parts = max(1, -(-4 * n // (3 * max_listed))) if n > max_listed else 1
        some = lambda df, i: df if parts == 1 else df.filter(cls._part(F.col("key"), parts) == i)
        return cls([Cascade.build(some(listed, i), some(universe, i), max_listed) for i in range(parts)])

    def contains(self, key: Column) -> Column:
        out = self.parts[0].contains(key)
        for i in range(1, len(self.parts)):
            out = F.when(self._part(key, len(self.parts)) == i, self.parts[i].contains(key)).otherwise(out)
        return out


def judge_urls(df: DataFrame, rules: dict[str, str], blocked: DataFrame, url_col: str = "url") -> DataFrame:
    """df with host, path, rule and verdict.

    rules: host and path prefix to 'allow' or 'block'; a rule fits its host and all subdomains if the
    URL's path starts with the rule's, and the longest wins. A URL that no rule fits gets the verdict of
    the block list, whose column key holds rules of the same form: 'block' if one fits, else 'allow'. Two
    cascades find the rule (one for each verdict's keys), others ask the list. A null URL, or one
    without ://, has an empty host and path, fits nothing and is allowed. Rows are kept as they are, and an
    empty table gives none; columns of df with the names of the new ones are replaced. A long URL has as
    many keys as its host has labels, times the lengths of the lists' paths.
    """
    spark = df.sparkSession
    listed = spark.createDataFrame([(*split_rule(r), v) for r, v in rules.items()] or [("", "", "")], "host string, path string, verdict string").filter("host != ''")
    block = blocked.select(F.regexp_extract("key", "^([^/]*)", 1).alias("host"), F.regexp_extract("key", "^[^/]*(/.*)?$", 1).alias("path")).withColumn("path", F.when(F.col("path") == "", "/").otherwise(F.col("path")))
    lengths = sorted({len(split_rule(r)[1]) for r in rules} | {r[0] for r in block.select(F.length("path")).distinct().collect() if r[0] is not None})
    if len(lengths) > 256:
        raise ValueError("paths of more than 256 different lengths in the lists")
    host, path = host_and_path(F.col(url_col))
    seen = df.select(host.alias("host"), path.alias("path")).select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths or [1])).alias("key")).distinct()
    universe = frozen(seen)
    key = F.concat("host", "path").alias("key")
    cascades = {v: Cascade.build(listed.filter(F.col("verdict") == v).select(key), universe) for v in ("allow", "block")}
    method = Cascades.build(block.select(key), universe)
    judged = df.withColumn("host", host).withColumn("path", path).withColumn("__keys", candidate_keys(F.col("host"), F.col("path"), lengths or [1]))
    either = lambda k: cascades["allow"].contains(k) | cascades["block"].contains(k)
    judged = judged.withColumn("rule", F.try_element_at(F.filter("__keys", either), F.lit(1)))
    by_rule = F.when(cascades["allow"].contains(F.col("rule")), "allow").otherwise("block")
    by_list = F.when(F.exists("__keys", method.contains), "block").otherwise("allow")
    return judged.withColumn("verdict", F.when(F.col("rule").isNotNull(), by_rule).otherwise(by_list)).drop("__keys")
