"""URL filters by a Bloom filter cascade, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, with_row_key

#: 64-bit words (8 MB) that the filters of one list may take, as they are held in the plan.
MAX_WORDS = 1_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` and path up to ``?`` or ``#``; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """Keys under which a rule could list the url: a suffix of whole labels of the host and a prefix of the
    path, for every pair of lengths that some rule has. The pairs are one array of numbers in the
    plan and one expression over it, however many there are."""
    shapes = sorted({(rule.partition("/")[0].count(".") + 1, len(rule) - rule.index("/")) for rule in rules})
    pairs = F.arrays_zip(F.lit([n for n, _ in shapes]).alias("labels"), F.lit([n for _, n in shapes]).alias("n"))
    fits = F.filter(pairs, lambda s: (s["labels"] <= F.size(F.split(host, r"\.", -1))) & (s["n"] <= F.length(path)))
    key = lambda s: F.concat(F.call_function("substring_index", host, F.lit("."), -s["labels"]), F.substring(path, F.lit(1), s["n"]))
    return F.when(host != "", F.transform(fits, key)).otherwise(F.array().cast("array<string>"))


def longest(keys: Column) -> Column:
    """The longest of an array of keys, null if it is empty; of several the one of fewest labels."""
    labels = lambda k: F.length(F.regexp_replace(F.substring_index(k, "/", 1), r"[^.]", ""))
    return F.array_max(F.transform(keys, lambda k: F.struct(F.length(k).alias("size"), (-labels(k)).alias("labels"), k.alias("key"))))["key"]


class Cascade:
    """Exact membership of the keys of a universe in a list, without a join.

    Level 0 holds the listed keys; level 1 the keys of the universe that pass level 0 though not
    listed; level 2 the listed keys that pass level 1; and so on, until nobody passes wrongly. A
    key is a member if the first level that it fails is an odd one. Level 0 has about
    log2(unlisted / listed) bits a key, so level 1 has fewer keys than the list: all levels
    together are bounded by the list's length times the logarithm of the universe's.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[list[int], int, int]] = []  # words, bits, hashes

    @staticmethod
    def _places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(level * 64 + i)), F.lit(bits)) for i in range(hashes)]

    def passes(self, key: Column, level: int) -> Column:
        words, bits, hashes = self.levels[level]
        held = F.lit(words).cast("array<bigint>")
        hit = F.lit(True)
        for place in self._places(key, level, bits, hashes):
            word = F.get(held, F.shiftright(place, 6).cast("int"))
            hit = hit & (F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1)
        return hit

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(~self.passes(key, level), F.lit(level % 2 == 1)).otherwise(out)
        return F.coalesce(out, F.lit(False))

    def _add(self, keys: DataFrame, n: int, rate: float) -> None:
        hashes = max(1, round(-math.log2(rate)))
        bits = 64 * math.ceil(max(64, n * hashes / math.log(2)) / 64)
        level = len(self.levels)
        places = keys.select(F.explode(F.array(*self._places(F.col("key"), level, bits, hashes))).alias("place"))
        rows = (
            places.groupBy(F.shiftright("place", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(place, 64) as int))")).alias("bits"))
            .collect()
        )
        words = [0] * (bits // 64)
        for row in rows:
            words[row.word] = row.bits
        self.levels.append((words, bits, hashes))

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, max_words: int = MAX_WORDS) -> Cascade:
        """listed, universe: distinct, non-null ``key``. An error if the filters would exceed max_words."""
        self = cls()
        listed = saved(listed)
        n = listed.count()
        if not n:
            return self
        others = universe.count()
        rate = min(0.5, math.sqrt(0.5) * n / max(1, others))
        if (need := 1.5 * n * (-math.log2(rate) + 3) / 64) > max_words:
            raise ValueError(f"a list of {n} keys takes about {need:.0f} words of filters; max_words is {max_words}")
        self._add(listed, n, rate)
        marked = universe.where(self.passes(F.col("key"), 0)).select("key", F.lit(0).alias("is_listed")).union(listed.select("key", F.lit(1)))
        own, other = listed, marked.groupBy("key").agg(F.max("is_listed").alias("is_listed")).where("is_listed = 0").select("key")
        while True:
            other = saved(other)
            n = other.count()
            if not n:
                return self
            self._add(other, n, 0.5)
            own, other = other, own.where(self.passes(F.col("key"), len(self.levels) - 1))


def url_filter(pages: DataFrame, rules: dict[str, str], default: str = "allow", url: str = "url", max_words: int = MAX_WORDS) -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: ``host/path`` -> verdict. A rule fits its host and all subdomains where the path starts
    with the rule's; the longest that fits gives the verdict, and none gives ``default``. One
    cascade for each verdict is built over all keys that occur in the urls, so membership is exact.
    The filters are held in the plan: a list that takes over max_words 64-bit words is an error.

    Null, empty or malformed urls: empty host and path, null rule, default verdict. Repeated rows
    stay; an empty table gives an empty result; other columns are kept, but host, path, rule and
    verdict replace columns of these names.
    """
    spark = pages.sparkSession
    keys, = with_row_key(pages, "keys")
    host, path = host_and_path(F.col(url))
    pages = pages.withColumns({"host": host, "path": path}).withColumn(keys, candidate_keys(F.col("host"), F.col("path"), list(rules)))
    universe = saved(pages.select(F.explode(keys).alias("key")).distinct())
    listed = spark.createDataFrame(sorted(rules.items()), "key string, verdict string")
    cascades = {v: Cascade.build(listed.where(F.col("verdict") == v).select("key"), universe, max_words) for v in sorted(set(rules.values()))}
    found = F.lit(None).cast("string")
    for verdict, cascade in cascades.items():
        member = longest(F.filter(F.col(keys), cascade.contains))
        found = F.when(F.coalesce(F.length(member), F.lit(0)) > F.coalesce(F.length(found), F.lit(0)), member).otherwise(found)
    pages = pages.withColumn("rule", found)
    verdict = F.lit(default)
    for name, cascade in cascades.items():
        verdict = F.when(F.col("rule").isNotNull() & cascade.contains(F.col("rule")), F.lit(name)).otherwise(verdict)
    return pages.withColumn("verdict", verdict).drop(keys)
