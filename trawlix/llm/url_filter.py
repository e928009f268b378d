"""URL filtering by a cascade of Bloom filters, in DataFrame functions only.

Listed keys are ``host`` + ``path`` texts such as ``example.com/en/7``. A url's
candidate keys are its host's suffixes joined to its path's prefixes, in the
shapes (labels, path length) that the rules have. All distinct candidates of the
corpus are the universe. Level 1 encodes the listed keys, level 2 the universe's
keys that level 1 passes wrongly, level 3 the listed keys that level 2 passes
wrongly, and so on until no key is wrong. Membership of any key of the universe
is then exact: it is listed if the first level that lacks it is an even one.
Filters are literals of the query, so pages are judged in one pass without a join.

The first filter's rate is the listed keys' share of the universe, so all levels
together take a few bits a listed key times the logarithm of that share. Keys are
dealt by a hash to shards of about ``SHARD`` listed keys, each with a cascade of its
own, so that no filter grows with the list; with one shard, all is one pass over the
pages, with more one pass each.

Defined cases: null urls and urls without ``://`` have an empty host and path and
fit no rule; of rules with equal length the greater text wins; a key that is both
blocked and allowed is blocked; an empty list allows all; rules with an empty or null
host or a null path are left out. Repeated rows are judged alike, a url of any length is
read whole, and an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Listed keys of one cascade; the largest filter then takes about a megabyte.
SHARD = 500_000
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWERED), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """Distinct (labels of the host, characters of the path); few, whatever the number of rules."""
    labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    return sorted((r.a, r.p) for r in rules.select(labels.alias("a"), F.length("path").alias("p")).distinct().collect())


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Every key of these shapes that could be a rule fitting the url."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    keys = [F.when((host != "") & (labels >= a) & (F.length(path) >= p), F.concat(F.substring_index(host, ".", -a), F.substring(path, 1, p))) for a, p in shapes]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


class Bloom:
    """One filter: m bits as a literal array of longs."""

    def __init__(self, keys: DataFrame, n: int, rate: float, salt: int):
        self.hashes = max(1, round(math.log2(1 / rate)))
        self.bits = max(64, 64 * math.ceil(n * self.hashes * 1.4427 / 64))
        self.salt = salt
        at = F.explode(F.array(*[self._at(F.col("key"), j) for j in range(self.hashes)]))
        words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
        filled = {r.word: r.bits for r in words.collect()}
        self.words = [filled.get(i, 0) for i in range(self.bits // 64)]

    def _at(self, key: Column, j: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.salt), F.lit(j)), F.lit(self.bits))

    def has(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")

        def all_set(bits: Column) -> Column:
            out = F.lit(True)
            for j in range(self.hashes):
                at = self._at(key, j)
                out &= F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1
            return out

        # The bits stand in the plan once, as the one element of an array, however many hashes there are.
        return F.get(F.transform(F.array(words), all_set), F.lit(0))


class Cascade:
    """Exact membership of the keys of ``universe`` in ``listed`` (both: one column, key, distinct)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, n_universe: int, salt: int = 0):
        self.levels: list[Bloom] = []
        inside, outside = listed, universe.join(listed, "key", "left_anti")
        n = inside.count()
        rate = min(0.5, max(1e-9, 0.7 * n / max(1, n_universe)))
        while n:
            level = Bloom(inside, n, rate, salt + len(self.levels))
            self.levels.append(level)
            wrong = cut(outside.where(level.has(F.col("key"))))
            inside, outside, n, rate = wrong, inside, wrong.count(), 0.5

    def has(self, key: Column) -> Column:
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.has(key) & ~out
        return out


def filter_urls(pages: DataFrame, rules: DataFrame, shard: int = SHARD) -> DataFrame:
    """Add host, path, rule and verdict to ``pages`` (which has a url).

    rules: host, path, action (``block`` or ``allow``). Columns of those four names
    are replaced.
    """
    rules = rules.where("host is not null and host <> '' and path is not null").withColumn("key", F.concat("host", "path"))
    listed = cut(rules.groupBy("key", "host", "path").agg(F.max("action").alias("action")))
    shapes, n = _shapes(listed), listed.count()
    named = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    keys = candidates(F.col("host"), F.col("path"), shapes)
    universe = cut(named.select(F.explode(keys).alias("key")).distinct())
    shards = max(1, -(-n // shard))
    of_shard = lambda key, i: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards)) == i if shards > 1 else F.lit(True)
    within = lambda cascade, i: lambda key: of_shard(key, i) & cascade.has(key)
    best = {action: f"_{action}" for action in ("block", "allow")}
    while set(best.values()) & set(pages.columns):
        best = {action: f"_{name}" for action, name in best.items()}
    judged = named.withColumns({name: F.lit(None).cast("string") for name in best.values()})
    for i in range(shards):
        known = universe.where(of_shard(F.col("key"), i))
        n_known = known.count()
        better = {}
        for j, (action, name) in enumerate(best.items()):
            cascade = Cascade(listed.where((F.col("action") == action) & of_shard(F.col("key"), i)).select("key"), known, n_known, 100 * j)
            found = F.filter(keys, within(cascade, i))
            better[name] = _longest(F.array_append(found, F.col(name)))
        # Each pass over several shards begins from the pages as the one before left them.
        judged = judged.withColumns(better) if shards == 1 else cut(judged.withColumns(better), spent=judged if i else None)
    block, allow = (F.col(name) for name in best.values())
    longer = F.struct(F.length(block), block) >= F.struct(F.length(allow), allow)
    is_block = block.isNotNull() & (allow.isNull() | longer)
    return judged.withColumns({"rule": F.when(is_block, block).otherwise(allow), "verdict": F.when(is_block, F.lit("block")).otherwise(F.lit("allow"))}).drop(*best.values())


def _longest(keys: Column) -> Column:
    """The longest of an array's keys that are not null, of equal ones the greatest."""
    return F.array_max(F.transform(F.array_compact(keys), lambda x: F.struct(F.length(x).alias("n"), x.alias("key"))))["key"]
