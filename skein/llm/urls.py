"""URL filters by Bloom filter cascades, in DataFrame expressions only.

A rule is a host, which stands for itself and its subdomains, and a path prefix; its key is the two joined. A url's
candidate keys are its host suffixes at label boundaries joined with its path prefixes, restricted to the label
counts and prefix lengths that occur among the rules, so there are a few of them however long the url is. A cascade
answers exactly whether a candidate key is listed: level 1 encodes the listed keys, level 2 those keys of the
corpus that level 1 takes for listed though they aren't, level 3 the listed keys that level 2 takes for such, and so
on until a level errs on none. All candidate keys of the corpus are tested while it is built, hence there is no error
left. Filters are small constants in the plan (their size depends on the rules and on the logarithm of the corpus);
no row meets another row.

Defined results: a null url or one without ``://`` has an empty host and path; a url that fits no rule gets
``default``; repeated rows give one result each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, narrow

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """An array of the keys that a rule fitting this url could have."""
    labels = F.length(host) - F.length(F.translate(host, ".", "")) + 1
    keys = []
    for n in sorted({r.host.count(".") + 1 for r in rules}):
        for length in sorted({len(r.path) for r in rules}):
            key = F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, length))
            keys.append(F.when((labels >= n) & (F.length(path) >= length), key))
    return F.array_compact(F.array(*keys))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: 64-bit words, and the number of hash functions."""

    words: tuple[int, ...]
    hashes: int
    seed: int

    def might_contain(self, key: Column) -> Column:
        words = F.lit(np.array(self.words, dtype=np.int64))
        found = F.lit(True)
        for j in range(self.hashes):
            bit = F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(j)), F.lit(64 * len(self.words)))
            word = F.get(words, F.floor(bit / 64).cast("int"))
            found = found & (_bit(word, bit) == 1)
        return found


def _bit(word: Column, bit: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, F.pmod(bit, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long"))


def _hashes(rate: float) -> int:
    return max(1, round(-math.log2(rate)))


def _words(n: int, rate: float) -> int:
    return max(1, math.ceil(n * _hashes(rate) / math.log(2) / 64))


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter over the ``n`` rows of ``keys`` with about this rate of false positives, made by aggregation."""
    hashes, words = _hashes(rate), _words(n, rate)
    bits = F.array(*[F.pmod(F.xxhash64(F.col("key"), F.lit(seed), F.lit(j)), F.lit(64 * words)) for j in range(hashes)])
    each = keys.select(F.explode(bits).alias("bit")).select(F.floor(F.col("bit") / 64).alias("word"), F.pmod("bit", F.lit(64)).cast("int").alias("at"))
    rows = each.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits")).collect()  # at most ``words`` rows
    filled = dict(map(tuple, rows))
    return Level(tuple(filled.get(i, 0) for i in range(words)), hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(~self.levels[i].might_contain(key), F.lit(i % 2 == 1)).otherwise(answer)
        return answer


def first_rate(n: int, universe_size: int) -> float:
    """The rate of level 1 that balances it against the others, whose rate is one half."""
    return min(0.5, max(1e-9, math.sqrt(0.5) * n / max(1, universe_size)))


def build_cascades(listed: dict[str, DataFrame], universe: DataFrame, *, universe_size: int, max_levels: int = 64) -> dict[str, Cascade]:
    """A cascade for each list. The lists and ``universe`` have one column, ``key``. The universe is read once: the keys
    that some level 1 takes for listed are written, and all further levels come from these few."""
    included = {name: keys.distinct() for name, keys in listed.items()}
    sizes = {name: keys.count() for name, keys in included.items()}
    first = {name: _level(included[name], n, first_rate(n, universe_size), 0) for name, n in sizes.items() if n}
    cascades = {name: Cascade(()) for name in listed}
    if not first:
        return cascades
    taken = reduce(Column.__or__, [level.might_contain(F.col("key")) for level in first.values()])
    pool = materialise(universe.where(taken).distinct(), "keys")
    for name, level in first.items():
        levels = [level]
        other, current = included[name], pool.where(level.might_contain(F.col("key"))).join(included[name], "key", "left_anti")
        while (size := current.count()) and len(levels) < max_levels:
            levels.append(_level(current, size, 0.5, len(levels)))
            other, current = current, other.where(levels[-1].might_contain(F.col("key")))
        if size:
            raise ValueError("the cascade did not converge")
        cascades[name] = Cascade(tuple(levels))
    discard(pool)
    return cascades


def url_filter(df: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_bits: int = 1 << 22) -> DataFrame:
    """Per row: ``id_col``, host, path, rule (the longest that fits, else null) and verdict.

    Where level 1 of a list would have more than ``max_bits`` bits, the keys are divided by a hash into so many shards
    that it has not, and the shards are gone through in as many passes, so that no plan carries more than one's filters.
    """
    spark = df.sparkSession
    source = narrow(df, id=id_col, url=url_col).select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    verdicts = sorted({r.verdict for r in rules})
    best = F.lit(None).cast("string")
    verdict = F.lit(default)
    if rules:
        keys = candidate_keys(F.col("host"), F.col("path"), rules)
        per_url = len({r.host.count(".") for r in rules}) * len({len(r.path) for r in rules})
        size = per_url * df.count()  # sizes the first levels only
        lists = {v: sorted({r.key for r in rules if r.verdict == v}) for v in verdicts}
        shards = max(-(-64 * _words(len(x), first_rate(len(x), size)) // max_bits) for x in lists.values())
        in_shard = lambda key, k: F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards)) == k if shards > 1 else F.lit(True)
        longest = lambda a, b: F.aggregate(a, b, lambda x, y: F.when(F.length(y) > F.length(x), y).otherwise(x))
        source = source.withColumn("keys", keys).select("*", *[F.lit("").alias(f"in_{v}") for v in verdicts])
        for k in range(shards):
            universe = source.select(F.explode("keys").alias("key")).where(in_shard(F.col("key"), k))
            listed = {v: spark.createDataFrame([(x,) for x in lists[v]], "key string").where(in_shard(F.col("key"), k)) for v in verdicts}
            cascades = build_cascades(listed, universe, universe_size=-(-size // shards))
            for v in verdicts:
                found = F.filter("keys", lambda key: in_shard(key, k) & cascades[v].contains(key))  # noqa: B023
                source = source.withColumn(f"in_{v}", longest(found, F.col(f"in_{v}")))
            if k + 1 < shards:
                source = materialise(source, "urls")
        best = F.nullif(F.array_max(F.array(*[F.struct(F.length(f"in_{v}").alias("n"), F.col(f"in_{v}").alias("key")) for v in verdicts]))["key"], F.lit(""))
        for v in verdicts:
            verdict = F.when(F.col("rule") == F.col(f"in_{v}"), F.lit(v)).otherwise(verdict)
    return source.withColumn("rule", best).select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
