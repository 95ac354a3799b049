"""URL rules by a cascade of Bloom filters over the corpus's own keys.

A rule is a host and a path prefix; its key is the two written together. The keys of a
URL are those a rule could have: for every shape (labels of the host, length of the
path) that occurs among the rules, the host's last labels and the path's first
characters. All URLs' keys are the universe.

Level 1 of a cascade encodes the listed keys. The keys of the universe that pass it but
are not listed are encoded by level 2, the listed keys that pass level 2 by level 3, and
so on until a level lets nothing wrong through. A key's membership is then exact for the
whole universe: it is decided by the first level that does not hold it. URLs are judged
in their own partitions, without a join.

The filters of one pass are broadcast, and their size is checked (``MAX_BITS`` for a list):
the keys of a list whose cascade would be larger are halved by hash, and halved again, until
each part's cascade fits. Parts are looked up in passes one after the other, all alike.

Defined results: a null url, or one without ``://``, has an empty host and path and fits
no rule; of rules with equal keys a block wins; of several that fit, the longest key
wins; repeated rows give repeated results; an empty table or an empty list of rules is
allowed; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frozen

#: Largest size of a cascade that is broadcast; a longer list is cut into parts.
MAX_BITS = 1 << 26
LATER_RATE = 1 / 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def shapes(rules: list[tuple[str, str, str]]) -> list[tuple[int, int]]:
    return sorted({(host.count(".") + 1, len(path)) for _, host, path in rules})


def url_keys(host: Column, path: Column, wanted: list[tuple[int, int]]) -> Column:
    """array<string>: the keys of a URL that could be rules of the ``wanted`` shapes."""
    keys = [F.when((F.length(path) >= n) & (host != ""), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, n)))
            for labels, n in wanted]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def _mixed(h1: np.ndarray, h2: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Places of keys in a filter; each salt gives a hash of its own, so that no two levels agree by chance."""
    with np.errstate(over="ignore"):
        z = h1.view(np.uint64) ^ (h2.view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return (z ^ (z >> np.uint64(31))) % np.uint64(bits)


class Level:
    """One Bloom filter; its bits are set by a Spark aggregation."""

    def __init__(self, keys: DataFrame, n: int, rate: float, number: int):
        self.bits, self.number = self.size(n, rate), number
        self.k = max(1, round(-math.log2(rate)))

        def set_bits(batches):
            for pdf in batches:
                at = np.unique(np.concatenate([self._places(pdf["h1"].to_numpy(), pdf["h2"].to_numpy(), i) for i in range(self.k)]))
                bit = np.uint64(1) << (at & np.uint64(63))
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                if len(at):
                    yield pd.DataFrame({"word": word.astype(np.int64), "bits": np.bitwise_or.reduceat(bit, first).view(np.int64)})

        self.words = np.zeros(1, np.uint64)
        got = keys.mapInPandas(set_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
        self.words = np.zeros(self.bits // 64, np.uint64)
        for r in got:
            self.words[r.word] = r.bits & 0xFFFFFFFFFFFFFFFF

    def _places(self, h1: np.ndarray, h2: np.ndarray, i: int) -> np.ndarray:
        return _mixed(h1, h2, 64 * self.number + i + 1, self.bits)

    @staticmethod
    def size(n: int, rate: float) -> int:
        return max(64, 64 * math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for i in range(self.k):
            at = self._places(h1, h2, i)
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def member(levels: list, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the first level that lacks it decides."""
    out, left = np.zeros(len(h1), bool), np.arange(len(h1))
    for i, level in enumerate(levels):
        has = level(h1[left], h2[left])
        out[left[~has]] = i % 2 == 1
        left = left[has]
    out[left] = len(levels) % 2 == 1
    return out


def _passes(levels: list) -> Callable:
    @F.pandas_udf("boolean")
    def passes(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(levels[-1](h1.to_numpy(), h2.to_numpy()))
    return passes


def _hashed(df: DataFrame, key: str) -> DataFrame:
    h1, h2 = hashes(F.col(key))
    return df.select(h1.alias("h1"), h2.alias("h2"))


def cascade(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> list | None:
    """Levels that decide membership in ``listed`` (key) for every key of ``universe`` (key).

    None when they would be too large to broadcast, unless only one key is listed.
    """
    yes = frozen(_hashed(listed, "key").distinct(), "bloom-listed")
    n = yes.count()
    if not n:
        return []
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, max(1e-9, math.sqrt(0.5) * n / max(1, size)))
    if n == 1:
        max_bits = MAX_BITS
    if Level.size(n, rate) > max_bits:
        return None
    levels = [Level(yes, n, rate, 0)]
    inside = yes
    outside = frozen(_hashed(universe, "key").where(_passes(levels)("h1", "h2")).distinct().join(yes, ["h1", "h2"], "left_anti"), "bloom-outside")
    while True:
        n = outside.count()
        if not n:
            return levels
        if sum(x.bits for x in levels) + Level.size(n, LATER_RATE) > max_bits:
            return None
        levels.append(Level(outside, n, LATER_RATE, len(levels)))
        inside, outside = outside, frozen(inside.where(_passes(levels)("h1", "h2")), "bloom-level")


def parts(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS, modulus: int = 1, rest: int = 0) -> list[tuple[int, int, list]]:
    """(modulus, rest, cascade) of the parts of ``listed`` by the first hash of its keys, each of a size to broadcast."""
    mine = lambda df: df.where(F.pmod(hashes(F.col("key"))[0], F.lit(modulus)) == rest) if modulus > 1 else df
    levels = cascade(mine(listed), mine(universe), max_bits)
    if levels is not None:
        return [(modulus, rest, levels)]
    return [x for r in (rest, rest + modulus) for x in parts(listed, universe, max_bits, 2 * modulus, r)]


def _coder(block: tuple[int, int, list] | None, allow: tuple[int, int, list] | None) -> Callable:
    """Column function of the keys' hashes: 1 for a key in the block part, 2 for one in the allow part, else 0."""
    @F.pandas_udf("array<int>")
    def codes(first: pd.Series, second: pd.Series) -> pd.Series:
        if not len(first):
            return pd.Series([], dtype=object)
        sizes = first.map(len).to_numpy()
        h1, h2 = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (first, second))
        code = np.zeros(len(h1), np.int64)
        for value, part in ((2, allow), (1, block)):
            if part is not None:
                at = np.flatnonzero(h1 % part[0] == part[1])
                code[at[member(part[2], h1[at], h2[at])]] = value
        return pd.Series([x.tolist() for x in np.split(code, np.cumsum(sizes)[:-1])], dtype=object)
    return codes


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
          default: str = "allow", max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; rules are (verdict, host, path).

    A URL that fits no rule is on no list, and gets the verdict ``default``.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("keys", url_keys(F.col("host"), F.col("path"), shapes(rules)))
    universe = rows.select(F.explode("keys").alias("key"))
    block = {h + p for v, h, p in rules if v == "block"}
    lists = {"block": block, "allow": {h + p for v, h, p in rules if v == "allow"} - block}
    tables = {v: spark.createDataFrame([(k,) for k in sorted(keys)], "key string") for v, keys in lists.items()}
    passes = zip_longest(*[parts(tables[v], universe, max_bits) for v in ("block", "allow")])
    first, second = F.transform("keys", lambda k: hashes(k)[0]), F.transform("keys", lambda k: hashes(k)[1])

    coded = rows.withColumn("codes", _coder(*next(passes))(first, second))
    for both in passes:
        coded = frozen(coded, "url-codes").withColumn("more", _coder(*both)(first, second))
        coded = coded.withColumn("codes", F.zip_with("codes", "more", lambda a, b: F.greatest(a, b))).drop("more")
    fits = F.filter(F.transform(F.arrays_zip("keys", "codes"), lambda x: F.struct(
        F.length(x["keys"]).alias("n"), x["keys"].alias("key"), x["codes"].alias("code"))), lambda x: x["code"] > 0)
    best = F.array_max(fits)
    return coded.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.key").alias("rule"),
        F.when(F.col("best.code") == 1, "block").when(F.col("best.code") == 2, "allow").otherwise(default).alias("verdict"))
