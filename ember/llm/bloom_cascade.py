"""Exact membership of a closed key universe through a cascade of Bloom filters.

Level 1 encodes the listed keys.  The unlisted keys of the universe that pass
it are encoded by level 2, the listed keys that pass level 2 by level 3, and so
on until no key passes wrongly.  A key of the universe is listed exactly when
the number of leading levels it passes is odd, so lookups need no join.

Null keys belong to no universe and are never listed; repeated keys count once;
an empty list gives a cascade without levels that lists nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ember.llm.common import stored


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray  # uint64


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    @property
    def nbytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)


def _seeds(key: Column, level: int) -> list[Column]:
    """Two 64-bit hashes of a key, different at every level."""
    return [F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))]


def _position(one: Column, two: Column, i: int, bits: int) -> Column:
    return F.pmod(F.shiftrightunsigned(one, 1) % bits + F.lit(i) * (F.shiftrightunsigned(two, 1) % bits), F.lit(bits).cast("bigint"))


def _passes(level: Level, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    a, b = (one.view(np.uint64) >> np.uint64(1)) % np.uint64(level.bits), (two.view(np.uint64) >> np.uint64(1)) % np.uint64(level.bits)
    out = np.ones(len(a), dtype=bool)
    for i in range(level.hashes):
        at = (a + np.uint64(i) * b) % np.uint64(level.bits)
        out &= (level.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def _encode(keys: DataFrame, n: int, number: int, rate: float) -> Level:
    """Bits set by ``keys``, OR-ed per 64-bit word before the shuffle."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64) * 64)
    hashes = max(1, round(bits / n * math.log(2)))
    one, two = _seeds(F.col("key"), number)
    at = F.explode(F.array(*[_position(one, two, i, bits) for i in range(hashes)]))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(at % 64))")).alias("v"))
    rows = words.toPandas()
    filled = np.zeros(bits // 64, dtype=np.int64)
    filled[rows["w"].to_numpy()] = rows["v"].to_numpy()
    return Level(bits, hashes, filled.view(np.uint64))


def build_cascade(universe: DataFrame, rate: float = 0.01, max_bytes: int = 64 << 20) -> Cascade | None:
    """Cascade over ``universe`` (distinct ``key``, boolean ``listed``).

    A level takes about 10 bits per key that it encodes; the first two levels
    are nearly all of it.  Returns None when the filters would exceed
    ``max_bytes``: then they are neither collected nor broadcast and
    ``is_listed`` joins instead.  ``rate`` is the false-positive rate of a level.
    """
    keys = stored(universe.where(F.col("key").isNotNull()), "universe")
    out = Cascade()
    inside, outside = keys.where("listed").select("key"), keys.where(~F.col("listed")).select("key")
    number = 0
    while True:
        n = inside.count()
        if n == 0:
            return out
        if out.nbytes - n * math.log(rate) / math.log(2) ** 2 / 8 > max_bytes:
            return None
        level = _encode(inside, n, number, rate)
        out.levels.append(level)
        inside, outside = stored(_through(outside, level, number), "passed"), inside
        number += 1


def _through(keys: DataFrame, level: Level, number: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def passes(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series(_passes(shared.value, one.to_numpy(), two.to_numpy()))

    return keys.where(passes(*_seeds(F.col("key"), number)))


def is_listed(df: DataFrame, key: str, universe: DataFrame, cascade: Cascade | None, name: str = "listed") -> DataFrame:
    """Add the exact membership of ``key``, which must lie in the universe.

    With a cascade this is a map over the rows.  Without one (filters above the
    size bound) the listed keys are joined; a hot key splits there by itself.
    """
    if cascade is None:
        listed = universe.where("listed").select(F.col("key").alias("_listed"))
        return df.join(listed, df[key] == listed["_listed"], "left").withColumn(name, F.col("_listed").isNotNull()).drop("_listed")
    if not cascade.levels:
        return df.withColumn(name, F.lit(False))
    shared = df.sparkSession.sparkContext.broadcast(cascade)

    @F.pandas_udf("boolean")
    def member(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        levels = shared.value.levels
        for seeds in batches:
            depth, alive = np.zeros(len(seeds[0]), dtype=np.int64), np.ones(len(seeds[0]), dtype=bool)
            for i, level in enumerate(levels):
                alive &= _passes(level, seeds[2 * i].to_numpy(), seeds[2 * i + 1].to_numpy())
                depth += alive
            yield pd.Series(depth % 2 == 1)

    seeds = [s for i in range(len(cascade.levels)) for s in _seeds(F.col(key), i)]
    return df.withColumn(name, F.coalesce(F.col(key).isNotNull() & member(*seeds), F.lit(False)))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    after = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest fitting rule and its verdict; null where none fits.

    ``rules`` are ``(verdict, "host/path")``.  A rule fits its host, all its
    subdomains, and paths that start with its own.
    """
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], listed_host: Column, rate: float = 0.01, max_bytes: int = 64 << 20) -> DataFrame:
    """Judge every URL: the longest rule decides, else the block list of hosts.

    ``listed_host`` is a predicate on column ``key`` that marks the listed keys
    of the universe (all hosts of ``pages``).  Adds ``host, path, rule,
    verdict`` to the key columns; a null URL has empty host and path.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    universe = parts.select(F.col("host").alias("key")).distinct().withColumn("listed", F.coalesce(listed_host, F.lit(False)))
    cascade = build_cascade(universe, rate, max_bytes)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = is_listed(parts.withColumn("rule", rule).withColumn("_said", verdict), "host", universe, cascade, "_listed")
    method = F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_said", method).alias("verdict"))
