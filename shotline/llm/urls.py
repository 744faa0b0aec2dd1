"""URL filters as Bloom filter cascades.

A rule is an action (allow or block), a host and the beginning of a path; it fits its host and all subdomains if the
path of the url begins with the rule's, and the longest rule wins.  The keys of a url are its host's suffixes, label
by label, each followed by the beginnings of its path that have the length of some rule's path.

Each action's rules are the listed keys of a cascade: level 0 is a Bloom filter of the listed keys, level 1 one of
the keys of the corpus that pass level 0 without being listed, level 2 one of the listed keys that pass level 1, and
so on until nothing passes wrongly.  As every key of the corpus was tried, the cascade answers exactly for all of
them, and no url is joined to the list.  A cascade holds about 1.44 log2(keys of the corpus / listed keys) + 5 bits
for each listed key.  A url that no rule fits isn't listed: the verdict is allow.

Null urls and urls without :// have an empty host and path, no rule, and the verdict allow.  A rule listed for both
actions blocks.  A path or host of a rule may be empty only together with no effect: such rules are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotline.llm import shared, words

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits up to which a level is broadcast: 128 MB.  A longer list is joined to the keys instead.
MOST_BITS = 1 << 30
MOST_LEVELS = 64


class Level(NamedTuple):
    bits: int
    hashes: int
    seed: int
    words: np.ndarray


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def keys(host: Column, path: Column, sizes: list[int]) -> Column:
    """All keys of a url, the longest first."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    ends = F.filter(F.array(*[F.lit(n) for n in sorted(sizes, reverse=True)]), lambda n: F.length(path) >= n)
    each = F.flatten(F.transform(hosts, lambda h: F.transform(ends, lambda n: F.concat(h, F.substring(path, F.lit(1), n)))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(each))


def positions(one: np.ndarray, two: np.ndarray, level: Level) -> np.ndarray:
    """(keys x hashes) bit positions by double hashing."""
    salt = words.seeded(11, level.seed + 1)[-1]  # mixed anew for each level: keys that meet in one don't meet in all
    one, two = words.mix(one.view(np.uint64) ^ salt), words.mix(two.view(np.uint64) + salt) | np.uint64(1)
    return (one[:, None] + np.arange(1, level.hashes + 1, dtype=np.uint64) * two[:, None]) % np.uint64(level.bits)


def passes(level: Level, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    at = positions(one, two, level)
    return ((level.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def contains(cascade: list[Level], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether keys are listed, from both hashes of each; exact for keys of the corpus and of the list."""
    out = np.zeros(len(one), dtype=bool)
    live = np.arange(len(one))
    for i, level in enumerate(cascade):
        ok = passes(level, one[live], two[live])
        out[live[~ok]] = i % 2 == 1
        live = live[ok]
    out[live] = len(cascade) % 2 == 1
    return out


def _hashed(keys_of: DataFrame) -> DataFrame:
    return keys_of.select(F.xxhash64("key").alias("one"), F.xxhash64(F.lit("second"), "key").alias("two"))


def _bloom(hashed: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter of n hashed keys, its bits set by Spark."""
    hashes = max(1, round(-math.log2(rate)))
    level = Level(max(64, math.ceil(n * hashes * 1.45)), hashes, seed, np.zeros(0, dtype=np.uint64))
    def run(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parted:
            at = np.unique(positions(np.asarray(b.column("one")), np.asarray(b.column("two")), level))
            yield pa.record_batch({"w": pa.array((at >> np.uint64(6)).astype(np.int64)), "b": pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))})

    table = hashed.mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros((level.bits + 63) // 64, dtype=np.int64)
    bits[np.asarray(table.column("w"))] = np.asarray(table.column("b"))
    return level._replace(words=bits.view(np.uint64))


def _passing(hashed: DataFrame, level: Level) -> DataFrame:
    sent = hashed.sparkSession.sparkContext.broadcast(level)

    def run(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parted:
            yield b.filter(pa.array(passes(sent.value, np.asarray(b.column("one")), np.asarray(b.column("two")))))

    return hashed.mapInArrow(run, "one long, two long")


def build(listed: DataFrame, universe: DataFrame) -> list[Level] | None:
    """The cascade of listed keys (column key) over all keys of the corpus (column key)."""
    return _build(_hashed(listed.select("key")), _hashed(universe.select("key")).distinct())


def _build(listed: DataFrame, universe: DataFrame) -> list[Level] | None:
    """The cascade of hashed keys (one, two); None if its first level would be longer than MOST_BITS."""
    inside = shared.materialize(listed.distinct())
    n = inside.count()
    if not n:
        return []
    outside = shared.materialize(universe.join(inside, ["one", "two"], "left_anti"))
    others = outside.count()
    out: list[Level] = []
    rate = min(0.5, max(n / math.sqrt(2) / max(others, 1), 2.0**-40))
    if n * max(1, round(-math.log2(rate))) * 1.45 > MOST_BITS:
        return None
    while n:
        if len(out) == MOST_LEVELS:
            raise ValueError("two keys have the same hashes")
        out.append(_bloom(inside, n, rate if not out else 0.5, len(out)))
        inside, outside = shared.materialize(_passing(outside, out[-1])), inside  # written, so that levels don't pile up in one plan
        n = inside.count()
    return out


def _joined(parsed: DataFrame, rules: DataFrame) -> DataFrame:
    """judge for lists too long to broadcast: each url's keys joined to the rules (key, block), the longest found counts."""
    each = parsed.select("row", F.posexplode("keys").alias("place", "key")).join(rules, "key")
    best = each.groupBy("row").agg(F.min_by(F.struct("key", "block"), "place").alias("best"))
    verdict = F.when(F.col("best.block"), "block").otherwise("allow")
    return parsed.join(best, "row", "left").select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """A row for each page: key, host, path, rule (null where none fits), verdict.  rules: (action, host, path)."""
    spark = pages.sparkSession
    rules = [(a, h.translate(str.maketrans(UPPER, LOWER)), p) for a, h, p in rules if h and p]
    sizes = sorted({len(p) for _, _, p in rules})
    host, path = host_and_path(F.col(url).cast("string"))
    parsed = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("keys", keys(F.col("host"), F.col("path"), sizes) if sizes else F.array().cast("array<string>"))
    universe = shared.materialize(_hashed(parsed.select(F.explode("keys").alias("key"))).distinct())
    blocks = {h + p for a, h, p in rules if a == "block"}
    cascades = {}
    for action in ("block", "allow"):
        listed = spark.createDataFrame([(h + p,) for a, h, p in rules if a == action], "key string")
        cascades[action] = _build(_hashed(listed), universe)
    if None in cascades.values():
        every = spark.createDataFrame([(k, k in blocks) for k in {h + p for _, h, p in rules}], "key string, block boolean")
        return _joined(shared.materialize(parsed.withColumn("row", F.monotonically_increasing_id())), every)
    sent = spark.sparkContext.broadcast(cascades)
    hashed = parsed.withColumn("one", F.transform("keys", lambda k: F.xxhash64(k))).withColumn("two", F.transform("keys", lambda k: F.xxhash64(F.lit("second"), k)))

    def run(parted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parted:
            names = b.column("keys")
            one, two = (np.asarray(b.column(x).flatten()) for x in ("one", "two"))
            row = np.repeat(np.arange(b.num_rows), np.asarray(names.value_lengths().fill_null(0)))
            blocked, allowed = (contains(sent.value[a], one, two) if sent.value[a] else np.zeros(len(one), dtype=bool) for a in ("block", "allow"))
            at = np.flatnonzero(blocked | allowed)
            first, where = np.unique(row[at], return_index=True)  # keys are ordered, the longest first
            place, verdict = np.full(b.num_rows, -1), np.full(b.num_rows, "allow", dtype=object)
            place[first] = at[where]
            verdict[first[blocked[at[where]]]] = "block"
            rule = names.flatten().take(pa.array(place, mask=place < 0))
            yield pa.record_batch([b.column("page_id"), b.column("host"), b.column("path"), rule, pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema[key].dataType.simpleString()
    return hashed.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
