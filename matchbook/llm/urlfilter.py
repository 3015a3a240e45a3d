"""Operator 3: URL filters by a Bloom filter cascade.

A list of keys (host plus path prefix) is turned into exact set membership
over the corpus's own key universe. Level 1 encodes the listed keys; level 2
the unlisted keys of the universe that level 1 lets through by mistake; level
3 the listed keys that level 2 lets through; and so on until a level has no
mistake left. A key is listed if the first level that rejects it has an even
number. There is no wrong answer for a key of the universe, and every judged
key is one.

Scale: the universe is the distinct keys of the corpus, pre-aggregated before
it is shuffled. Level 1 is sized so that about as many keys pass by mistake as
are listed, later levels halve them, so the cascade takes a few bytes a listed
key, however large the corpus. It is broadcast only up to ``MAX_BITS``; a
longer list of hosts is joined instead, where AQE splits a hot host. Pages
are scanned, not shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.llm.common import map_arrow, without, written

# The rules every run applies, as (verdict, host, path prefix)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: words of a host label that put the whole host on the block list
BLOCK_WORDS = ["ads", "track", "casino", "spam", "adult", "porn", "sex", "xxx", "pills", "bets", "betting", "gambling", "viagra", "warez"]
MAX_BITS = 1 << 30
ADDED = ("host", "path", "rule", "verdict", "listed_host")


def _after_scheme(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lowered; empty if there is none."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty if there is none."""
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first; none for an empty host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys that could fit a URL, for path prefixes of the given lengths; longest first."""
    if not lengths:
        return F.array().cast("array<string>")
    sized = F.flatten(F.transform(suffixes(host), lambda s: F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)),
        lambda n: F.struct((-F.length(s) - n).alias("size"), (-F.length(s)).alias("host"),
                           F.concat(s, F.substr(path, F.lit(1), n)).alias("key")))))
    return F.transform(F.array_sort(sized), lambda x: x["key"])


@dataclass
class Cascade:
    """Bit arrays of the levels, with the number of hash functions of each."""

    levels: list[tuple[np.ndarray, int, int]]  # words, bits, hashes

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Membership of keys given by their two 64-bit hashes."""
        listed = np.zeros(len(a), bool)
        left = np.arange(len(a))
        for number, level in enumerate(self.levels, 1):
            hit = in_level(level, number, a[left], b[left])
            listed[left[~hit]] = number % 2 == 0
            left = left[hit]
        listed[left] = len(self.levels) % 2 == 1  # passed every level
        return listed


def _positions(a: np.ndarray, b: np.ndarray, number: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    """Places of keys in a level; mixed with its number, so that levels err independently."""
    x = a.astype(np.uint64) ^ np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    step = b.astype(np.uint64) | np.uint64(1)
    for i in range(hashes):
        yield (((x + np.uint64(i) * step) >> np.uint64(1)) % np.uint64(bits)).astype(np.int64)


def in_level(level: tuple[np.ndarray, int, int], number: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    words, bits, hashes = level
    hit = np.ones(len(a), bool)
    for at in _positions(a, b, number, bits, hashes):
        hit &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return hit


def hashes_of(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(7), key)


def _level(keys: DataFrame, n: int, number: int, rate: float) -> tuple[np.ndarray, int, int]:
    """A Bloom filter over ``keys`` (a, b): bits set by the tasks, merged by word."""
    hashes = max(1, round(math.log2(1 / rate)))
    bits = max(64, math.ceil(n * hashes / math.log(2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            at = np.unique(np.concatenate([np.zeros(0, np.int64), *_positions(a, b, number, bits, hashes)]))
            words, first = np.unique(at >> 6, return_index=True)
            if len(words):
                ones = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(ones.view(np.int64))], ["word", "bits"])

    words = map_arrow(keys, run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(bits // 64 + 1, np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.view(np.uint64), bits, hashes


def _passing(keys: DataFrame, level: tuple[np.ndarray, int, int], number: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            yield batch.filter(pa.array(in_level(shared.value, number, a, b)))

    return map_arrow(keys, run, keys.schema)


def build_cascade(listed: DataFrame, universe: DataFrame, name: str = "cascade") -> Cascade | None:
    """Cascade of ``listed`` (key) within ``universe`` (key).

    None if level 1 would not fit into ``MAX_BITS``. Null keys belong to neither side.
    """
    hashed = lambda df: df.where(F.col("key").isNotNull()).select("key").distinct().select(
        "key", *[h.alias(n) for h, n in zip(hashes_of(F.col("key")), "ab")])
    yes = written(hashed(listed), f"{name}-listed")
    no = written(hashed(universe).join(yes.select("key"), "key", "left_anti"), f"{name}-unlisted")
    n_yes, n_no = yes.count(), no.count()
    if n_yes == 0:
        return Cascade([])
    rate = min(0.5, max(1e-9, n_yes / max(1, n_no)))
    if n_yes * math.log2(1 / rate) / math.log(2) > MAX_BITS:
        return None
    levels: list[tuple[np.ndarray, int, int]] = []
    inside, outside, n = yes, no, n_yes
    while n:
        number = len(levels) + 1
        levels.append(_level(inside, n, number, rate))
        rate = 0.5
        # what the new level lets through by mistake is what the next one encodes
        inside, outside = written(_passing(outside, levels[-1], number), f"{name}-{number}"), inside
        n = inside.count()
    return Cascade(levels)


def _judge(shared, names: list[str]):
    """For each cascade the first listed candidate of a row, by place; -1 if none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascades = [Cascade(levels) for levels in shared.value]
        for batch in batches:
            out = list(batch.columns)
            for cascade, column in zip(cascades, ("__keys", "__keys", "__hosts")):
                sizes = np.diff(np.asarray(batch.column(column + "_a").offsets))
                a, b = (np.asarray(batch.column(column + c).flatten()).astype(np.int64) for c in ("_a", "_b"))
                row = np.repeat(np.arange(batch.num_rows), sizes)
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                hit = np.flatnonzero(cascade.contains(a, b))[::-1]
                first = np.full(batch.num_rows, -1, np.int32)
                first[row[hit]] = place[hit]  # the last one written is the first one found
                out.append(pa.array(first, pa.int32()))
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, *names])
    return run


def listed_hosts(pages: DataFrame, words: list[str] = BLOCK_WORDS) -> DataFrame:
    """(key): hosts of the corpus one of whose labels has a block word between non-letters."""
    pattern = rf"(^|[^a-z])({'|'.join(words)})([^a-z]|$)"
    return pages.select(host_of(F.col("url")).alias("key")).where(F.col("key").rlike(pattern)).distinct()


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES,
                blocked_hosts: DataFrame | None = None) -> DataFrame:
    """Judge every url: adds host, path, rule, verdict and listed_host.

    Three cascades answer: the allow rules, the block rules and the listed
    hosts. The longest rule that fits decides; of two of one length, the one
    of the longer host. A url that no rule fits is blocked if its host is
    listed, else allowed. A null url or one without ``://`` has an empty host
    and path and is allowed. Input columns with the added names are replaced;
    an empty table stays empty.
    """
    spark = pages.sparkSession
    pages = without(pages, ADDED)
    blocked = listed_hosts(pages) if blocked_hosts is None else blocked_hosts
    lengths = sorted({len(path) for _, _, path in rules})
    parts = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    longest = max(lengths, default=0)
    keys = written(parts.select("host", F.substr("path", F.lit(1), F.lit(longest)).alias("path")).distinct()
                   .select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("key")).distinct(), "keys")
    hosts = parts.select(F.col("host").alias("key")).distinct()
    rule_keys = lambda verdict: spark.createDataFrame(
        [(h + p,) for v, h, p in rules if v == verdict], "key string")
    cascades = [build_cascade(rule_keys("allow"), keys, "allow"), build_cascade(rule_keys("block"), keys, "block"),
                build_cascade(blocked, hosts, "hosts")]
    judged = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    judged = judged.withColumn("__keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    listed_by_join = cascades[2] is None
    if listed_by_join:
        cascades[2] = Cascade([])
    for column, keys_of in (("__keys", F.col("__keys")), ("__hosts", F.array("host"))):
        judged = (judged.withColumn(column + "_a", F.transform(keys_of, lambda k: hashes_of(k)[0]))
                  .withColumn(column + "_b", F.transform(keys_of, lambda k: hashes_of(k)[1])))
    shared = spark.sparkContext.broadcast([c.levels for c in cascades])
    names = ["__allow", "__block", "__host"]
    schema = T.StructType([*judged.schema.fields, *[T.StructField(n, T.IntegerType()) for n in names]])
    judged = map_arrow(judged, _judge(shared, names), schema)
    allow, block = F.col("__allow"), F.col("__block")
    rule_at = F.when(allow < 0, block).when(block < 0, allow).otherwise(F.least(allow, block))
    if listed_by_join:
        judged = judged.join(blocked.select(F.col("key").alias("__key")).distinct(), F.col("host") == F.col("__key"), "left") \
            .withColumn("__host", F.when(F.col("__key").isNotNull(), 0).otherwise(-1)).drop("__key")
    return (judged.withColumn("rule", F.when(rule_at >= 0, F.get(F.col("__keys"), rule_at)))
            .withColumn("listed_host", F.col("__host") >= 0)
            .withColumn("verdict", F.when(rule_at >= 0, F.when(rule_at == allow, "allow").otherwise("block"))
                        .when(F.col("listed_host"), "block").otherwise("allow"))
            .drop("__keys", "__keys_a", "__keys_b", "__hosts_a", "__hosts_b", *names))


_SQL_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE = f"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(v, h, x) AS (VALUES {_SQL_RULES}),
f AS (SELECT page_id, host, path, max_by(h || x, length(h || x) * 1000 + length(h)) AS rule, max_by(v, length(h || x) * 1000 + length(h)) AS v
      FROM q LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x) GROUP BY ALL)
SELECT page_id, host, path, rule,
  regexp_matches(host, '(^|[^a-z])({'|'.join(BLOCK_WORDS)})([^a-z]|$)') AS listed_host,
  coalesce(v, CASE WHEN regexp_matches(host, '(^|[^a-z])({'|'.join(BLOCK_WORDS)})([^a-z]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM f
"""
