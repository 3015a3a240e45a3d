"""Blocking by MinHash of name grams (M07), in column expressions.

A name is the set of its character 3-grams (a shorter name is one gram). Each
gram has a number of 28 bits from its md5; ``HASHES`` linear functions modulo a
prime permute the numbers, and the least value of each is the signature, equal in two
names with about the probability of their Jaccard similarity. ``ROWS`` values
make a band, and a band is one more blocking key: it goes through the same
truncated join and cap as the other keys, so a frequent name or band never
emits all pairs of its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.functions import text as tx
from matchbook.operators import blocking as bl

HASHES, ROWS = 24, 3
PRIME = (1 << 31) - 1
#: factor and summand of each function, from a rule
FUNCTIONS = [((i + 1) * 1_103_515_245 % PRIME, (i + 1) * 747_796_405 % PRIME) for i in range(HASHES)]
TAGS = [f"mh{b}" for b in range(HASHES // ROWS)]


def grams(name: Column) -> Column:
    length = F.length(name)
    return (F.when(length >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), length - 2), lambda i: name.substr(i, F.lit(3)))))
            .when(length > 0, F.array(name)).otherwise(F.array().cast("array<string>")))


def _least(numbers: Column, factor: int, summand: int) -> Column:
    return F.array_min(F.transform(numbers, lambda x: (x * F.lit(factor).cast("long") + F.lit(summand).cast("long")) % PRIME))


def signatures(norm: DataFrame) -> DataFrame:
    """(entity_id, cty, signature): ``HASHES`` least values; names without letters have none."""
    number = lambda g: F.conv(F.substring(F.md5(g), 1, 7), 16, 10).cast("long")
    numbered = norm.select("entity_id", tx.fold_country(F.col("country")).alias("cty"),
                           F.transform(grams(F.coalesce(F.col("norm_name"), F.lit(""))), number).alias("g")).where(F.size("g") > 0)
    return numbered.select("entity_id", "cty", F.array(*[_least(F.col("g"), a, b) for a, b in FUNCTIONS]).alias("signature"))


def band_keys(signed: DataFrame) -> DataFrame:
    """(entity_id, tag, key): one row a band."""
    keys = [F.struct(F.lit(t).alias("tag"), F.concat_ws("|", "cty", *[F.col("signature")[b * ROWS + r].cast("string") for r in range(ROWS)]).alias("key"))
            for b, t in enumerate(TAGS)]
    return signed.select("entity_id", F.explode(F.array(*keys)).alias("k")).select("entity_id", "k.tag", "k.key")


def minhash_block(norm_s1: DataFrame, norm_targets: DataFrame, cap: int) -> DataFrame:
    """(s1_id, cand_id, rank): the first ``cap`` targets by ``id_order`` among those that share a band with an S1 record.

    All bands are equally specific, so every block is cut to its first ids before they meet: a target behind
    them has ``cap`` others before it that share the same band.
    """
    return bl.listed_pairs(minhash_lists(norm_s1, norm_targets, cap)).select("s1_id", "cand_id", "rank")


def minhash_lists(norm_s1: DataFrame, norm_targets: DataFrame, cap: int) -> DataFrame:
    """``(s1_id, prio, ranks, cand_ids)``: the pairs of ``minhash_block`` as arrays."""
    left, right = (band_keys(signatures(bl.spread(norm))) for norm in (norm_s1, norm_targets))
    return bl.block_lists(bl.blocks_of(left, right, cap, F.lit(0)), cap)
