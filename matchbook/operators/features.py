"""Pair features over candidate pairs (specified matching stage, M08–M21).

What a record brings to its pairs is computed once a record and attached to both
sides by id (J08); every feature is a column expression of the two sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.functions import similarity as sim
from matchbook.functions import text as tx
from matchbook.operators.blocking import Blocks, block_pairs
from matchbook.operators.pair_kernels import block_features

NAME_FEATURES = ["name_char3_jaccard", "name_token_jaccard", "name_lev_ratio",
                 "token_sort_ratio", "prefix_tokens", "name_phonetic_match"]
ADDR_FEATURES = ["zip_match", "street_no_match", "addr_token_jaccard", "addr_lev_ratio",
                 "addr_component_overlap"]
META_FEATURES = ["country_match", "name_len_ratio", "both_address"]


SCORE_FEATURES = ["name_char3_jaccard", "token_sort_ratio", "addr_token_jaccard", "both_address"]
ALL = NAME_FEATURES + ADDR_FEATURES + META_FEATURES


def record_columns() -> dict[str, Column]:
    """What a record brings to its pairs, computed once a record."""
    name, address = F.col("norm_name"), F.col("norm_address")
    return {"norm_name": name, "norm_address": address, "zip_pin": F.col("zip_pin"),
            "country": tx.fold_country(F.col("country")), "grams": sim.gram_codes(name),
            "words": tx.tokens(F.coalesce(name, F.lit(""))), "word_set": sim.token_set(name),
            "sorted": sim.token_sort(name), "sound": sim.soundex_first(name),
            "address_set": sim.token_set(address), "number": sim.first_number(address),
            "parts": sim.address_components(F.col("business_address"))}


def attach(pairs: DataFrame, norm: DataFrame, columns: list[str]) -> DataFrame:
    """pairs ⋈ S1 attributes ⋈ target attributes."""
    made = record_columns()
    a = norm.select(F.col("entity_id").alias("s1_id"), *[made[c].alias(f"{c}_a") for c in columns])
    b = norm.select(F.col("entity_id").alias("cand_id"), *[made[c].alias(f"{c}_b") for c in columns])
    return pairs.join(a, "s1_id").join(b, "cand_id")


def name_features() -> dict[str, tuple[list[str], Callable]]:
    """Feature -> (record columns, expression of the two sides)."""
    return {
        "name_char3_jaccard": (["grams"], sim.jaccard),
        "name_token_jaccard": (["word_set"], sim.jaccard),
        "name_lev_ratio": (["norm_name"], sim.lev_ratio),
        "token_sort_ratio": (["sorted"], sim.lev_ratio),
        "prefix_tokens": (["words"], sim.common_prefix),
        "name_phonetic_match": (["sound"], lambda a, b: (a == b).cast("int")),
        "name_jaro_winkler": (["norm_name"], sim.jaro_winkler),
    }


def addr_features() -> dict[str, tuple[list[str], Callable]]:
    both = lambda a, b: (a != "") & (b != "")
    return {
        "zip_match": (["zip_pin"], lambda a, b: F.when(both(a, b), (a == b).cast("int"))),
        "street_no_match": (["number"], lambda a, b: F.when(a.isNotNull() & b.isNotNull(), (a == b).cast("int"))),
        "addr_token_jaccard": (["address_set", "norm_address"], lambda a, b, x, y: F.when(both(x, y), sim.jaccard(a, b))),
        "addr_lev_ratio": (["norm_address"], lambda a, b: F.when(both(a, b), sim.lev_ratio(a, b))),
        "addr_component_overlap": (["parts"], lambda a, b: F.when(
            a.isNotNull() & b.isNotNull(), F.size(F.array_intersect(a, b)).cast("long"))),
    }


def _length_ratio(a: Column, b: Column) -> Column:
    la, lb = F.length(a), F.length(b)
    m = F.greatest(la, lb)
    return F.when(m > 0, F.round(F.least(la, lb) / m, 6)).otherwise(F.lit(0.0))


def meta_features() -> dict[str, tuple[list[str], Callable]]:
    return {
        "country_match": (["country"], lambda a, b: (a == b).cast("int")),
        "name_len_ratio": (["norm_name"], _length_ratio),
        "both_address": (["norm_address"], lambda a, b: ((a != "") & (b != "")).cast("int")),
    }


def all_features(pairs: DataFrame | Blocks, norm: DataFrame, features: list[str] | None = None, truth: DataFrame | None = None) -> DataFrame:
    """Pairs with their features, all or those that are named; those of blocks with ``n_true``, how often ``truth`` has them, if it is given.

    The pairs of blocks are compared many at once (``pair_kernels``). Other features are made in an explode of one
    struct: filters and projections that follow are not moved below it, so each feature is computed once a pair.
    """
    features = ALL if features is None else features
    if isinstance(pairs, Blocks):
        return block_features(pairs, norm, features, truth)
    made = name_features() | addr_features() | meta_features()
    made = {f: made[f] for f in features}
    columns = list(dict.fromkeys(c for cols, _ in made.values() for c in cols))
    p = attach(pairs, norm, columns)
    values = [of(*[F.col(f"{c}_{side}") for c in cols for side in "ab"]).alias(f) for f, (cols, of) in made.items()]
    return p.select("s1_id", "cand_id", F.explode(F.array(F.struct(*values))).alias("f")).select("s1_id", "cand_id", "f.*")


def address_token_df(norm: DataFrame) -> DataFrame:
    """Document frequency of address tokens over all records."""
    return (norm.select("entity_id", F.explode(sim.token_set(F.col("norm_address"))).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("df")))


def rare_token_feature(pairs: DataFrame | Blocks, norm: DataFrame, max_df: int = 5) -> DataFrame:
    """``(s1_id, cand_id, shared_rare_tokens)``: shared address tokens with document frequency ≤ ``max_df``.

    The rare tokens of each record are found first, so that a pair only compares two short lists.
    """
    rare = address_token_df(norm).where(F.col("df") <= max_df).select("token")
    lists = (norm.select("entity_id", F.explode(sim.token_set(F.col("norm_address"))).alias("token"))
             .join(rare, "token", "left_semi").groupBy("entity_id").agg(F.collect_list("token").alias("rare")))
    rows = norm.select("entity_id").join(lists, "entity_id", "left")
    a, b = (rows.select(F.col("entity_id").alias(i), F.col("rare").alias(f"rare_{i}")) for i in ("s1_id", "cand_id"))
    p = block_pairs(pairs, a, b) if isinstance(pairs, Blocks) else pairs.join(a, "s1_id").join(b, "cand_id")
    shared = F.size(F.flatten(F.transform("rare_s1_id", lambda x: F.filter("rare_cand_id", lambda y: x == y))))
    return p.select("s1_id", "cand_id", F.when(F.col("rare_s1_id").isNotNull() & F.col("rare_cand_id").isNotNull(), shared)
                    .otherwise(F.lit(0)).cast("long").alias("shared_rare_tokens"))


def fixed_score(p: DataFrame) -> DataFrame:
    """Oracle-checkable stand-in scorer: 0.5 char-3 Jaccard + 0.3 token-sort
    ratio + 0.2 address Jaccard, rescaled when an address is missing."""
    cj, ts, aj = F.col("name_char3_jaccard"), F.col("token_sort_ratio"), F.col("addr_token_jaccard")
    s = F.when(F.col("both_address") == 1, 0.5 * cj + 0.3 * ts + 0.2 * aj).otherwise((0.5 * cj + 0.3 * ts) / 0.8)
    return p.withColumn("score", s)
