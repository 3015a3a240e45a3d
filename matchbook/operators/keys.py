"""Blocking-key profiles (reference generations v1, v2, v4; v3 == v4).

A record yields 0..1 key per key type. Keys are built as one array
expression per record and exploded, so key generation is a narrow map stage.
Key = ``(tag, key)`` with ``key = country|token|token…``; tokens never hold
``|`` (punctuation is removed), so the encoding is injective per tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.functions import text as tx
from matchbook.functions.constants import COMMON_ADDR_TOKENS, SKIP_ADDR_V3, SKIP_ADDR_V4

# Specificity used to rank candidates when the per-entity cap binds (lower is
# more specific). ``n1all`` is the broadest key and always ranks last.
KEY_PRIORITY = {
    "n3": 1, "n2": 2, "n1": 3, "fl": 4, "sfx2": 5, "zip": 6,
    "addr_12": 7, "addr_m": 7, "addr_23": 8, "addr_s": 8,
    "addr_e": 9, "addr_end": 9, "n1all": 10,
}
# One bit per tag, for key masks.
KEY_BIT = {t: i for i, t in enumerate(
    ["n2", "n1", "n1all", "sfx2", "fl", "n3", "zip",
     "addr_m", "addr_s", "addr_12", "addr_23", "addr_e", "addr_end"])}

PROFILES = ("v1", "v2", "v3", "v4")

_PROFILE_TAGS = {
    "v1": ["n2", "n1", "sfx2", "fl", "n3", "zip"],
    "v2": ["n2", "n1all", "sfx2", "fl", "n3", "zip", "addr_m", "addr_s", "addr_e"],
    "v3": ["n2", "n1all", "sfx2", "fl", "n3", "zip", "addr_12", "addr_23", "addr_end"],
    "v4": ["n2", "n1all", "sfx2", "fl", "n3", "zip", "addr_12", "addr_23", "addr_e"],
}


def profile_tags(version: str) -> list[str]:
    """Key types a profile emits (priorities are unique within a profile)."""
    return list(_PROFILE_TAGS[version])


def _key(tag: str, cond: Column, cty: Column, *parts: Column) -> Column:
    return F.struct(F.lit(tag).alias("tag"),
                    F.when(cond, F.concat_ws("|", cty, *parts)).alias("key"))


def _len(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0))


def _at(arr: str, i: int) -> Column:
    return F.try_element_at(F.col(arr), F.lit(i))


def key_inputs(norm: DataFrame, version: str, id_col: str = "entity_id") -> DataFrame:
    """Token arrays computed once per record (``_cty, _nt, _at, _zipv`` and the
    filtered ``_sig``/``_sat`` of v1/v2). Catalyst keeps this projection
    separate because every array is referenced many times by the keys, so the
    splits run once per record instead of once per key."""
    pre = norm.select(F.col(id_col).alias("entity_id"),
                      tx.fold_country(F.col("country")).alias("_cty"),
                      tx.tokens(F.coalesce(F.col("norm_name"), F.lit(""))).alias("_nt"),
                      tx.tokens(F.coalesce(F.col("norm_address"), F.lit(""))).alias("_at"),
                      F.col("zip_pin"))
    a0 = F.try_element_at(F.col("_at"), F.lit(1))
    z = F.col("zip_pin")
    pre = pre.withColumn("_zipv", F.when(z.isNotNull() & (z != "") & (a0.isNull() | (z != a0)), z))
    if version in ("v1", "v2"):
        pre = pre.withColumn("_sig", F.filter("_nt", lambda x: F.length(x) >= 2))
    if version == "v2":
        pre = pre.withColumn("_sat", F.filter(
            "_at", lambda x: (F.length(x) >= 3) & ~x.isin(*COMMON_ADDR_TOKENS)))
    return pre


def _keys_sig_profile(version: str) -> list[Column]:
    """v1 / v2: positions over name tokens of length >= 2."""
    cty, zipv = F.col("_cty"), F.col("_zipv")
    n = F.size("_sig")
    at = lambda i: _at("_sig", i)
    keys = [_key("n2", n >= 2, cty, at(1), at(2))]
    if version == "v1":
        keys.append(_key("n1", n == 1, cty, at(1)))
    else:
        keys.append(_key("n1all", n >= 1, cty, at(1)))
    keys += [
        _key("sfx2", n >= 3, cty, at(-2), at(-1)),
        _key("fl", n >= 3, cty, at(1), at(-1)),
        _key("n3", n >= 3, cty, at(1), at(2), at(3)),
        _key("zip", zipv.isNotNull(), cty, zipv),
    ]
    if version == "v2":
        m = F.size("_sat")
        sa = lambda i: _at("_sat", i)
        keys += [
            _key("addr_m", m >= 4, cty, sa(3), sa(4)),
            _key("addr_s", m >= 3, cty, sa(2), sa(3)),
            _key("addr_e", m >= 4, cty, sa(-3), sa(-2)),
        ]
    return keys


def _keys_positional_profile(version: str) -> list[Column]:
    """v3 / v4: positions over all tokens, each chosen token must be long enough."""
    skip = SKIP_ADDR_V3 if version == "v3" else SKIP_ADDR_V4
    end_tag = "addr_end" if version == "v3" else "addr_e"
    cty, zipv = F.col("_cty"), F.col("_zipv")
    n = lambda i: _at("_nt", i)
    a = lambda i: _at("_at", i)
    nlen, alen = F.size("_nt"), F.size("_at")
    n0, n1, n2, nlast, n2last = n(1), n(2), n(3), n(-1), n(-2)

    def ok_name(*toks: Column) -> Column:
        cond = F.lit(True)
        for t in toks:
            cond = cond & (_len(t) >= 2)
        return cond

    def ok_addr(*toks: Column) -> Column:
        cond = F.lit(True)
        for t in toks:
            cond = cond & (_len(t) >= 3) & ~F.coalesce(t.isin(*skip), F.lit(False))
        return cond

    a1, a2, a3, ae3, ae2 = a(2), a(3), a(4), a(-3), a(-2)
    return [
        _key("n2", ok_name(n0, n1), cty, n0, n1),
        _key("n1all", ok_name(n0), cty, n0),
        _key("sfx2", (nlen >= 3) & ok_name(n2last, nlast), cty, n2last, nlast),
        _key("fl", (nlen >= 3) & ok_name(n0, nlast), cty, n0, nlast),
        _key("n3", (nlen >= 3) & ok_name(n0, n1, n2), cty, n0, n1, n2),
        _key("zip", zipv.isNotNull(), cty, zipv),
        _key("addr_12", ok_addr(a1, a2), cty, a1, a2),
        _key("addr_23", ok_addr(a2, a3), cty, a2, a3),
        _key(end_tag, ok_addr(ae3, ae2) & (alen >= 5), cty, ae3, ae2),
    ]


def key_array(version: str) -> Column:
    """All non-null keys of one record as ``array<struct<tag,key>>`` over the
    columns of ``key_inputs`` (B15)."""
    if version in ("v1", "v2"):
        ks = _keys_sig_profile(version)
    elif version in ("v3", "v4"):
        ks = _keys_positional_profile(version)
    else:
        raise ValueError(f"unknown key profile {version!r}")
    return F.filter(F.array(*ks), lambda k: k["key"].isNotNull())


def explode_keys(norm: DataFrame, version: str, id_col: str = "entity_id") -> DataFrame:
    """Long key table ``(entity_id, tag, key)`` from normalised records."""
    pre = key_inputs(norm, version, id_col)
    return (pre.select("entity_id", F.explode(key_array(version)).alias("k"))
                .select("entity_id", F.col("k.tag").alias("tag"), F.col("k.key").alias("key")))


def priority_of(tag: Column) -> Column:
    m = F.create_map(*[x for t, p in KEY_PRIORITY.items() for x in (F.lit(t), F.lit(p))])
    return F.try_element_at(m, tag)


def bit_of(tag: Column) -> Column:
    m = F.create_map(*[x for t, b in KEY_BIT.items() for x in (F.lit(t), F.lit(1 << b))])
    return F.try_element_at(m, tag).cast("long")


def key_stats(keys: DataFrame) -> DataFrame:
    """Index statistics per tag plus an ``ALL`` row.

    ``unique_keys`` counts distinct (tag,key), ``entries`` index postings,
    ``records`` distinct entities carrying at least one key of the tag.
    """
    per_tag = (keys.groupBy("tag")
               .agg(F.count_distinct("key").alias("unique_keys"),
                    F.count(F.lit(1)).alias("entries"),
                    F.count_distinct("entity_id").alias("records")))
    total = keys.agg(F.lit("ALL").alias("tag"),
                     F.count_distinct("tag", "key").alias("unique_keys"),
                     F.count(F.lit(1)).alias("entries"),
                     F.count_distinct("entity_id").alias("records"))
    return per_tag.unionByName(total)
