"""Blocking: exactness of the truncated join, profile equivalences, cap bounds."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF0001
from matchbook.operators import blocking as bl
from matchbook.operators.keys import KEY_PRIORITY, explode_keys
from matchbook.plans.catalog import split_norm


def _brute_force(s1, tg, version, cap):
    """Full join without block truncation, then rank: the specification."""
    j = bl.probe(explode_keys(s1, version), explode_keys(tg, version))
    prio = F.create_map(*[x for t, p in KEY_PRIORITY.items() for x in (F.lit(t), F.lit(p))])
    p = j.groupBy("s1_id", "cand_id").agg(F.min(prio[F.col("tag")]).alias("prio"))
    w = Window.partitionBy("s1_id").orderBy("prio", F.md5("cand_id"), "cand_id")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def _set(df):
    return {tuple(r) for r in df.select("s1_id", "cand_id").collect()}


def test_truncated_join_equals_brute_force_for_small_caps(spark):
    s1, tg = split_norm(spark, SF0001)
    for cap in (1, 3, 7, 20):
        fast = bl.block(s1, tg, "v4", cap)
        assert _set(fast) == _set(_brute_force(s1, tg, "v4", cap)), cap
        assert fast.groupBy("s1_id").count().agg(F.max("count")).first()[0] <= cap


def test_repeated_target_rows_take_one_place(spark):
    s1, tg = split_norm(spark, SF0001)
    assert _set(bl.block(s1, tg.unionByName(tg), "v4", 7)) == _set(bl.block(s1, tg, "v4", 7))


def test_cap_prefers_no_source(spark):
    """Of a block of equal names the cap keeps both sources, whatever their ids."""
    s1, tg = split_norm(spark, SF0001)
    one = tg.limit(1).drop("entity_id", "src")
    many = spark.range(400).selectExpr("concat('S', 2 + id % 2, '-', id) AS entity_id", "CAST(2 + id % 2 AS INT) AS src") \
        .join(one).select(*tg.columns)
    query = one.selectExpr("'S1-x' AS entity_id", "1 AS src", "*").select(*tg.columns)
    n = {r[0]: r[1] for r in bl.block(query, many, "v4", 100).groupBy(F.substring("cand_id", 1, 2)).count().collect()}
    assert sum(n.values()) == 100 and min(n["S2"], n["S3"]) > 30


def test_capped_is_subset_of_uncapped(spark):
    s1, tg = split_norm(spark, SF0001)
    small, big = _set(bl.block(s1, tg, "v2", 5)), _set(bl.block(s1, tg, "v2", 10_000))
    assert small <= big and len(small) < len(big)


def test_v3_equals_v4_up_to_tag_name(spark):
    s1, tg = split_norm(spark, SF0001)
    n = s1.unionByName(tg)
    k3 = explode_keys(n, "v3").withColumn("tag", F.when(F.col("tag") == "addr_end", "addr_e").otherwise(F.col("tag")))
    k4 = explode_keys(n, "v4")
    assert k3.exceptAll(k4).count() == 0 and k4.exceptAll(k3).count() == 0


def test_redundant_name_keys(spark):
    """In v4 a pair sharing n2, n3 or fl also shares n1all, so membership
    without a cap is unchanged when those keys are dropped."""
    s1, tg = split_norm(spark, SF0001)
    keep = ["n1all", "sfx2", "zip", "addr_12", "addr_23", "addr_e"]
    full = bl.probe(explode_keys(s1, "v4"), explode_keys(tg, "v4"))
    reduced = bl.probe(explode_keys(s1, "v4").where(F.col("tag").isin(keep)),
                       explode_keys(tg, "v4").where(F.col("tag").isin(keep)))
    assert _set(full.distinct()) == _set(reduced.distinct())


def test_partition_count_independence(spark):
    s1, tg = split_norm(spark, SF0001)
    a = _set(bl.block(s1.repartition(1), tg.repartition(1), "v4", 7))
    b = _set(bl.block(s1.repartition(7), tg.repartition(5), "v4", 7))
    assert a == b


def test_candidate_lists_keep_empty_rows(spark):
    s1 = spark.createDataFrame([("S1-a",), ("S1-b",)], "entity_id string")
    pairs = spark.createDataFrame([("S1-a", "S3-2"), ("S1-a", "S2-1")], "s1_id string, cand_id string")
    got = {r[0]: r[1] for r in bl.candidate_lists(s1, pairs).collect()}
    assert got == {"S1-a": "S2-1,S3-2", "S1-b": ""}
