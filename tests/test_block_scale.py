"""Pairs of blocking are made behind the last shuffle, and are those of the full join on odd input too."""

from pyspark.sql import functions as F

from matchbook.operators import blocking as bl
from matchbook.operators import minhash as mh
from test_blocking import _brute_force

NORM = "entity_id string, norm_name string, norm_address string, zip_pin string, country string, business_address string"


def shuffled_pairs(df) -> bool:
    """Whether a shuffle reads what an explode of pairs has made."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Exchange" in plan[:plan.index("Generate explode")]


def records(spark, prefix, names):
    return spark.createDataFrame([(f"{prefix}{i}", n, "12 high street", "", "US", "12 High Street") for i, n in enumerate(names)], NORM)


def ranked(df):
    return {(r.s1_id, r.cand_id, r["rank"]) for r in df.select("s1_id", "cand_id", "rank").collect()}


def test_no_pair_is_shuffled(spark):
    s1, tg = records(spark, "S1-", ["oak mill", "oak"]), records(spark, "S2-", ["oak mill", "oak press", "elm mill"])
    assert not shuffled_pairs(bl.block(s1, tg, "v4", 2))
    assert not shuffled_pairs(mh.minhash_block(s1, tg, 2))


def test_overflow_marker_beside_the_record_itself(spark):
    """A full block that holds the record itself leaves the marker to a less specific key."""
    s1 = records(spark, "S1-", ["oak mill"])
    tg = s1.unionByName(records(spark, "S2-", ["oak mill", "oak mill", "oak press"]))
    assert bl.block(s1, tg, "v4", 2, with_overflow=True).agg(F.max("rank")).first()[0] == 3
    assert ranked(bl.block(s1, tg, "v4", 2)) == ranked(_brute_force(s1, tg, "v4", 2))


def test_rows_of_one_id_with_different_keys(spark):
    """Two blocks of the same key type are merged by the hash of the ids."""
    s1 = records(spark, "S1-", ["oak mill", "elm press"]).withColumn("entity_id", F.lit("S1-0"))
    tg = records(spark, "S2-", ["oak mill", "elm press"] * 6).unionByName(records(spark, "S2-", ["elm press"] * 3))
    for cap in (1, 4, 9, 50):
        assert ranked(bl.block(s1, tg, "v4", cap)) == ranked(_brute_force(s1, tg, "v4", cap)), cap


def test_records_without_an_id_take_no_place(spark):
    tg = records(spark, "S2-", ["oak mill"] * 4)
    tg = tg.unionByName(tg.withColumn("entity_id", F.lit(None).cast("string")))
    s1 = records(spark, "S1-", ["oak mill"])
    assert bl.block(s1, tg, "v4", 3, with_overflow=True).count() == 4


def test_hot_block_is_read_in_copies(spark, monkeypatch):
    monkeypatch.setattr(bl, "SHARE", 2)
    monkeypatch.setattr(bl, "TASK", 3)
    s1, tg = records(spark, "S1-", ["oak mill"] * 9), records(spark, "S2-", ["oak mill", "oak press"])
    assert ranked(bl.block(s1, tg, "v4", 5)) == ranked(_brute_force(s1, tg, "v4", 5))


def test_attributes_repeat_with_their_ids(spark):
    """Pairs with attributes are those of inner joins, rows that repeat an id included."""
    s1, tg = records(spark, "S1-", ["oak mill", "elm press"]), records(spark, "S2-", ["oak mill", "oak press", "elm mill"])
    left = s1.unionByName(s1.limit(1)).select(F.col("entity_id").alias("s1_id"), F.col("norm_name").alias("a"))
    right = tg.unionByName(tg.where("entity_id = 'S2-1'")).where("entity_id <> 'S2-2'").select(F.col("entity_id").alias("cand_id"), F.col("norm_name").alias("b"))
    got = bl.block_pairs(bl.profile_blocks(s1, tg, "v4", 5), left, right).select("s1_id", "cand_id", "rank", "a", "b")
    want = bl.block(s1, tg, "v4", 5).join(left, "s1_id").join(right, "cand_id").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert not shuffled_pairs(got)
