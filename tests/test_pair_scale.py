"""Features of pairs are made behind the last shuffle, each once a pair."""

from pyspark.sql import functions as F

from matchbook.functions import similarity as sim
from matchbook.operators import blocking as bl
from matchbook.operators import features as fe
from test_block_scale import records, shuffled_pairs
from test_similarity import jaro_winkler_py


def both(spark):
    s1 = records(spark, "S1-", ["oak mill", "oak"])
    return s1, s1.unionByName(records(spark, "S2-", ["oak mill", "oak press", "elm mill"]))


def test_no_pair_is_shuffled_for_features(spark):
    s1, norm = both(spark)
    blocks = bl.profile_blocks(s1, norm.where("entity_id like 'S2-%'"), "v4", 2)
    for df in (fe.all_features(blocks, norm), fe.rare_token_feature(blocks, norm)):
        assert not shuffled_pairs(df)


def test_features_of_blocks_equal_those_of_pairs(spark):
    s1, norm = both(spark)
    blocks = bl.profile_blocks(s1, norm.where("entity_id like 'S2-%'"), "v4", 2)
    pairs = bl.listed_pairs(bl.block_lists(blocks, 2)).select("s1_id", "cand_id")
    for of in (fe.all_features, fe.rare_token_feature):
        assert sorted(map(str, of(blocks, norm).collect())) == sorted(map(str, of(pairs, norm).collect()))


def test_a_filter_on_the_score_computes_no_feature_twice(spark):
    s1, norm = both(spark)
    pairs = norm.selectExpr("'S1-0' AS s1_id", "entity_id AS cand_id")
    plan = fe.fixed_score(fe.all_features(pairs, norm)).where("score > 0.5")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein(sorted") == 1


def test_jaro_winkler_of_long_and_odd_texts(spark):
    texts = ["", "a", "é", "ab", "ba", "🦊fox", "fox🦊", "martha", "marhta", "x" * 3000, "x" * 2999 + "y", None]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in df.withColumn("jw", sim.jaro_winkler(F.col("a"), F.col("b"))).collect():
        assert abs(r.jw - jaro_winkler_py(r.a or "", r.b or "")) < 2e-6, r
