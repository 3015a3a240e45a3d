"""Grams as numbers compare as the grams do."""

from pyspark.sql import functions as F

from matchbook.functions import similarity as sim
from matchbook.operators import features as fe


def test_gram_codes_compare_as_the_grams_do(spark):
    texts = [None, "", "a", "ab", "aé", "abc", "abcabc", "oak mill", "oak  mill", "🦊fox", "fo🦊x", "\x00a", "a\x00", "\U0010ffff" * 4]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    both = [sim.jaccard(of(F.col("a")), of(F.col("b"))) for of in (sim.char_grams, sim.gram_codes)]
    assert df.where(~both[0].eqNullSafe(both[1])).count() == 0
    assert df.where(F.size(sim.char_grams(F.col("a"))) != F.size(sim.gram_codes(F.col("a")))).count() == 0


def test_features_compare_numbers(spark):
    assert "ascii" in str(fe.record_columns()["grams"])
