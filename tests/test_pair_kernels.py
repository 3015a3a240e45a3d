"""Features of many pairs at once have the values of the column expressions."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from matchbook.functions import pairwise as pw
from matchbook.functions import similarity as sim
from matchbook.operators import blocking as bl
from matchbook.operators import features as fe
from matchbook.operators import match as mt
from matchbook.operators import pair_kernels as pk
from matchbook.operators import retrieve as rt

ODD = [None, "", "a", "ab", "ba", "oak mill", "mill oak", "oak  mill oak", "éa", "aé", "🦊fox", "fox🦊", "martha", "marhta", "x" * 64, "x" * 63 + "y",
       "x" * 65, "yx" * 100, "xy" * 100, " a\tb\n", "12 elm st 90210", "elm st 12"]
EVERY = [*fe.ALL, "name_jaro_winkler"]


def odd_records(spark):
    rng = random.Random(3)
    rows = [(f"S{1 + i % 3}-{i}", rng.choice(ODD), rng.choice(ODD), rng.choice([None, "US", "us ", "India"]),
             rng.choice([None, "", "90210", "123456"]), rng.choice([None, "", "12 Elm St, Oak,, oak", "oak , 12 elm st"])) for i in range(60)]
    rows += [("S1-0", "twice", "12 elm", "US", "", "x"), ("S2-1", "twice too", "", None, None, "y")]  # ids that repeat
    return spark.createDataFrame(rows, "entity_id string, norm_name string, norm_address string, country string, zip_pin string, business_address string")


def blocks_of_all(spark, norm, cap=300):
    keys = norm.select("entity_id", F.lit("t").alias("tag"), F.pmod(F.xxhash64("entity_id"), F.lit(3)).cast("string").alias("key"))
    every = norm.select("entity_id").distinct().crossJoin(spark.range(3)).select("entity_id", F.lit("t").alias("tag"), F.col("id").cast("string").alias("key"))
    return bl.blocks_of(every.where("entity_id like 'S1-%'"), keys.where("entity_id not like 'S1-%'"), cap, F.lit(0))


def test_odd_rows_have_the_features_of_the_expressions(spark):
    norm = odd_records(spark)
    blocks = blocks_of_all(spark, norm)
    pairs = bl.listed_pairs(bl.block_lists(blocks, 300)).select("s1_id", "cand_id")
    got, want = fe.all_features(blocks, norm, EVERY), fe.all_features(pairs, norm, EVERY)
    assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    got, want = (sorted(map(str, df.collect())) for df in (got, want))
    assert got == want and len(got) > 800


def test_a_block_may_be_spread_over_batches(spark):
    norm = odd_records(spark)
    key, blocks = "spark.sql.execution.arrow.maxRecordsPerBatch", blocks_of_all(spark, norm, 25)
    want = sorted(map(str, fe.all_features(blocks, norm).collect()))
    before = spark.conf.get(key)
    spark.conf.set(key, 3)
    try:
        assert sorted(map(str, fe.all_features(blocks, norm).collect())) == want
    finally:
        spark.conf.set(key, before)


def test_no_pair_is_made_before_its_features(spark):
    """One Levenshtein of two strings takes Spark some microseconds; queries of blocks leave it, and all else of a pair, to the kernels."""
    norm = odd_records(spark)
    plan = fe.all_features(blocks_of_all(spark, norm), norm, EVERY)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "levenshtein" not in plan and "array_intersect" not in plan


def test_halves_are_rounded_as_spark_rounds(spark):
    values = [i / 128 for i in range(129)] + [i / 640 for i in range(641)] + [1.0000005, 0.9999995, 2.5e-7, 5e-7, 0.0]
    want = [r.x for r in spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 6).alias("x")).collect()]
    assert pw.round6(pa.array(values).to_numpy()).tolist() == want


def test_random_texts(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcé  🦊"[:rng.choice([2, 4, 7])]) for _ in range(rng.choice([0, 1, 2, 5, 20, 63, 64, 65, 128, 150]))) for _ in range(120)]
    both = [(a, b) for a in range(120) for b in rng.sample(range(120), 20)]
    df = spark.createDataFrame([(i, texts[a], texts[b]) for i, (a, b) in enumerate(both)], "i int, a string, b string")
    want = df.select("i", sim.lev_ratio(F.col("a"), F.col("b")), sim.jaccard(sim.char_grams(F.col("a")), sim.char_grams(F.col("b"))),
                     sim.common_prefix_tokens(F.col("a"), F.col("b")), sim.jaro_winkler(F.col("a"), F.col("b"))).orderBy("i").collect()
    column, a, b = pa.array(texts), *map(lambda x: pa.array(x).to_numpy(), zip(*both, strict=True))
    t, w = pw.Texts(column), pw.Tokens(column)
    got = zip(pw.lev_ratio(t, a, b), pw.jaccard(t.grams, a, b), pw.common_prefix(w, a, b), pw.jaro_winkler(t, a, b), strict=True)
    assert [tuple(r)[1:] for r in want] == [tuple(x.item() for x in r) for r in got]


def test_large_tables_are_made_in_parts(monkeypatch):
    column = pa.array([f"w{i} w{i + 1} w{i + 2}" for i in range(50)] * 2)
    a, b = (pa.array([f(i) for i in range(100) for _ in range(20)]).to_numpy() for f in (lambda i: i, lambda i: (i * 7) % 100))
    results = []
    for table in (1 << 22, 7):
        monkeypatch.setattr(pw, "TABLE", table)
        w, t = pw.Tokens(column), pw.Texts(column)
        results.append([x.tolist() for x in (pw.jaccard(w.sets, a, b), pw.levenshtein(t, a, b), pw.jaro_winkler(t, a, b))])
    assert results[0] == results[1]


def test_a_null_is_no_value():
    rows = pk.Rows(pa.table({"norm_address": [None, "", "elm st"], "zip_pin": ["", None, "90210"]}))
    a, b = (pa.array(x).to_numpy() for x in ([0, 0, 0, 1, 1, 2], [0, 1, 2, 1, 2, 2]))
    values, valid = pk.FEATURES["both_address"][2](rows, a, b)
    assert [int(v) if k else None for v, k in zip(values, valid, strict=True)] == [None, 0, None, 0, 0, 1]


def test_pairs_know_how_often_the_truth_has_them(spark):
    """Tuning joins no pairs with the truth: each S1 record brings its true matches to its blocks."""
    norm = odd_records(spark)
    blocks = blocks_of_all(spark, norm)
    ids = [r.entity_id for r in norm.select("entity_id").distinct().collect()]
    rng = random.Random(5)
    rows = [(rng.choice(ids), rng.choice(ids)) for _ in range(900)] + [("S1-0", "S2-1")] * 3 + [(None, "S2-1"), ("S1-0", None)]
    truth = spark.createDataFrame(rows, "s1_id string, cand_id string")
    scored = fe.fixed_score(fe.all_features(blocks, norm, fe.SCORE_FEATURES, truth))
    assert scored.agg(F.sum("n_true")).first()[0] > 100
    counted = mt.grid_counts(truth, scored)
    assert sorted(map(str, counted.collect())) == sorted(map(str, mt.grid_counts(truth, scored.drop("n_true")).collect()))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[:plan.index("MapInArrow")]


def test_no_truth_is_no_hit(spark):
    norm = odd_records(spark)
    truth = norm.select(F.col("entity_id").alias("s1_id"), F.col("entity_id").alias("cand_id")).where("false")
    assert fe.all_features(blocks_of_all(spark, norm), norm, ["both_address"], truth).agg(F.sum("n_true")).first()[0] == 0


def test_cosines_of_blocks_equal_those_of_pairs_and_the_best_are_kept(spark):
    norm = odd_records(spark)
    blocks = blocks_of_all(spark, norm)
    pairs = bl.listed_pairs(bl.block_lists(blocks, 300)).select("s1_id", "cand_id")
    weights = rt.name_gram_weights(norm)
    want = rt.pair_tfidf_cosine(pairs, weights, norm).cache()
    rows = lambda df: sorted((r.s1_id, r.cand_id, round(r.tfidf_cosine, 5)) for r in df.collect())
    assert rows(rt.pair_tfidf_cosine(blocks, weights, norm)) == rows(want)
    few = rt.pair_tfidf_cosine(blocks, weights, norm, 2)
    assert few.count() < want.count() and rows(rt.rerank_tfidf(few, 2)) == rows(rt.rerank_tfidf(want, 2))
