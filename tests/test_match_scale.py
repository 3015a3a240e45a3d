"""Tuning, training and scoring read their pairs once, whatever the number of folds and passes."""

import math

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from matchbook.operators import features as fe
from matchbook.operators import match as mt
from matchbook.plans import catalog as cat


def test_out_of_fold_reads_the_pairs_twice(spark):
    rows = [(f"S1-{i}", f"S2-{j}", (i * j % 7) / 7) for i in range(12) for j in range(4)]
    read = spark.sparkContext.accumulator(0)
    score = F.udf(lambda x: (read.add(1), x)[1], DoubleType())
    scored = spark.createDataFrame(rows, "s1_id string, cand_id string, score double").withColumn("score", score("score"))
    s1 = spark.createDataFrame([(f"S1-{i}",) for i in range(13)], "entity_id string")
    truth = spark.createDataFrame([(f"S1-{i}", "S2-1") for i in range(12)], "s1_id string, cand_id string")
    got = mt.f05_out_of_fold(s1, truth, scored).first()
    assert got.n_entities == 13 and 0 <= got.f05_macro <= 1
    assert read.value <= 4 * len(rows)  # a filter and a projection may each compute the score


def test_out_of_fold_equals_tuning_each_fold_alone(spark):
    rows = [(f"S1-{i}", f"S2-{j}", (i * j % 7) / 7) for i in range(30) for j in range(5)] + [("S1-1", "S2-1", None)]
    scored = spark.createDataFrame(rows, "s1_id string, cand_id string, score double")
    s1 = spark.createDataFrame([(f"S1-{i}",) for i in range(31)], "entity_id string")
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i % 5}") for i in range(0, 30, 2)], "s1_id string, cand_id string")
    matches = None
    for f in range(5):
        own = lambda c: mt.entity_fold(F.col(c)) == f  # noqa: B023, E731
        tuned = mt.tune_threshold(s1.where(~own("entity_id")), truth.where(~own("s1_id")), scored.where(~own("s1_id")))
        part = mt.threshold_matches(scored.where(own("s1_id")), mt.best_threshold(tuned).head().threshold)
        matches = part if matches is None else matches.unionByName(part)
    want = mt.f05_macro(mt.f05_per_entity(s1, truth, matches)).first()
    assert mt.f05_out_of_fold(s1, truth, scored).first() == want


def test_a_fit_reads_written_rows(spark, monkeypatch):
    """The training rows of ``score_pairs`` and ``f05_out_of_fold`` are no join that every pass of a fit runs again."""
    pairs = spark.createDataFrame([("S1-1", "S2-1", 1.0), ("S1-2", "S2-2", 0.5)], "s1_id string, cand_id string, name_lev_ratio double")
    trained = []
    monkeypatch.setattr(cat, "_pf", lambda *_: pairs)
    monkeypatch.setattr(cat, "truth", lambda *_: pairs.select("s1_id", "cand_id"))
    monkeypatch.setattr(cat, "split_norm", lambda *_: (pairs.select(F.col("s1_id").alias("entity_id")), None))
    monkeypatch.setattr(fe, "fixed_score", lambda p: p.withColumn("score", F.col("name_lev_ratio")))

    def gbt(train, on, **_):
        trained.append(train._jdf.queryExecution().optimizedPlan().toString())
        return on.select("s1_id", "cand_id", F.lit(0.5).alias("probability"))

    monkeypatch.setattr(mt, "gbt_scores", gbt)
    cat._score_pairs(spark, "")
    cat._f05_out_of_fold(spark, "")
    assert len(trained) == 6 and not any("Join" in plan for plan in trained)


def test_grid_points_below_a_score(spark):
    near = [x for g in mt.GRID for x in (g, math.nextafter(g, 2), math.nextafter(g, -2))]
    scores = [*near, None, math.nan, -3.0, 7.0, math.inf, -math.inf]
    grid = F.array(*[F.lit(g) for g in mt.GRID])
    df = spark.createDataFrame([(s,) for s in scores], "score double")
    got = df.select(mt.grid_points_below(F.col("score")).alias("m"), F.size(F.filter(grid, lambda g: F.col("score") > g)).alias("n")).collect()
    assert [r.m for r in got] == [r.n for r in got]
