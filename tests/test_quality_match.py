"""Seeded data-quality violations and F0.5 worked examples."""

from matchbook.operators import match as mt
from matchbook.operators import quality as dq


def test_each_rule_fires_on_seeded_table(spark):
    lists = spark.createDataFrame([
        ("S1-1", "S2-1,S2-1"),          # repeated id
        ("S1-1", ""),                   # duplicate row
        ("S1-2", "S1-9,X-4,S3-404"),    # self match, wrong prefix, unknown id
        ("S1-99", "S2-1"),              # not in required set
    ], "s1 string, ids string")
    required = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string")
    valid = spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")
    offs = dq.offenders(lists, "s1", "ids", required, valid)
    got = {(r.rule, r.offender) for r in offs.collect()}
    assert got == {("duplicate_s1", "S1-1"), ("repeated_ids", "S1-1"), ("self_match", "S1-9"),
                   ("wrong_prefix", "X-4"), ("unknown_ids", "S3-404"), ("missing_s1", "S1-3"),
                   ("extra_s1", "S1-99")}
    rep = dq.report(offs, "matching_results.tsv")
    assert rep.count() == 7
    assert dq.summary(rep).first().status == "FAIL"
    cands = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S3-1")], "s1 string, ids string")
    warn = dq.not_in_candidates(lists, "s1", "ids", cands, "s1", "ids")
    assert {r.offender for r in warn.collect()} == {"S1-2", "S1-99"}
    counts = dq.row_counts(lists, "ids", "f").first()
    assert (counts.rows, counts.empty, counts.non_empty) == (4, 1, 3)


def test_f05_worked_example_and_singletons(spark):
    s1 = spark.createDataFrame([("S1-a",), ("S1-b",), ("S1-c",), ("S1-d",)], "entity_id string")
    truth = spark.createDataFrame([("S1-a", "S2-00047"), ("S1-a", "S3-00812"), ("S1-d", "S2-1")],
                                  "s1_id string, cand_id string")
    pred = spark.createDataFrame([("S1-a", "S2-00047"), ("S1-a", "S2-00193"), ("S1-a", "S3-00812"),
                                  ("S1-c", "S2-5")], "s1_id string, cand_id string")
    per = {r.s1_id: r.f05 for r in mt.f05_per_entity(s1, truth, pred).collect()}
    assert per == {"S1-a": 0.714286, "S1-b": 1.0, "S1-c": 0.0, "S1-d": 0.0}


def test_tune_threshold_with_zero_and_null_scores(spark):
    s1 = spark.createDataFrame([("S1-a",)], "entity_id string")
    truth = spark.createDataFrame([("S1-a", "S2-1")], "s1_id string, cand_id string")
    scored = spark.createDataFrame([("S1-a", "S2-1", 0.9), ("S1-a", "S2-2", 0.0), ("S1-a", "S2-3", None)],
                                   "s1_id string, cand_id string, score double")
    got = {r.threshold: r.f05_macro for r in mt.tune_threshold(s1, truth, scored).collect()}
    assert got[0.0] == 1.0 and got[0.85] == 1.0 and got[0.95] == 0.0
