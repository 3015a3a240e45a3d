"""Jaro-Winkler against a plain Python version, phonetic keys against DuckDB, out-of-fold scores."""

import random

from conftest import SF0001
from harness import compare
from pyspark.sql import functions as F

from matchbook.functions import similarity as sim
from matchbook.operators import match as mt
from matchbook.plans.catalog import ORACLE, QUERIES


def _jaro(s1: str, s2: str) -> float:
    n1, n2 = len(s1), len(s2)
    if n1 == 0 or n2 == 0:
        return 0.0
    window = max(max(n1, n2) // 2 - 1, 0)
    m1, m2 = [False] * n1, [False] * n2
    matches = 0
    for i, ch in enumerate(s1):
        lo, hi = max(0, i - window), min(n2, i + window + 1)
        for j in range(lo, hi):
            if not m2[j] and s2[j] == ch:
                m1[i] = m2[j] = True
                matches += 1
                break
    if matches == 0:
        return 0.0
    t, k = 0, 0
    for i in range(n1):
        if m1[i]:
            while not m2[k]:
                k += 1
            if s1[i] != s2[k]:
                t += 1
            k += 1
    # half-transpositions are halved with integer division
    return (matches / n1 + matches / n2 + (matches - t // 2) / matches) / 3.0


def jaro_winkler_py(s1: str, s2: str, p: float = 0.1, boost_above: float = 0.7) -> float:
    j = _jaro(s1, s2)
    if j <= boost_above:
        return j
    ell = 0
    for a, b in zip(s1[:4], s2[:4]):
        if a != b:
            break
        ell += 1
    return j + ell * p * (1 - j)


def test_jaro_winkler_like_the_plain_version(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 12)))
    pairs = [(word(), word()) for _ in range(800)] + [("martha", "marhta"), ("dixon", "dicksonx"), ("", "a"), ("", ""), (None, "x"), ("aé", "éa")]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("jw", sim.jaro_winkler(F.col("a"), F.col("b")))
    for r in df.collect():
        assert abs(r.jw - jaro_winkler_py(r.a or "", r.b or "")) < 1e-6, r
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_queries_match_oracle(spark, duck0001):
    for name in ("pair_jaro_winkler", "keys_phonetic", "pair_features_name"):
        problems, n = compare(QUERIES[name](spark, SF0001), duck0001, ORACLE[name])
        assert not problems and n, name


def test_every_pair_is_scored_by_models_that_did_not_see_its_entity(spark, monkeypatch):
    seen = []

    def fake(train, score_on, **_):
        seen.append(({r.s1_id for r in train.select("s1_id").distinct().collect()}, {r.s1_id for r in score_on.select("s1_id").distinct().collect()}))
        return score_on.select("s1_id", "cand_id", F.lit(0.75).alias("probability"))

    monkeypatch.setattr(mt, "gbt_scores", fake)
    pairs = spark.createDataFrame([(f"S1-{i}", f"S2-{j}", 1) for i in range(40) for j in range(2)], "s1_id string, cand_id string, label int")
    out = mt.out_of_fold_scores(pairs, pairs, k=4)
    assert out.count() == 80 and len(seen) == 4 and all(not a & b and a | b == {f"S1-{i}" for i in range(40)} for a, b in seen)
    s1 = spark.createDataFrame([(f"S1-{i}",) for i in range(40)], "entity_id string")
    truth = pairs.where("cand_id = 'S2-0'").select("s1_id", "cand_id")
    scored = pairs.select("s1_id", "cand_id", F.when(F.col("cand_id") == "S2-0", 0.9).otherwise(0.2).alias("score"))
    assert mt.f05_out_of_fold(s1, truth, scored, k=4).first().f05_macro == 1.0
