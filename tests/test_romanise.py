"""Romanisation against spellings written out here, and the signature of stages."""

import shutil
from pathlib import Path

from conftest import ROOT, SF0001
from harness import compare
from pyspark.sql import functions as F

from matchbook.functions import text as tx
from matchbook.functions.romanise import romanise, unmapped_letters
from matchbook.plans.catalog import ORACLE, QUERIES
from matchbook.plans.stages import rules_digest

SPELLED = {"Москва": "Moskva", "Юрий ЩУКА": "Yurii ShchUKA", "Αθήνα Ψυχή": "Athena Psukhe", "दिल्ली कमल": "dillii kamala",
           "तमिऴ ०१": "tamillla 01", "এক": "eka", "ＡＢｃ１": "ABc1", "ıstanbul Łódź ħ": "istanbul Lodz h",
           "plain": "plain", "": "", "é": "e", "東京 Ltd": " Ltd"}


def test_spellings(spark):
    df = spark.createDataFrame([(x,) for x in SPELLED], "x string")
    assert {r.x: r.y for r in df.select("x", tx.ascii_fold(F.col("x")).alias("y")).collect()} == SPELLED
    assert df.where("x like '東%'").select(unmapped_letters(romanise(F.col("x"))).alias("n")).first().n == 2
    assert spark.range(1).select(tx.ascii_fold(F.lit(None).cast("string")).alias("y")).first().y is None


def test_query_matches_oracle(spark, duck0001):
    for name in ("romanised_names", "ascii_fold"):
        problems, n = compare(QUERIES[name](spark, SF0001), duck0001, ORACLE[name])
        assert not problems and n


def test_names_in_other_scripts_have_keys(spark):
    df = spark.createDataFrame([("नई दिल्ली मिठाई",), ("Рога и Копыта",)], "x string")
    assert all(len(r.y.split()) >= 2 for r in df.select(tx.normalize_name(F.col("x")).alias("y")).collect())


def test_a_changed_rule_makes_another_stage(tmp_path):
    copy = tmp_path / "matchbook"
    shutil.copytree(Path(ROOT, "matchbook"), copy, ignore=shutil.ignore_patterns("__pycache__"))
    before = rules_digest(copy)
    assert before == rules_digest()
    with open(copy / "functions" / "constants.py", "a") as f:
        f.write("\n# another rule\n")
    assert rules_digest(copy) != before
