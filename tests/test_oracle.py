"""Spark query vs DuckDB oracle on sf0.001 for a cross-section of the registry
(the driver runs every query at sf0.01)."""

import pytest

from conftest import SF0001
from harness import compare
from matchbook.plans.catalog import ORACLE, QUERIES

SAMPLE = ["truth_long", "normalized_records", "keys_v1", "keys_v2", "key_stats_v4", "block_v4",
          "block_v4_cap20", "blocking_recall_v2", "candidate_hist_v4", "recall_by_key_v4",
          "match_count_stats", "noisy_pair_sample", "dq_report_candidates", "pair_features_name",
          "tune_threshold"]


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck0001, name):
    problems, _ = compare(QUERIES[name](spark, SF0001), duck0001, ORACLE[name])
    assert not problems, problems
