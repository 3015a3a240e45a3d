"""Files by line, seeded faults of every validator rule, JSON reports."""

import pytest

from conftest import SF0001
from harness import compare
from matchbook.plans.catalog import ORACLE, QUERIES
from matchbook.sources import lines as ln
from matchbook.sources import reports


@pytest.mark.parametrize("name", ["dq_offenders_file", "dq_summary_file", "dq_row_counts_file", "tsv_round_trip", "report_json"])
def test_query_matches_oracle(spark, duck0001, name):
    problems, n = compare(QUERIES[name](spark, SF0001), duck0001, ORACLE[name])
    assert not problems and n


def test_every_rule_fires(spark):
    got = {r.rule: r.n_offenders for r in QUERIES["dq_report_file"](spark, SF0001).collect()}
    assert set(got) == {"duplicate_s1", "repeated_ids", "self_match", "wrong_prefix", "missing_s1", "extra_s1", "unknown_ids",
                        "not_in_candidates", "malformed_row", "invalid_utf8", "comma_separated"} and all(got.values())


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 3), ("c", 0)):
        (tmp_path / name).write_text("".join(f"{i}\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = ln.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 5003 and all(str(r.line) == r.value for r in rows)


def test_headers_and_raw_bytes(spark, tmp_path):
    head = b"Source1_Entity_ID\t matched_entity_ids \n"
    files = {"good": head + b"S1-1\tS2-1,S3-2\n\n  \nS1-2\t\nS1-3\nS1-4\t\xff\nS1-5\ta\tb\n", "comma": b"a,b\nS1-6\tS2-1\n",
             "names": b"s1\tids\nS1-7\tS2-1\n", "empty": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows, errors = ln.read_id_lists(spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == [("S1-1", "S2-1,S3-2"), ("S1-2", ""), ("S1-5", "a\tb")]
    got = sorted((r.file.rsplit("/")[-1], r.line, r.rule, r.offender) for r in errors.collect())
    assert got == [("comma", 1, "comma_separated", "a,b"), ("good", 6, "malformed_row", "S1-3"),
                   ("good", 7, "invalid_utf8", "S1-4"), ("names", 1, "wrong_header", "s1\tids")]


def test_report_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "report")
    one = spark.createDataFrame([(1, "x"), (2, None)], "n int, s string")
    for frames in ({"old": one}, {"a \"b\"": one, "none": one.where("false"), "two": one.select("n")}):
        reports.write_report(frames, path)
    assert reports.read_report(spark, path) == {'a "b"': [{"n": 1, "s": "x"}, {"n": 2}], "two": [{"n": 1}, {"n": 2}]}
