"""Registered queries on files that break every rule of the validator (V01-V12, S05, S06), with DuckDB SQL.

The match file is derived from the ground truth: by the entity's number, rows
are repeated, left out or added, lists get ids that do not belong there, lines
lose their tab or hold bytes that are no UTF-8, and one of four files has a
comma-separated header. It is written as text, read back by line and checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.operators import profile as pf
from matchbook.operators import quality as dq
from matchbook.plans import oracle as O
from matchbook.plans.catalog import register
from matchbook.session import scratch_path, written
from matchbook.sources import lines as ln
from matchbook.sources import records as rs
from matchbook.sources import reports

FILES = 4
GOOD, BAD = "source1_entity_id\tmatched_entity_ids", "source1_entity_id,matched_entity_ids"

# Portable (Spark SQL and DuckDB): (num, kind, s1, ids); kind tells how the line is written
SEEDED_SQL = """
WITH n AS (SELECT CAST(substr(source1_entity_id, 4) AS BIGINT) AS num, source1_entity_id AS s1, coalesce(matched_entity_ids, '') AS ids
           FROM {wide}),
c AS (SELECT num, s1, num % 50 AS k, CASE num % 50
        WHEN 2 THEN concat(ids, ',', split_part(ids, ',', 1)) WHEN 3 THEN concat(ids, ',', s1)
        WHEN 4 THEN concat(ids, ',X-', CAST(num AS STRING)) WHEN 5 THEN concat(ids, ',S2-0', CAST(num AS STRING))
        WHEN 9 THEN concat(ids, ',S3-1') ELSE ids END AS ids FROM n)
SELECT num, CASE k WHEN 8 THEN 'no tab' WHEN 10 THEN 'bytes' ELSE 'row' END AS kind, s1, ids FROM c WHERE k <> 6
UNION ALL SELECT num, 'row', s1, ids FROM c WHERE k = 1
UNION ALL SELECT num, 'row', concat('S1-E', CAST(num AS STRING)), ids FROM c WHERE k = 7
"""


def seeded_file(spark: SparkSession, sf: str) -> str:
    """Write the faulty match file in ``FILES`` files, each with its header first; its path."""
    rows = spark.sql(SEEDED_SQL, wide=rs.truth_wide(rs.records(spark, sf)))
    line = (F.when(F.col("kind") == "no tab", F.col("s1"))
            .when(F.col("kind") == "bytes", F.concat("s1", F.lit("\t"), F.unhex(F.lit("FFFE")).cast("string")))
            .otherwise(F.concat("s1", F.lit("\t"), "ids")))
    body = rows.select((F.col("num") % FILES).alias("file"), F.lit(1).alias("place"), line.alias("value"))
    heads = spark.range(FILES).select(F.col("id").alias("file"), F.lit(0).alias("place"),
                                      F.when(F.col("id") == FILES - 1, F.lit(BAD)).otherwise(F.lit(GOOD)).alias("value"))
    path = scratch_path(spark, "faulty-matches")
    both = body.unionByName(heads).repartition(FILES, "file").sortWithinPartitions("file", "place", "value")
    both.select("file", "value").write.partitionBy("file").text(path)
    return path


def _read(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return ln.read_id_lists(spark, seeded_file(spark, sf))


def _offenders(spark: SparkSession, sf: str) -> DataFrame:
    """All offenders of rows and lines (rule, offender, severity); warnings for ids that are no candidates."""
    rows, errors = _read(spark, sf)
    recs = rs.records(spark, sf)
    # written: else what holds for right ids (a digit at place two) is inferred for, and fails on, faulty lines
    required, valid = (written(x.select("entity_id"), "ids") for x in (rs.source1(recs), rs.targets(recs)))
    found = dq.offenders(rows, "s1", "ids", required, valid)
    wide = written(rs.truth_wide(recs), "truth")
    warned = dq.not_in_candidates(rows, "s1", "ids", wide, "source1_entity_id", "matched_entity_ids")
    return found.select("rule", "offender", "severity").unionByName(warned.select("rule", "offender", "severity")) \
        .unionByName(errors.select("rule", "offender", "severity").distinct())


_WIDE = f"""WITH records AS ({O.records_cte()}), {O.truth_cte()},
wide AS (SELECT r.entity_id AS source1_entity_id, l.matched_entity_ids
         FROM records r LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY cand_id) AS matched_entity_ids
                                   FROM truth GROUP BY s1_id) l ON r.entity_id = l.s1_id WHERE r.src = 1),
seeded AS ({SEEDED_SQL.format(wide='wide')}),
readable AS (SELECT * FROM seeded WHERE num % {FILES} <> {FILES - 1}),
cf AS (SELECT s1, ids AS lst FROM readable WHERE kind = 'row')"""
_RULES = f"""{_WIDE},
ids AS (SELECT DISTINCT s1, x AS id FROM cf, unnest(string_split(lst, ',')) AS u(x) WHERE trim(lst) <> ''),
s1 AS (SELECT entity_id FROM records WHERE src = 1),
known AS (SELECT DISTINCT source1_entity_id AS s1, x AS id FROM wide, unnest(string_split(coalesce(matched_entity_ids, ''), ',')) AS u(x)),
offs AS (
  SELECT 'duplicate_s1' AS rule, s1 AS offender, 'error' AS severity FROM cf GROUP BY s1 HAVING count(*) > 1
  UNION SELECT 'repeated_ids', s1, 'error' FROM cf
    WHERE trim(lst) <> '' AND len(string_split(lst, ',')) <> len(list_distinct(string_split(lst, ',')))
  UNION SELECT 'self_match', id, 'error' FROM ids WHERE starts_with(id, 'S1-')
  UNION SELECT 'wrong_prefix', id, 'error' FROM ids WHERE NOT regexp_matches(id, '^S[123]-')
  UNION SELECT 'missing_s1', entity_id, 'error' FROM s1 WHERE entity_id NOT IN (SELECT s1 FROM cf)
  UNION SELECT 'extra_s1', s1, 'error' FROM cf WHERE s1 NOT IN (SELECT entity_id FROM s1)
  UNION SELECT 'unknown_ids', id, 'error' FROM ids WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT entity_id FROM records WHERE src <> 1)
  UNION SELECT 'not_in_candidates', i.s1, 'warning' FROM ids i ANTI JOIN known k ON i.s1 = k.s1 AND i.id = k.id
  UNION SELECT 'malformed_row', s1, 'error' FROM readable WHERE kind = 'no tab'
  UNION SELECT 'invalid_utf8', s1, 'error' FROM seeded WHERE kind = 'bytes'
  UNION SELECT 'malformed_row', s1, 'error' FROM seeded WHERE kind = 'no tab'
  UNION SELECT 'comma_separated', '{BAD}', 'error')"""

register("dq_offenders_file", f"{_RULES} SELECT rule, offender, severity FROM offs")(_offenders)
register("dq_not_in_candidates", f"{_RULES} SELECT rule, offender, severity FROM offs WHERE rule = 'not_in_candidates'")(
    lambda spark, sf: _offenders(spark, sf).where("rule = 'not_in_candidates'"))
register("dq_report_file", f"""{_RULES}
SELECT 'matching_results.tsv' AS file, rule, severity, count(*) AS n_offenders,
       array_to_string(list_sort(list(offender ORDER BY offender)[1:5]), ', ') AS examples FROM offs GROUP BY rule, severity""")(
    lambda spark, sf: dq.report(_offenders(spark, sf), "matching_results.tsv"))
register("dq_summary_file", f"""{_RULES}
SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings,
       CASE WHEN count(*) FILTER (WHERE severity = 'error') = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM offs""")(
    lambda spark, sf: dq.summary(dq.report(_offenders(spark, sf), "matching_results.tsv")))
register("dq_row_counts_file", f"""{_WIDE}
SELECT 'matching_results.tsv' AS file, count(*) AS rows, count(*) FILTER (WHERE lst = '') AS empty,
       count(*) FILTER (WHERE lst <> '') AS non_empty FROM cf""")(
    lambda spark, sf: dq.row_counts(_read(spark, sf)[0], "ids", "matching_results.tsv"))


def _round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The truth written as an id-list file and read back by line."""
    path = scratch_path(spark, "truth-tsv")
    rs.write_id_lists(rs.truth_wide(rs.records(spark, sf)), path, "source1_entity_id", "matched_entity_ids")
    return ln.read_id_lists(spark, path)[0]


register("tsv_round_trip", f"{_WIDE} SELECT source1_entity_id AS s1, coalesce(matched_entity_ids, '') AS ids FROM wide")(_round_trip)


def _report(spark: SparkSession, sf: str) -> DataFrame:
    """Profile metrics written as one JSON document and read back."""
    recs = rs.records(spark, sf)
    path = scratch_path(spark, "profile-json")
    reports.write_report({"shapes": pf.shapes(recs, rs.truth_wide(recs)), "encoding_issues": pf.encoding_issues(recs)}, path)
    shapes = F.from_json("value", "shapes array<struct<source:string,rows:bigint,n_cols:int>>").getField("shapes")
    return spark.read.text(path, wholetext=True).select(F.explode(shapes).alias("x")).select("x.*")


register("report_json", f"""{_WIDE}
SELECT 'S' || CAST(src AS VARCHAR) AS source, count(*) AS rows, 4 AS n_cols FROM records GROUP BY src
UNION ALL SELECT 'truth', count(*), 2 FROM wide""")(_report)
