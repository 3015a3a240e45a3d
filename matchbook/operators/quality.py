"""Data-quality rules over id-list tables (match / candidate files).

Each rule is a filter or anti-join producing offender rows; the report is
their union with counts and the first five sorted examples per rule.
Rows are ``(s1, list)`` strings exactly as read from the TSV: the list is
split on ',' without trimming, as the reference validator does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.functions.constants import MAX_EXAMPLES
from matchbook.session import written

ERROR, WARNING = "error", "warning"


def _ids(lists: DataFrame, s1_col: str, list_col: str) -> DataFrame:
    """Long ``(s1, id)``; blank lists give no rows."""
    nonblank = lists.where(F.trim(F.coalesce(F.col(list_col), F.lit(""))) != "")
    return nonblank.select(F.col(s1_col).alias("s1"), F.explode(F.split(list_col, ",")).alias("id"))


def offenders(lists: DataFrame, s1_col: str, list_col: str, required: DataFrame,
              valid_ids: DataFrame | None = None) -> DataFrame:
    """All offenders as ``(rule, severity, offender)``.

    Several rules read the lists, so they are written first; the rules on ids read each distinct id once.
    """
    lists = written(lists.select(s1_col, list_col), "id-lists")
    ids = _ids(lists, s1_col, list_col).select("id").distinct()
    s1 = F.col(s1_col)
    dup = (lists.groupBy(s1.alias("offender")).agg(F.count(F.lit(1)).alias("c"))
           .where(F.col("c") > 1).select(F.lit("duplicate_s1").alias("rule"), "offender"))
    lst = F.split(F.col(list_col), ",")
    rep = (lists.where((F.trim(F.coalesce(F.col(list_col), F.lit(""))) != "")
                       & (F.size(lst) != F.size(F.array_distinct(lst))))
           .select(F.lit("repeated_ids").alias("rule"), s1.alias("offender")))
    is_target = F.col("id").startswith("S2-") | F.col("id").startswith("S3-")
    rule = F.when(F.col("id").startswith("S1-"), F.lit("self_match")).when(~is_target, F.lit("wrong_prefix"))
    if valid_ids is not None:
        v = valid_ids.select(F.col(valid_ids.columns[0]).alias("id")).distinct().withColumn("known", F.lit(True))
        ids = ids.join(v, "id", "left")
        rule = rule.when(F.col("known").isNull(), F.lit("unknown_ids"))
    by_id = ids.select(rule.alias("rule"), F.col("id").alias("offender")).where("rule IS NOT NULL")
    seen = lists.select(s1.alias("offender")).distinct()
    req = required.select(F.col(required.columns[0]).alias("offender"))
    missing = req.join(seen, "offender", "left_anti").select(F.lit("missing_s1").alias("rule"), "offender")
    extra = seen.join(req, "offender", "left_anti").select(F.lit("extra_s1").alias("rule"), "offender")
    parts = [dup, rep, by_id, missing, extra]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().withColumn("severity", F.lit(ERROR))


def not_in_candidates(matches: DataFrame, m_s1: str, m_list: str,
                      cands: DataFrame, c_s1: str, c_list: str) -> DataFrame:
    """S1s whose matched ids are not all among its candidates (V10, warning)."""
    m = _ids(matches, m_s1, m_list).distinct()
    c = _ids(cands, c_s1, c_list).distinct()
    bad = m.join(c, ["s1", "id"], "left_anti").select(F.col("s1").alias("offender")).distinct()
    return bad.select(F.lit("not_in_candidates").alias("rule"), "offender", F.lit(WARNING).alias("severity"))


RULES = ["duplicate_s1", "repeated_ids", "self_match", "wrong_prefix", "unknown_ids",
         "missing_s1", "extra_s1", "not_in_candidates"]


def report(offs: DataFrame, file_name: str) -> DataFrame:
    """Per rule: severity, offender count, first five sorted examples.

    The example list is a bounded top-5 per rule (``row_number`` ≤ 5), so no
    rule's offenders are gathered into one task.
    """
    from pyspark.sql import Window
    offs = written(offs, "offenders")
    counts = offs.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n_offenders"))
    w = Window.partitionBy("rule").orderBy("offender")
    ex = (offs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= MAX_EXAMPLES)
          .groupBy("rule").agg(F.array_join(F.sort_array(F.collect_list("offender")), ", ").alias("examples")))
    return (counts.join(ex, "rule", "left")
            .select(F.lit(file_name).alias("file"), "rule", "severity", "n_offenders", "examples"))


def row_counts(lists: DataFrame, list_col: str, file_name: str) -> DataFrame:
    """Rows, empty and non-empty lists."""
    empty = F.trim(F.coalesce(F.col(list_col), F.lit(""))) == ""
    return lists.agg(F.lit(file_name).alias("file"), F.count(F.lit(1)).alias("rows"),
                     F.count_if(empty).alias("empty"), F.count_if(~empty).alias("non_empty"))


def summary(reports: DataFrame) -> DataFrame:
    """PASS iff no error-severity offenders; warnings never fail."""
    return reports.agg(
        F.coalesce(F.sum(F.when(F.col("severity") == ERROR, F.col("n_offenders"))), F.lit(0)).cast("long").alias("errors"),
        F.coalesce(F.sum(F.when(F.col("severity") == WARNING, F.col("n_offenders"))), F.lit(0)).cast("long").alias("warnings"),
    ).withColumn("status", F.when(F.col("errors") == 0, F.lit("PASS")).otherwise(F.lit("FAIL")))
