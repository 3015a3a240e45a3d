"""Blocking evaluation: recall against truth, candidate statistics, misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.functions.constants import RECALL_NOTE_BELOW, RECALL_WARNING_BELOW
from matchbook.operators.blocking import lists_by_s1
from matchbook.session import written


def recall_status(recall):
    """Recall band."""
    return (F.when(recall < RECALL_WARNING_BELOW, F.lit("WARNING"))
            .when(recall < RECALL_NOTE_BELOW, F.lit("NOTE")).otherwise(F.lit("OK")))


def flagged(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every truth pair with ``hit`` and the ``n_cands`` of its S1: pairs meet as one list of candidates per S1."""
    known = truth.select("s1_id", "cand_id").join(lists_by_s1(pairs), "s1_id", "left")
    return known.select("s1_id", "cand_id", F.coalesce(F.array_contains("cand_ids", F.col("cand_id")), F.lit(False)).alias("hit"),
                        F.coalesce(F.size("cand_ids"), F.lit(0)).cast("long").alias("n_cands"))


def per_entity(flags: DataFrame) -> DataFrame:
    return flags.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"), F.count_if("hit").alias("n_found"),
                                      F.max("n_cands").alias("n_cands"))


def per_entity_recall(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per S1 with truth: ``n_true, n_found, n_cands``."""
    return per_entity(flagged(truth, pairs))


def blocking_recall(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """Micro recall over entities with truth, misses, status."""
    per = per_entity_recall(truth, pairs)
    missed = F.col("n_true") - F.col("n_found")
    agg = per.agg(
        F.coalesce(F.sum("n_true"), F.lit(0)).cast("long").alias("total_true_matches"),
        F.coalesce(F.sum("n_found"), F.lit(0)).cast("long").alias("found_in_candidates"),
        F.count_if(missed > 0).alias("n_entities_with_miss"),
        F.count_if((missed > 0) & (F.col("n_cands") == 0)).alias("zero_cand_misses"))
    rec = F.when(F.col("total_true_matches") > 0,
                 F.round(F.col("found_in_candidates") / F.col("total_true_matches"), 6)
                 ).otherwise(F.lit(0.0))
    return (agg.withColumn("missed", F.col("total_true_matches") - F.col("found_in_candidates"))
            .withColumn("blocking_recall", rec)
            .withColumn("status", recall_status(F.col("blocking_recall"))))


def found_pairs(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """truth ∩ candidates."""
    return flagged(truth, pairs).where("hit").select("s1_id", "cand_id")


def missed_pairs(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """truth − candidates."""
    return flagged(truth, pairs).where(~F.col("hit")).select("s1_id", "cand_id")


def recall_miss_sample(truth: DataFrame, pairs: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` entities (by id) with a miss, with up to 3 missed ids."""
    flags = written(flagged(truth, pairs), "recall-flags")
    per = per_entity(flags).where(F.col("n_true") > F.col("n_found"))
    first = per.orderBy("s1_id").limit(n)
    miss = (flags.where(~F.col("hit")).select("s1_id", "cand_id").join(first.select("s1_id"), "s1_id", "left_semi")
            .withColumn("_r", F.row_number().over(Window.partitionBy("s1_id").orderBy("cand_id")))
            .where(F.col("_r") <= 3)
            .groupBy("s1_id")
            .agg(F.array_join(F.sort_array(F.collect_list("cand_id")), ",").alias("missed")))
    return (first.join(miss, "s1_id", "left")
            .select("s1_id", "n_true", "n_found",
                    (F.col("n_true") - F.col("n_found")).alias("n_missed"), "n_cands", "missed"))


def candidate_counts(s1: DataFrame, pairs_with_overflow: DataFrame, cap: int) -> DataFrame:
    """Per S1: kept candidates (≤ cap) and whether the cap bound."""
    if "ranks" in pairs_with_overflow.columns:  # lists of pairs
        within = F.sum(F.size(F.filter("ranks", lambda r: r <= cap)))
        over = F.max(F.array_max("ranks") > cap)
    else:
        within, over = F.count_if(F.col("rank") <= cap), F.max(F.col("rank") > cap)
    per = pairs_with_overflow.groupBy("s1_id").agg(within.alias("n"), over.alias("capped"))
    return (s1.select(F.col("entity_id").alias("s1_id")).join(per, "s1_id", "left")
            .select("s1_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                    F.coalesce("capped", F.lit(False)).alias("capped")))


def candidate_stats(counts: DataFrame) -> DataFrame:
    """Entities, pairs, avg per entity (2 dp), zero-candidate, capped."""
    return counts.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_pairs"),
        F.coalesce(F.round(F.avg("n"), 2), F.lit(0.0)).alias("avg_candidates"),
        F.count_if(F.col("n") == 0).alias("zero_candidates"),
        F.count_if("capped").alias("capped_entities"))


HIST_BUCKETS = [("0", 0, 0), ("1-10", 1, 10), ("11-50", 11, 50), ("51-100", 51, 100),
                ("101-200", 101, 200), ("201-300", 201, 300)]


def candidate_hist(counts: DataFrame) -> DataFrame:
    """Size histogram incl. an over-cap bucket; empty buckets kept (A10)."""
    b = F.lit("300+")
    for name, lo, hi in reversed(HIST_BUCKETS):
        b = F.when(F.col("n").between(lo, hi), F.lit(name)).otherwise(b)
    got = counts.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n_entities"))
    spark = counts.sparkSession
    names = [(i, n) for i, (n, _, _) in enumerate(HIST_BUCKETS)] + [(len(HIST_BUCKETS), "300+")]
    all_b = spark.createDataFrame(names, "bucket_order int, bucket string")
    return (all_b.join(got, "bucket", "left")
            .select("bucket_order", "bucket",
                    F.coalesce("n_entities", F.lit(0)).cast("long").alias("n_entities")))


def reduction_ratio(targets: DataFrame, counts: DataFrame) -> DataFrame:
    """1 − pairs / (|S1| × |targets|) (A14), both counts from one aggregate pass."""
    both = (counts.select(F.col("n"), F.lit(1).alias("is_s1"))
            .unionByName(targets.select(F.lit(0).cast("long").alias("n"), F.lit(0).alias("is_s1"))))
    agg = both.agg(F.count_if(F.col("is_s1") == 1).alias("n_s1"),
                   F.count_if(F.col("is_s1") == 0).alias("n_targets"),
                   F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("pairs"))
    return agg.withColumn("reduction_ratio", F.round(
        1 - F.col("pairs") / (F.col("n_s1") * F.col("n_targets")), 9))


def recall_by_key(truth_shared: DataFrame, truth: DataFrame) -> DataFrame:
    """Per key type: truth pairs sharing it, its recall alone, and pairs only it finds.

    Works on truth pairs only (linear), never on whole blocks. The final
    division runs on a frame of at most one row per key type plus a total.
    """
    tags = truth_shared.groupBy("s1_id", "cand_id").agg(
        F.collect_set("tag").alias("tags"))  # at most one entry per key type
    flagged = truth.select("s1_id", "cand_id").join(tags, ["s1_id", "cand_id"], "left")
    rows = flagged.select(
        F.explode(F.array_union(F.coalesce("tags", F.array().cast("array<string>")),
                                F.array(F.lit("__total__")))).alias("tag"),
        (F.size(F.coalesce("tags", F.array())) == 1).alias("only"))
    per = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("pairs_sharing"),
                                  F.count_if("only").alias("only_this_key"))
    total = F.max(F.when(F.col("tag") == "__total__", F.col("pairs_sharing"))).over(Window.partitionBy())
    return (per.withColumn("_total", total).where(F.col("tag") != "__total__")
            .select("tag", "pairs_sharing", "only_this_key",
                    F.round(F.col("pairs_sharing") / F.col("_total"), 6).alias("recall_alone")))
