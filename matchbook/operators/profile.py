"""Source profiling (reference phase 1): shapes, nulls, top values, encoding
issues, truth match-count distribution, address coverage, sample pairs.

All metrics for all sources come from one grouped pass per table rather than
one pass per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.functions import text as tx

RECORD_COLS = ["entity_id", "business_name", "business_address", "country"]
TRUTH_COLS = ["source1_entity_id", "matched_entity_ids"]


def _labelled(recs: DataFrame) -> DataFrame:
    return recs.withColumn("source", F.concat(F.lit("S"), F.col("src").cast("string")))


def shapes(recs: DataFrame, truth_wide: DataFrame) -> DataFrame:
    """Rows and column count per source."""
    r = _labelled(recs).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    r = r.withColumn("n_cols", F.lit(len(RECORD_COLS)))
    t = truth_wide.agg(F.lit("truth").alias("source"), F.count(F.lit(1)).alias("rows"),
                       F.lit(len(TRUTH_COLS)).alias("n_cols"))
    return r.unionByName(t)


def null_rates(recs: DataFrame, truth_wide: DataFrame) -> DataFrame:
    """Percent null per column and source, 2 dp."""
    def per(df: DataFrame, cols: list[str], label: Column) -> DataFrame:
        agg = (df.groupBy(label.alias("source"))
               .agg(F.count(F.lit(1)).alias("_n"),
                    *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]))
        long = agg.unpivot(["source", "_n"], cols, "column_name", "nulls")
        return long.select("source", "column_name",
                           F.round(F.col("nulls") * 100.0 / F.col("_n"), 2).alias("null_pct"))
    r = per(recs, RECORD_COLS, F.concat(F.lit("S"), F.col("src").cast("string")))
    return r.unionByName(per(truth_wide, TRUTH_COLS, F.lit("truth")))


def top_values(recs: DataFrame, col: str = "country", n: int = 10) -> DataFrame:
    """Top ``n`` non-null values per source by count, ties by value."""
    counts = (_labelled(recs).where(F.col(col).isNotNull())
              .groupBy("source", F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "value")
    return (counts.withColumn("rank", F.row_number().over(w).cast("long"))
            .where(F.col("rank") <= n))


def encoding_issues(recs: DataFrame) -> DataFrame:
    """Rows containing a literal '???' per source and column."""
    agg = (_labelled(recs).groupBy("source")
           .agg(F.count_if(F.col("business_name").contains("???")).alias("business_name"),
                F.count_if(F.col("business_address").contains("???")).alias("business_address")))
    return agg.unpivot(["source"], ["business_name", "business_address"], "column_name", "n_rows")


def match_counts(truth_wide: DataFrame) -> DataFrame:
    return truth_wide.select("source1_entity_id",
                             tx.count_ids(F.col("matched_entity_ids")).cast("long").alias("match_count"))


def match_count_hist(truth_wide: DataFrame) -> DataFrame:
    """Distribution of matches per S1, singletons (0) included."""
    return match_counts(truth_wide).groupBy("match_count").agg(F.count(F.lit(1)).alias("n_entities"))


def match_count_stats(truth_wide: DataFrame) -> DataFrame:
    """Total, singletons, mean, median, min, max, p25/p75/p95.

    Quantiles use the nearest rank ``floor(q*(n-1)+0.5)`` (0-based) and the
    median averages the two middle values for even n. Both are read off the
    cumulative histogram (a handful of distinct counts), not a global sort.
    """
    h = match_count_hist(truth_wide)
    w = Window.orderBy("match_count").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # tiny frame: one row per distinct match count
    cum = h.withColumn("cum", F.sum("n_entities").over(w)).withColumn("lo", F.col("cum") - F.col("n_entities"))

    def at_index(idx: Column) -> Column:
        return F.min(F.when((F.col("lo") <= idx) & (idx < F.col("cum")), F.col("match_count")))

    total = F.sum("n_entities").over(Window.partitionBy())
    cum = cum.withColumn("_n", total)
    n = F.col("_n")
    idx = lambda q: F.floor(F.lit(q) * (n - 1) + 0.5)
    mid_lo, mid_hi = F.floor((n - 1) / 2), F.floor(n / 2)
    return cum.agg(
        F.max("_n").alias("total_s1_entities"),
        F.sum(F.when(F.col("match_count") == 0, F.col("n_entities")).otherwise(0)).alias("singletons_count"),
        F.round(F.sum(F.when(F.col("match_count") == 0, F.col("n_entities")).otherwise(0)) * 100.0
                / F.max("_n"), 2).alias("singletons_pct"),
        F.round(F.sum(F.col("match_count") * F.col("n_entities")) / F.max("_n"), 3).alias("mean_matches"),
        ((at_index(mid_lo) + at_index(mid_hi)) / 2.0).alias("median_matches"),
        F.min("match_count").alias("min_matches"),
        F.max("match_count").alias("max_matches"),
        at_index(idx(0.25)).cast("double").alias("p25"),
        at_index(idx(0.75)).cast("double").alias("p75"),
        at_index(idx(0.95)).cast("double").alias("p95"),
    )


def address_coverage(recs: DataFrame) -> DataFrame:
    """Per source: records, with address, null %, with ZIP/PIN in raw text, coverage %."""
    a = F.col("business_address")
    agg = (_labelled(recs).groupBy("source")
           .agg(F.count(F.lit(1)).alias("total_records"),
                F.count(a).alias("records_with_address"),
                F.count_if(a.isNotNull() & tx.has_zip_or_pin(a)).alias("records_with_zip_or_pin")))
    return (agg.withColumn("address_null_pct", F.round(
                (F.col("total_records") - F.col("records_with_address")) * 100.0 / F.col("total_records"), 2))
            .withColumn("zip_coverage_pct", F.when(
                F.col("records_with_address") > 0,
                F.round(F.col("records_with_zip_or_pin") * 100.0 / F.col("records_with_address"), 2))
                .otherwise(F.lit(0.0))))


def noisy_pair_sample(recs: DataFrame, truth_wide: DataFrame, n: int = 10) -> DataFrame:
    """First matched truth rows (by S1 id), first two ids of each, looked up in
    S1 and S2/S3, until at least ``n`` examples (J05). Bounded by 3n rows."""
    first = (truth_wide.where(F.col("matched_entity_ids").isNotNull() & (F.col("matched_entity_ids") != ""))
             .orderBy("source1_entity_id").limit(3 * n))
    ids = first.select(F.col("source1_entity_id").alias("s1_id"),
                       F.posexplode(F.slice(F.split("matched_entity_ids", ","), 1, 2)).alias("pos", "match_id"))
    ids = ids.withColumn("match_id", F.trim("match_id"))
    s1 = recs.where(F.col("src") == 1).select(F.col("entity_id").alias("s1_id"),
                                              F.col("business_name").alias("s1_name"),
                                              F.col("business_address").alias("s1_addr"))
    tg = recs.where(F.col("src") != 1).select(F.col("entity_id").alias("match_id"),
                                              F.col("business_name").alias("match_name"),
                                              F.col("business_address").alias("match_addr"))
    ex = ids.join(s1, "s1_id").join(tg, "match_id")
    per = ex.groupBy("s1_id").agg(F.count(F.lit(1)).alias("k"))
    # frame of at most 3n rows
    w = Window.orderBy("s1_id").rowsBetween(Window.unboundedPreceding, -1)
    keep = per.withColumn("before", F.coalesce(F.sum("k").over(w), F.lit(0))).where(F.col("before") < n)
    return (ex.join(keep.select("s1_id"), "s1_id", "left_semi")
            .select("s1_id", "s1_name", "s1_addr", "match_id", "match_name", "match_addr"))
