"""Incremental blocking for target records that arrive as a stream.

New S2/S3 records are read with Structured Streaming; each micro-batch is
blocked against the static, normalised S1 side with the same capped join as
the batch job, and its per-S1 top-``cap`` candidates are appended to a
Parquet folder. Because candidates are ranked by a total order
``(key priority, hash of cand_id)``, the top ``cap`` of a union equals the top
``cap`` of the union of each part's top ``cap``: ``current_candidates``
compacts the appended parts into exactly the batch result. A record that
arrives again takes one place, by its most specific key. Batches are
idempotent per ``batch_id`` (the part folder is overwritten on replay), so
a lost executor or a restarted query only recomputes, never duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchbook.operators import blocking as bl
from matchbook.operators.normalize import normalize_records
from matchbook.sources.records import RECORD_SCHEMA


def start(spark: SparkSession, arrivals_dir: str, norm_s1: DataFrame, out_dir: str,
          checkpoint_dir: str, version: str = "v4", cap: int = 300, available_now: bool = True,
          max_files_per_trigger: int | None = None):
    """Start the streaming query; returns the ``StreamingQuery``."""
    reader = spark.readStream.schema(RECORD_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    arrivals = reader.parquet(arrivals_dir)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        targets = normalize_records(batch.dropDuplicates())
        (bl.block(norm_s1, targets, version, cap)
           .write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}"))

    w = arrivals.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def current_candidates(spark: SparkSession, out_dir: str, cap: int = 300) -> DataFrame:
    """Compact all appended parts into the per-S1 top ``cap``."""
    from matchbook.operators.keys import KEY_PRIORITY
    parts = spark.read.parquet(out_dir)
    prio = F.create_map(*[x for t, p in KEY_PRIORITY.items() for x in (F.lit(t), F.lit(p))])
    w = Window.partitionBy("s1_id").orderBy("prio", *bl.id_order("cand_id"))
    return (parts.withColumn("prio", F.try_element_at(prio, F.col("best_key")))
            .repartition("s1_id")
            .groupBy("s1_id", "cand_id").agg(F.min("prio").alias("prio"), F.min_by("best_key", "prio").alias("best_key"))
            .withColumn("rank", F.row_number().over(w).cast("long"))
            .where(F.col("rank") <= cap)
            .select("s1_id", "cand_id", "best_key", "rank"))
