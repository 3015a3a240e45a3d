"""Normalise records: one narrow stage, no shuffle (reference phase 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.functions import text as tx


def normalize_records(recs: DataFrame) -> DataFrame:
    """Add ``norm_name, norm_address, zip_pin, name_prefix, name_suffix``.

    ``zip_pin`` is extracted from the normalised address (so 6-digit PINs were
    already removed as phone numbers, as in the reference).
    """
    out = recs.withColumns({
        "norm_name": tx.normalize_name(F.col("business_name")),
        "norm_address": tx.normalize_address(F.col("business_address")),
    })
    return out.withColumns({
        "zip_pin": tx.zip_pin(F.col("norm_address")),
        "name_prefix": tx.name_prefix(F.col("norm_name")),
        "name_suffix": tx.name_suffix(F.col("norm_name")),
    })


def normalize_stats(norm: DataFrame) -> DataFrame:
    """Per source: rows, zip extracted, zip %, address nulls."""
    return (norm.groupBy("src")
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.count_if(F.col("zip_pin") != "").alias("zip_extracted"),
                 F.count_if(F.col("business_address").isNull()).alias("addr_null"))
            .withColumn("zip_pct", F.round(F.col("zip_extracted") * 100.0 / F.col("rows"), 2)))
