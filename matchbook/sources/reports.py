"""Reports as one JSON document."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def report_document(frames: dict[str, DataFrame]) -> DataFrame:
    """(document): one row with a JSON object, for each metric the list of its rows.

    For metric frames of a few rows each (profiles, counts, histograms). Rows are
    in the order of their JSON, columns without a value are left out.
    """
    parts = None
    for name, frame in frames.items():
        rows = frame.select(F.lit(name).alias("metric"), F.to_json(F.struct(*frame.columns)).alias("row"))
        parts = rows if parts is None else parts.unionByName(rows)
    lists = parts.groupBy("metric").agg(F.array_join(F.sort_array(F.collect_list("row")), ",").alias("rows"))
    entry = F.concat(F.regexp_replace(F.to_json(F.array("metric")), r"^\[|\]$", ""), F.lit(":["), "rows", F.lit("]"))
    return lists.agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("}")).alias("document"))


def write_report(frames: dict[str, DataFrame], path: str) -> None:
    """Write the document as the only file of the folder ``path``; a second run replaces it as a whole."""
    report_document(frames).coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict[str, list[dict]]:
    return json.loads(spark.read.text(path, wholetext=True).head().value)
