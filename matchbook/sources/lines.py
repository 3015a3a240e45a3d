"""Text files by line, with file name, line number and raw bytes kept, for checks before parsing.

``read_id_lists`` reads tab-separated id-list files and returns what is wrong with
them beside the rows: a header that is not the expected one (V01; the rows of
such a file are not read), rows without a tab (V02; blank lines are skipped)
and lines that are no valid UTF-8 (V11; they are reported and not read).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchbook.functions.constants import MATCHING_HEADER
from matchbook.functions.text import strip_ws

COMMA, HEADER, MALFORMED, ENCODING = "comma_separated", "wrong_header", "malformed_row", "invalid_utf8"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): line numbers from 1 within each file, also where a file is read in several splits.

    Lines of a split follow each other in one partition, so a split needs the
    number of lines of the splits before it: one small row a split.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                       F.col("_metadata.file_block_start").alias("block"),
                                       F.monotonically_increasing_id().alias("id"))
    splits = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return raw.join(splits, ["file", "block"]) \
        .select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def header_error(value: Column, expected: list[str]) -> Column:
    """The rule that a header line breaks, else null: names are compared lowered and stripped."""
    names = F.transform(F.split(value, "\t"), lambda x: F.lower(strip_ws(x)))
    return (F.when(~value.contains("\t") & value.contains(","), F.lit(COMMA))
            .when(names != F.array(*[F.lit(x) for x in expected]), F.lit(HEADER)))


def read_id_lists(spark: SparkSession, path: str, expected: list[str] = MATCHING_HEADER) -> tuple[DataFrame, DataFrame]:
    """Rows (s1, ids) and errors (file, line, rule, severity, offender): the offender is the header, or the text before the tab."""
    lines = numbered_lines(spark, path)
    valid = F.is_valid_utf8("value")
    own = F.substring_index("value", "\t", 1)
    rule = (F.when(~valid, F.lit(ENCODING)).when(F.col("line") == 1, header_error(F.col("value"), expected))
            .when(~F.col("value").contains("\t") & (strip_ws(F.col("value")) != ""), F.lit(MALFORMED)))
    marked = lines.withColumn("rule", rule)
    errors = marked.where(F.col("rule").isNotNull()).select(
        "file", "line", "rule", F.lit("error").alias("severity"),
        F.when(F.col("line") == 1, F.col("value")).otherwise(strip_ws(own)).alias("offender"))
    unread = marked.where((F.col("line") == 1) & F.col("rule").isNotNull()).select("file")
    rows = marked.where((F.col("line") > 1) & F.col("rule").isNull() & F.col("value").contains("\t")) \
        .join(unread, "file", "left_anti")
    ids = F.expr("substring(value, length(substring_index(value, '\t', 1)) + 2)")
    return rows.select(own.alias("s1"), ids.alias("ids")), errors
