"""Small helpers shared by the operators: name clashes, scratch tables, shapes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from matchbook.session import ensure_checkpoint_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop input columns that an operator is about to add (any letter case)."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/matchbook-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: after a lost executor later jobs read the table again
    instead of recomputing what led to it. The folder goes with the
    checkpoint folder, which the cluster cleans.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with this package on the workers' path."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Jobs that start inside read and send ``rows`` rows at a time to Python: a text or chunk may be a large row."""
    keys = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = [spark.conf.get(key) for key in keys]
    try:
        for key in keys:
            spark.conf.set(key, str(rows))
        yield
    finally:
        for key, value in zip(keys, before):
            spark.conf.set(key, value)


@contextmanager
def bucketed(df: DataFrame, keys: list[str], name: str) -> Iterator[DataFrame]:
    """``df`` written once in buckets of ``keys``: joins on them shuffle only their other side.

    The table leaves the catalog at the end; its folder goes with the checkpoint folder.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = f"matchbook_{name}_{uuid.uuid4().hex}"
    (df.repartition(n, *keys).write.format("parquet").option("compression", "zstd").bucketBy(n, *keys)
     .option("path", scratch_path(spark, name)).saveAsTable(known))
    try:
        yield spark.table(known)
    finally:
        spark.sql(f"DROP TABLE {known}")
