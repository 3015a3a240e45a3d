"""Materialised stage boundaries under ``spark.checkpoint.dir``.

The normalised records are written once per input folder as Parquet (the
reference also writes its normalised files once) and read back by every
later query. This cuts lineage — a lost executor re-reads Parquet instead of
recomputing normalisation — and spares each query the regex work.
"""

from __future__ import annotations

import hashlib
import os
import threading
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from matchbook.session import ensure_checkpoint_dir

#: what the content of a stage follows from, besides the input
_RULES = ("functions/text.py", "functions/romanise.py", "functions/constants.py", "operators/normalize.py", "sources/records.py")
_LOCK = threading.Lock()


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def rules_digest(root: Path = Path(__file__).resolve().parent.parent) -> str:
    """Changes with every change of the code that makes the stages, so that no stage of older rules is read."""
    digest = hashlib.sha1()
    for name in _RULES:
        digest.update((root / name).read_bytes())
    return digest.hexdigest()


def _signature(spark: SparkSession, sf_dir: str, tables: list[str]) -> str:
    """Rules, input folder, and name, size and time of every file of the tables."""
    # MATCHBOOK_STAGE_TAG forces fresh stages (bench.py sets it per run)
    parts = [rules_digest(), os.environ.get("MATCHBOOK_STAGE_TAG", ""), sf_dir.rstrip("/")]
    for t in tables:
        fs, p = _fs(spark, f"{sf_dir.rstrip('/')}/{t}.parquet")
        files = fs.listFiles(p, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath().toString()}:{f.getLen()}:{f.getModificationTime()}")
        parts += sorted(found)
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def stage(spark: SparkSession, name: str, sf_dir: str, tables: list[str],
          build: Callable[[], DataFrame]) -> DataFrame:
    """Return stage ``name`` for ``sf_dir``, writing it first if absent."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/matchbook-stages/{name}-{_signature(spark, sf_dir, tables)}"
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    with _LOCK:  # one writer per process; readers wait for _SUCCESS
        if not fs.exists(p):
            build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
