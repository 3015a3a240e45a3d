"""README's T01 figures: letters that ascii_fold deletes, as Spark folds them."""

import os
import re
import unicodedata

from conftest import ROOT
from pyspark.sql import functions as F

from matchbook.functions import text as tx

RANGES = {"Latin U+00C0-024F and U+1E00-1EFF": [(0xC0, 0x24F), (0x1E00, 0x1EFF)], "Greek": [(0x370, 0x3FF)],
          "Cyrillic": [(0x400, 0x4FF)], "Devanagari": [(0x900, 0x97F)], "Tamil": [(0xB80, 0xBFF)],
          "full-width Latin": [(0xFF21, 0xFF3A), (0xFF41, 0xFF5A)], "Han U+4E00-9FA5": [(0x4E00, 0x9FA5)]}


def deleted(spark):
    rows = [(name, chr(c)) for name, parts in RANGES.items() for lo, hi in parts for c in range(lo, hi + 1)
            if unicodedata.category(chr(c))[0] == "L"]
    df = spark.createDataFrame(rows, "name string, letter string")
    gone = (tx.ascii_fold(F.col("letter")) == "").cast("int")
    return {r.name: (r.gone, r.n) for r in df.groupBy("name").agg(F.sum(gone).alias("gone"), F.count("*").alias("n")).collect()}


def test_readme_figures_of_the_fold(spark):
    with open(os.path.join(ROOT, "README.md"), encoding="utf-8") as f:
        readme = " ".join(f.read().split())
    assert re.search(r"\| Text T01 \(partial", readme)
    for name, (gone, n) in deleted(spark).items():
        assert f"{name} {gone} of {n}" in readme
