"""Streaming incremental blocking equals the batch job."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF0001
from matchbook.operators import blocking as bl
from matchbook.operators.normalize import normalize_records
from matchbook.sources import records as rs
from matchbook.streaming import incremental_block as ib


def test_stream_parts_compact_to_batch_result(spark):
    recs = rs.records(spark, SF0001)
    s1 = normalize_records(rs.source1(recs))
    tg = rs.targets(recs).select("entity_id", "business_name", "business_address", "country")
    scratch = tempfile.mkdtemp(prefix="mb-stream-")
    arrivals = f"{scratch}/arrivals"
    # three arrival files, split by a hash of the id
    for i in range(3):
        tg.where(F.pmod(F.xxhash64("entity_id"), F.lit(3)) == i).write.parquet(f"{arrivals}/f{i}")
    # records that are sent again, in a file of their own and twice in it
    again = tg.where(F.pmod(F.xxhash64("entity_id"), F.lit(5)) == 0)
    again.unionByName(again).write.parquet(f"{arrivals}/f3")
    spark.conf.set("spark.sql.streaming.schemaInference", "false")
    q = ib.start(spark, f"{arrivals}/*", s1, f"{scratch}/out", f"{scratch}/ckpt", cap=7,
                 max_files_per_trigger=2)
    q.awaitTermination(300)
    import os
    assert len([d for d in os.listdir(f"{scratch}/out") if d.startswith("batch=")]) > 1
    got = {tuple(r) for r in ib.current_candidates(spark, f"{scratch}/out", cap=7)
           .select("s1_id", "cand_id", "rank").collect()}
    want = {tuple(r) for r in bl.block(s1, normalize_records(tg.withColumn("src", F.lit(2))), "v4", 7)
            .select("s1_id", "cand_id", "rank").collect()}
    assert got == want
