"""Rules, training pairs and rerankers read lists and blocks, not shuffled pairs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchbook.operators import blocking as bl
from matchbook.operators import match as mt
from matchbook.operators import quality as dq
from matchbook.operators import retrieve as rt
from test_block_scale import records, shuffled_pairs


def test_rules_read_the_lists_once(spark):
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", "S1-9,X-1"), ("S1-2", "")], "s1 string, ids string") \
        .withColumn("ids", F.concat("ids", F.lit("")))
    required, valid = spark.createDataFrame([("S1-1",), ("S1-3",)], "e string"), spark.createDataFrame([("S2-7",)], "e string")
    offs = dq.offenders(lists, "s1", "ids", required, valid)
    assert {(r.rule, r.offender) for r in offs.collect()} == {
        ("duplicate_s1", "S1-1"), ("repeated_ids", "S1-1"), ("self_match", "S1-9"), ("wrong_prefix", "X-1"),
        ("unknown_ids", "S2-1"), ("missing_s1", "S1-3"), ("extra_s1", "S1-2")}
    plan = offs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(split(") == 1


def test_training_pairs_like_the_windows(spark):
    pairs = spark.range(300).selectExpr("concat('S1-', id % 3) AS s1_id", "concat('S2-', id) AS cand_id")
    truth = pairs.where("s1_id = 'S1-1' AND cand_id < 'S2-15' OR cand_id = 'S2-3'")
    truth = truth.unionByName(truth.where("cand_id = 'S2-3'")).unionByName(truth.selectExpr("s1_id", "'S2-none' AS cand_id"))
    lab = pairs.join(truth.withColumn("t", F.lit(1)), ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("t", F.lit(0)))
    n = F.sum("label").over(Window.partitionBy("s1_id"))
    r = F.row_number().over(Window.partitionBy("s1_id", "label").orderBy(F.md5(F.concat("s1_id", "cand_id")), "cand_id"))
    want = lab.withColumn("q", F.when(n > 0, n * 2).otherwise(2)).withColumn("r", r).where("label = 1 OR r <= q")
    got = mt.training_pairs(pairs, truth, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("s1_id", "cand_id", "label").collect()))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_bm25_of_blocks_equals_that_of_pairs(spark):
    s1 = records(spark, "S1-", ["oak mill", "oak oak"])
    tg = records(spark, "S2-", ["oak mill", "oak press", "elm mill", "oak oak mill"])
    blocks = bl.profile_blocks(s1, tg, "v4", 3)
    pairs = bl.listed_pairs(bl.block_lists(blocks, 3))
    got, want = rt.rerank_bm25(blocks, s1, tg, 2), rt.rerank_bm25(pairs, s1, tg, 2)
    rows = sorted(map(tuple, got.collect()))
    assert rows and rows == sorted(map(tuple, want.collect()))


def test_tfidf_of_blocks_shuffles_no_pair(spark):
    s1 = records(spark, "S1-", ["oak mill", "", "oak"])
    norm = s1.unionByName(records(spark, "S2-", ["oak mill", "oak press", "o", "oak oak mill"]))
    blocks = bl.profile_blocks(s1, norm.where("entity_id like 'S2-%'"), "v4", 3)
    got = rt.pair_tfidf_cosine(blocks, rt.name_gram_weights(norm), norm)
    assert not shuffled_pairs(got)
    found = {(r.s1_id, r.cand_id): r.tfidf_cosine for r in got.collect()}
    pairs = bl.listed_pairs(bl.block_lists(blocks, 3))
    assert len(found) == pairs.count() and found["S1-0", "S2-0"] == 1.0
    for r in rt.pair_tfidf_cosine(pairs, rt.name_gram_weights(norm), norm).collect():
        assert abs(found[r.s1_id, r.cand_id] - r.tfidf_cosine) < 2e-6


def test_rules_do_not_join_the_records_again(spark, monkeypatch):
    """The valid ids come from the normalised records, which are written once an input folder."""
    from matchbook.plans import catalog
    seen = []
    monkeypatch.setattr(catalog.rs, "targets", lambda recs: seen.append(recs))
    monkeypatch.setattr(catalog.dq, "offenders", lambda *args: seen.append(args[-1].columns))
    catalog._dq_offenders(spark, "/root/testdata/sf0.001")
    assert seen == [["entity_id"]]


def test_blocks_are_sorted_by_keys_before_types(spark):
    norm = records(spark, "S2-", ["oak mill", "oak press"])
    kept = bl.truncate_blocks(bl.explode_keys(norm, "v4"), 3)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "Window [" in line)
    assert window.index("key#") < window.index("tag#")
