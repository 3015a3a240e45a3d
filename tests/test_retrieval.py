"""Retrieval over all targets and vectors against DuckDB and brute force."""

import math

import numpy as np
import pytest

from conftest import SF0001
from harness import compare
from matchbook.operators import bm25, grams, vectors
from matchbook.plans.catalog import ORACLE, QUERIES

NORM = "entity_id string, country string, norm_name string"


@pytest.mark.parametrize("name", ["bm25_retrieval", "gram_topk", "embedding_topk", "minhash_signatures", "block_minhash", "blocking_recall_minhash"])
def test_query_matches_oracle(spark, duck0001, name):
    problems, n = compare(QUERIES[name](spark, SF0001), duck0001, ORACLE[name])
    assert not problems and n


def _bm25(queries, targets, k):
    out = set()
    for cty in {c for _, c, _ in targets}:
        docs = [(i, (n or "").split()) for i, c, n in targets if c == cty and (n or "").split()]
        avg = sum(len(d) for _, d in docs) / len(docs)
        df = {t: sum(t in d for _, d in docs) for _, d in docs for t in d}
        for q, c, name in queries:
            if c != cty:
                continue
            scores = []
            for i, d in docs:
                common = set((name or "").split()) & set(d)
                if common:
                    s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * 2.2
                            / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / avg)) for t in common)
                    scores.append((-round(s, 6), i))
            out |= {(q, i, r) for r, (_, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_bm25_with_long_lists_at_every_level(spark):
    """Few words, so that all lists and most pairs and triples of words are long; one name has very many targets."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(9)]
    name = lambda: " ".join(rng.choice(words, rng.integers(1, 6)))
    targets = [(f"S2-{i:04}", "US" if i % 4 else "FR", name()) for i in range(700)] + [(f"S3-{i:04}", "US", "w1 w2 w2") for i in range(150)]
    targets += [("S2-x", "US", None), ("S2-y", "US", ""), ("S2-z", "US", "rare w1")]
    queries = [(f"S1-{i}", "US" if i % 3 else "FR", name()) for i in range(40)] + [("S1-a", "US", "rare w2 w1"), ("S1-b", "US", "unknown"), ("S1-c", "US", None)]
    got = bm25.bm25_topk(spark.createDataFrame(queries, NORM), spark.createDataFrame(targets, NORM), 5, longest=8)
    assert {(r.s1_id, r.cand_id, r["rank"]) for r in got.collect()} == _bm25(queries, targets, 5)


def test_gram_topk_without_matches_or_names(spark):
    s1 = spark.createDataFrame([("S1-1", "US", "abc"), ("S1-2", "US", ""), ("S1-3", "US", None), ("S1-4", "US", "x")], NORM)
    targets = spark.createDataFrame([("S2-1", "US", "zzzz"), ("S2-2", "FR", "abc"), ("S2-3", "US", None)], NORM)
    assert grams.gram_topk(s1, targets, s1.unionByName(targets)).collect() == []


def test_cells_reach_the_recall_and_keep_to_probed_cells(spark):
    r = QUERIES["embedding_cells_recall"](spark, "/root/testdata/sf0.1").first()
    assert r.recall >= 0.9 and r.n_neighbours == 10 * r.n_queries


def test_vectors_with_odd_rows_and_one_hot_vector(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)] + [(1000 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(200)]
    bad = [(5000, None), (5001, []), (5002, [1.0]), (5003, [1.0, None, 0.0, 0.0]), (5004, [float("nan")] * 4), (None, [1.0] * 4)]
    df = vectors.usable(spark.createDataFrame(rows + bad, "i long, v array<double>").repartition(4), "i", "v")
    asked = df.where("vec_id % 20 = 0")
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    want = set()
    for i, v in rows:
        if i % 20 == 0:
            order = sorted((-round(float(np.dot(v, y)), 6) + 0.0, j) for j, y in zip(ids.tolist(), x) if j != i)
            want |= {(i, j, r) for r, (_, j) in enumerate(order[:10], 1)}
    found = lambda d: {(r.query_id, r.vec_id, r["rank"]) for r in d.collect()}
    monkeypatch.setattr(vectors, "QUERIES", 7)
    assert found(vectors.exact_topk(asked, df)) == want
    monkeypatch.setattr(vectors, "ROWS", 30)  # hot cells in many parts
    centres = x[:5]
    assert found(vectors.cell_topk(asked, df, cells=vectors.Cells(centres, 5))) == want
    none = df.where("false")
    assert vectors.exact_topk(none, none).collect() == [] and vectors.cell_topk(none, none).collect() == []
