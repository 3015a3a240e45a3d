"""Embedding whitening against NumPy's symmetric eigenvalue solver and exact sums."""

import numpy as np
import pytest

from conftest import SF0001
from matchbook.llm import whitening
from matchbook.llm.common import table
from matchbook.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def _brute(vectors):
    """x, deviations, eigenvalues (falling) and components of plain lists."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(column) for column in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, units = np.linalg.eigh(centred.T @ centred / n)
    return centred, deviation, values[::-1], units.T[::-1]


def test_query_matches_numpy(spark):
    rows = {r.vec_id: [float(c) for c in r.embedding] for r in table(spark, SF0001, "embeddings").collect()}
    centred, deviation, values, units = _brute(rows.values())
    place = {v: i for i, v in enumerate(rows)}
    got = QUERIES["op13_embedding_whitening"](spark, SF0001).collect()
    assert len(got) == 32 * len(rows)
    z = np.zeros((len(rows), 32))
    for r in got:
        assert r.n == len(rows) and r.deviation == deviation[place[r.vec_id]]
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-10
        z[place[r.vec_id], r.component - 1] = r.whitened
    error = np.abs(z.T @ z / len(rows) - z.mean(0)[:, None] * z.mean(0) - np.eye(32)).max()
    assert error < 1e-9 and all(abs(r.identity_error - error) < 1e-9 for r in got[:5])
    want = centred @ units[:32].T / np.sqrt(values[:32])
    gaps = np.minimum(values[:32] - values[1:33], np.concatenate([[np.inf], values[:31] - values[1:32]]))
    sure = gaps > 1e-3 * values[0]
    signs = np.sign((want * z).sum(axis=0))
    assert np.abs(want * signs - z)[:, sure].max() < 1e-8 and sure.sum() >= 5


@pytest.mark.parametrize("d, rank", [(1, 1), (2, 2), (5, 5), (24, 24), (33, 7), (70, 70)])
def test_factorisation(d, rank):
    rng = np.random.default_rng(d)
    half = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-2, 3, rank)
    v = half @ half.T
    factor = whitening.pivoted_cholesky(v)
    assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, v, atol=1e-12 * v.max())
    values, units = whitening.one_sided_jacobi(factor)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-6, atol=1e-13 * v.trace())
    assert np.abs(units @ units.T - np.eye(rank)).max() < 1e-9


def test_odd_rows_are_dropped(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(0, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0])]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0]),
           (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0]), (107, [1.0] * 4)]
    df = spark.createDataFrame([(*r, "x", 5) for r in good + bad], SCHEMA + ", C0 string, N int").repartition(3)
    whole = whitening.whiten(df)
    assert whole.columns == ["vec_id", "embedding", "C0", *whitening.ADDED]
    got = whitening.by_component(whole).collect()
    centred, deviation, values, _ = _brute([v for _, v in good])
    assert len(got) == 3 * len(good) and {r.n for r in got} == {len(good)}
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    assert np.allclose([r.explained for r in got if r.vec_id == 7], values / values.sum())


def test_equal_rows_and_empty_table(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, None)]):
        df = whitening.by_component(whitening.whiten(spark.createDataFrame(rows, SCHEMA)))
        assert df.collect() == [] and "identity_error" in df.columns


def test_rank_below_the_number_of_components_and_large_values(spark):
    rows = [(i, [float(i), 2.0 * i, 2.0 ** 55 if i % 2 else -(2.0 ** 55)]) for i in range(20)]
    got = whitening.by_component(whitening.whiten(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {r.deviation for r in got} == {None} and all(np.isfinite(r.whitened) for r in got)
    small = [(i, [float(i % 5), 2.0 * (i % 5), 0.0]) for i in range(20)]
    got = whitening.by_component(whitening.whiten(spark.createDataFrame(small, SCHEMA))).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12 and got[0].identity_error < 1e-9


def test_deviation_beyond_fast_sums():
    model = whitening.Whitening(2, 3, [3_000_000, 3_000_000 + 3 * (1 << 30)], np.zeros((0, 2)), np.zeros(0), np.zeros(0))
    x = np.array([[1_000_000, 1_000_000], [1_000_001, 1_000_000 + (1 << 30)]])
    assert model.deviations(x) == [(3 << 30) ** 2 if (3 << 30) ** 2 < 1 << 63 else None, 9]
