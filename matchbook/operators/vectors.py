"""Nearest neighbours over given vectors (M06): exact, and by an inverted file of cells.

Similarity is the inner product, rounded to six places; ties go to the smaller
id. A vector is no neighbour of itself. Rows whose vector is null, holds a null or
a non-finite entry, or has another length than most vectors neither ask nor are found.

* ``exact_topk``: the queries go in blocks of ``QUERIES`` rows, each broadcast; a
  task keeps the best K rows of each query while it reads its part of the table.
* ``cell_topk``: cell centres are fitted on at most ``SAMPLE`` rows (those with
  the smallest hashes of their ids), every row goes to its nearest centre, and
  every query to the centres with the largest inner products, where all rows are
  scored exactly. How many is learnt from the sample: enough to reach ``RECALL``
  of the neighbours of ``ASKED`` of its rows within it. Cells of more than
  ``ROWS`` rows, or with more than ``QUERIES`` queries, are split into parts; no
  row, query or pair of them is left out of a probed cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.session import ship_package, written

QUERIES = 2_000
ROWS = 20_000
SAMPLE = 20_000
MAX_CELLS = 1024
ASKED, RECALL = 200, 0.95  # rows of the sample that ask the others, share of neighbours to reach there
_FOUND = "query_id bigint, vec_id bigint, score double"


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): rows with finite vectors of the usual length."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")) \
        .where("vec_id is not null and size(vector) > 0")
    usual = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return rows.where((F.size("vector") == (usual[0].d if usual else 0)) & finite)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _best(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query (scores: queries by rows), a query after the other."""
    scores = np.where(query_ids[:, None] == ids[None, :], -np.inf, np.round(scores, 6) + 0.0)
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
    best = np.take_along_axis(scores, order, axis=1)
    keep = best > -np.inf
    return np.repeat(query_ids, order.shape[1])[keep.ravel()], ids[order].ravel()[keep.ravel()], best.ravel()[keep.ravel()]


def _rows(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def exact_topk(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, score, rank): the k rows with the largest inner product; both sides are (vec_id, vector)."""
    spark = rows.sparkSession
    ship_package(spark)
    blocks = -(-queries.count() // QUERIES)
    asked = written(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks)))), "vector-queries")
    out = spark.createDataFrame([], _FOUND)
    for b in range(blocks):
        block = asked.where(F.col("block") == b).toArrow()
        shared = spark.sparkContext.broadcast((block.column("vec_id").to_numpy(), _matrix(block.column("vector"))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            best = None
            for batch in batches:
                if not len(batch) or not len(ids):
                    continue
                for start in range(0, len(batch), 1000):  # queries x 1000 scores at a time
                    part = batch.slice(start, 1000)
                    now = _best(ids, part.column("vec_id").to_numpy(), vectors @ _matrix(part.column("vector")).T, k)
                    best = now if best is None else _merged(best, now, k)
            if best is not None:
                yield _rows(best)

        out = out.unionByName(written(ranked(rows.mapInArrow(run, _FOUND), k).drop("rank"), "vector-found"))
        shared.unpersist()
    return ranked(out, k)


def _merged(a: tuple, b: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    query, vec, score = (np.concatenate(x) for x in zip(a, b))
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.concatenate([[True], query[1:] != query[:-1]])
    place = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
    return query[place < k], vec[place < k], score[place < k]


# -- inverted file -----------------------------------------------------------------

@dataclass
class Cells:
    """Centres, and the number of them that a query probes."""

    centres: np.ndarray
    probes: int


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def _promising(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argsort(-(x @ centres.T), axis=1, kind="stable")


def fit_cells(rows: DataFrame, k: int = 10, cells: int | None = None, seed: int = 1) -> Cells | None:
    """Centres from at most ``SAMPLE`` rows; about the square root of the number of rows, ``MAX_CELLS`` at most."""
    n = rows.count()
    if n < 2:
        return Cells(np.zeros((1, len(rows.head().vector))), 1) if n else None
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE) if n > SAMPLE else rows
    sample = written(sample, "vector-sample")
    means = KMeans(k=cells or min(MAX_CELLS, max(2, round(n ** 0.5))), seed=seed, maxIter=10)
    centres = np.array(means.fit(sample.select(array_to_vector("vector").alias("features"))).clusterCenters())
    table = sample.orderBy("vec_id").toArrow()
    ids, x = table.column("vec_id").to_numpy(), _matrix(table.column("vector"))
    asked = slice(None, None, max(1, len(x) // ASKED))
    query, found, _ = _best(ids[asked], ids, x[asked] @ x.T, k)
    if not len(query):
        return Cells(centres, 1)
    place = {v: i for i, v in enumerate(ids.tolist())}
    q, f = (np.array([place[v] for v in y.tolist()]) for y in (query, found))
    ranks = np.argsort(_promising(x[q], centres), axis=1)[np.arange(len(q)), _nearest(x[f], centres)]
    return Cells(centres, int(np.quantile(ranks, RECALL, method="higher")) + 1)


def with_cells(rows: DataFrame, cells: Cells, asking: bool) -> DataFrame:
    """(vec_id, vector, cells): the nearest centre of a row, or all that a query probes."""
    ship_package(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("vector"))
            own = _promising(x, c.centres)[:, :c.probes] if asking else _nearest(x, c.centres)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * own.shape[1], pa.int32()), pa.array(own.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), lists], ["vec_id", "vector", "cells"])

    return rows.mapInArrow(run, "vec_id bigint, vector array<double>, cells array<int>")


def cell_topk(queries: DataFrame, rows: DataFrame, k: int = 10, cells: Cells | None = None) -> DataFrame:
    """As ``exact_topk``, over the rows of the probed cells only."""
    cells = cells or fit_cells(rows, k)
    if cells is None:
        return ranked(rows.sparkSession.createDataFrame([], _FOUND), k)
    indexed = written(with_cells(rows, cells, False).select("vec_id", "vector", F.col("cells")[0].alias("cell")), "vector-cells")
    asked = written(with_cells(queries, cells, True).select("vec_id", "vector", F.explode("cells").alias("cell")), "vector-probes")
    parts = indexed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("parts"))
    blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
    split = written(parts.join(blocks, "cell"), "vector-split")  # a row a cell
    one = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.join(split, "cell").withColumn("part", one("parts")).withColumn("block", each("blocks")) \
        .select("cell", "part", "block", "vec_id", "vector")
    right = asked.join(split, "cell").withColumn("block", one("blocks")).withColumn("part", each("parts")) \
        .select("cell", "part", "block", "vec_id", "vector")

    def score(own: pa.Table, probing: pa.Table) -> pa.Table:
        ids, vectors = own.column("vec_id").to_numpy(), _matrix(own.column("vector"))
        best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        for start in range(0, len(probing) if len(own) else 0, 100):
            some = probing.slice(start, 100)
            now = _best(some.column("vec_id").to_numpy(), ids, _matrix(some.column("vector")) @ vectors.T, k)
            best = tuple(np.concatenate(x) for x in zip(best, now))
        return pa.Table.from_batches([_rows(best)])

    by = ["cell", "part", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(score, _FOUND)
    return ranked(found, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_queries, n_neighbours, n_found, recall) of ``found`` against the exact neighbours."""
    hits = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_neighbours"),
                    F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found")) \
        .withColumn("recall", F.round(F.col("n_found") / F.greatest("n_neighbours", F.lit(1)), 6))
