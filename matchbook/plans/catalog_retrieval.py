"""Registered retrieval queries over all targets or vectors (M04-M07) with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.functions.constants import MAX_CANDIDATES_V4
from matchbook.operators import bm25, evaluate, grams, minhash, vectors
from matchbook.plans import oracle as O
from matchbook.plans.catalog import norm, register, split_norm, truth
from matchbook.sources import records as rs

_NT = O.split_tokens("norm_name")
_CTY = f"coalesce({O.strip_ws('lower(country)')}, '')"

# ---------------------------------------------------------------------------
# BM25 over all targets of the country
# ---------------------------------------------------------------------------

register("bm25_retrieval", f"""{O.norm_cte()},
docs AS (SELECT entity_id, cty, term, dl, count(*) AS tf FROM (
           SELECT entity_id, {_CTY} AS cty, len({_NT}) AS dl, unnest({_NT}) AS term FROM norm WHERE src <> 1) GROUP BY ALL),
stats AS (SELECT cty, count(*) AS n_docs, avg(dl) AS avgdl FROM (SELECT DISTINCT entity_id, cty, dl FROM docs) GROUP BY cty),
idf AS (SELECT d.cty, d.term, ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5)) AS idf, s.avgdl
        FROM (SELECT cty, term, count(*) AS df FROM docs GROUP BY ALL) d JOIN stats s USING (cty)),
qt AS (SELECT DISTINCT entity_id AS s1_id, {_CTY} AS cty, unnest({_NT}) AS term FROM norm WHERE src = 1),
sc AS (SELECT qt.s1_id, d.entity_id AS cand_id,
              round(sum(i.idf * d.tf * {bm25.K1 + 1} / (d.tf + {bm25.K1} * (1 - {bm25.B} + {bm25.B} * d.dl / i.avgdl))), 6) AS bm25
       FROM qt JOIN docs d ON d.cty = qt.cty AND d.term = qt.term JOIN idf i ON i.cty = d.cty AND i.term = d.term
       GROUP BY qt.s1_id, d.entity_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY bm25 DESC, cand_id) AS rank FROM sc) WHERE rank <= 10""")(
    lambda spark, sf: bm25.bm25_topk(*split_norm(spark, sf)))

# ---------------------------------------------------------------------------
# Nearest neighbours over given vectors (M06): ids divisible by 20 ask all rows
# ---------------------------------------------------------------------------

ASKS = 20


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = vectors.usable(rs.table(spark, sf, "embeddings"), "vec_id", "embedding")
    return rows.where(F.col("vec_id") % ASKS == 0), rows


register("embedding_topk", f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.e, v.e), 6) AS score
      FROM v q JOIN v ON q.vec_id % {ASKS} = 0 AND v.vec_id <> q.vec_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")(
    lambda spark, sf: vectors.exact_topk(*_vectors(spark, sf)))

register("embedding_cells")(lambda spark, sf: vectors.cell_topk(*_vectors(spark, sf)))


def _recall(spark: SparkSession, sf: str) -> DataFrame:
    asked, rows = _vectors(spark, sf)
    return vectors.recall(vectors.cell_topk(asked, rows), vectors.exact_topk(asked, rows))


register("embedding_cells_recall")(_recall)

# ---------------------------------------------------------------------------
# Character n-gram cosine over all targets of the country (M05): S1 ids divisible by 20 ask
# ---------------------------------------------------------------------------

_GRAMS = " || ".join(
    f"CASE WHEN length(coalesce(norm_name, '')) >= {n} THEN list_transform(range(1, length(norm_name) - {n - 2}), "
    f"lambda i: substr(norm_name, i, {n})) ELSE []::VARCHAR[] END" for n in grams.SIZES)


def _gram_topk(spark: SparkSession, sf: str) -> DataFrame:
    s1, targets = split_norm(spark, sf)
    asked = s1.where(F.substring("entity_id", 4, 30).cast("long") % ASKS == 0)
    return grams.gram_topk(asked, targets, norm(spark, sf))


register("gram_topk", f"""{O.norm_cte()},
tf AS (SELECT entity_id, gram, count(*) AS tf FROM (SELECT entity_id, unnest({_GRAMS}) AS gram FROM norm) GROUP BY ALL),
df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram),
w0 AS (SELECT entity_id, gram, tf * (ln((1 + (SELECT count(*) FROM norm)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (gram)),
w AS (SELECT n.entity_id, n.src, coalesce({O.strip_ws('lower(n.country)')}, '') AS cty, gram,
             w / sqrt(sum(w * w) OVER (PARTITION BY n.entity_id)) AS w FROM w0 JOIN norm n USING (entity_id)),
c AS (SELECT x.entity_id AS s1_id, y.entity_id AS cand_id, round(sum(x.w * y.w), 6) AS tfidf_cosine
      FROM w x JOIN w y ON x.gram = y.gram AND x.cty = y.cty AND y.src <> 1
      WHERE x.src = 1 AND CAST(substr(x.entity_id, 4) AS BIGINT) % {ASKS} = 0 GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY tfidf_cosine DESC, cand_id) AS rank
               FROM c WHERE tfidf_cosine >= {grams.FLOOR}) WHERE rank <= 10""")(_gram_topk)

# ---------------------------------------------------------------------------
# MinHash blocking of names
# ---------------------------------------------------------------------------

_G3 = ("CASE WHEN length(coalesce(norm_name, '')) >= 3 THEN list_distinct(list_transform(range(1, length(norm_name) - 1), "
       "lambda i: substr(norm_name, i, 3))) WHEN coalesce(norm_name, '') <> '' THEN [norm_name] ELSE []::VARCHAR[] END")
_SIGNED = f"""g AS (SELECT entity_id, src, {_CTY} AS cty,
       list_transform({_G3}, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) AS g FROM norm),
sig AS (SELECT entity_id, src, cty, [{', '.join(f"list_min(list_transform(g, lambda x: (x * {a} + {b}) % {minhash.PRIME}))" for a, b in minhash.FUNCTIONS)}]
        AS signature FROM g WHERE len(g) > 0)"""
register("minhash_signatures", f"{O.norm_cte()}, {_SIGNED} SELECT entity_id, cty, signature FROM sig")(
    lambda spark, sf: minhash.signatures(norm(spark, sf)))

_BANDS = " UNION ALL ".join(
    f"SELECT entity_id, src, '{t}' AS tag, concat_ws('|', cty, {', '.join(f'signature[{i * minhash.ROWS + r + 1}]' for r in range(minhash.ROWS))}) AS key FROM sig"
    for i, t in enumerate(minhash.TAGS))
_MH = f"""{O.norm_cte()}, {_SIGNED}, {O.truth_cte()},
bk AS ({_BANDS}),
p AS (SELECT DISTINCT s.entity_id AS s1_id, t.entity_id AS cand_id FROM bk s JOIN bk t ON s.tag = t.tag AND s.key = t.key
      WHERE s.src = 1 AND t.src <> 1),
blk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY md5(cand_id), cand_id) AS rank FROM p)
        WHERE rank <= {MAX_CANDIDATES_V4})"""


def _minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.minhash_block(*split_norm(spark, sf), MAX_CANDIDATES_V4)


def recall_sql(prefix: str) -> str:
    """Recall of ``blk`` against ``truth``."""
    share = "CASE WHEN total_true_matches > 0 THEN round(found_in_candidates / total_true_matches, 6) ELSE 0.0 END"
    return f"""{prefix},
per AS (SELECT t.s1_id, count(*) AS n_true, count(b.cand_id) AS n_found, (SELECT count(*) FROM blk b2 WHERE b2.s1_id = t.s1_id) AS n_cands
        FROM truth t LEFT JOIN blk b ON t.s1_id = b.s1_id AND t.cand_id = b.cand_id GROUP BY t.s1_id),
agg AS (SELECT coalesce(sum(n_true), 0)::BIGINT AS total_true_matches, coalesce(sum(n_found), 0)::BIGINT AS found_in_candidates,
               count(*) FILTER (WHERE n_true > n_found) AS n_entities_with_miss,
               count(*) FILTER (WHERE n_true > n_found AND n_cands = 0) AS zero_cand_misses FROM per)
SELECT *, total_true_matches - found_in_candidates AS missed, {share} AS blocking_recall,
       CASE WHEN {share} < 0.90 THEN 'WARNING' WHEN {share} < 0.95 THEN 'NOTE' ELSE 'OK' END AS status FROM agg"""


register("block_minhash", f"{_MH} SELECT s1_id, cand_id, rank FROM blk")(_minhash)
register("blocking_recall_minhash", recall_sql(_MH))(
    lambda spark, sf: evaluate.blocking_recall(
        truth(spark, sf), minhash.minhash_lists(*split_norm(spark, sf), MAX_CANDIDATES_V4)))
