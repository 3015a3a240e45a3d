"""Retrieval-style candidate keys and rankers (specified matching stage).

* phonetic key: country + Soundex of the first name token (M01);
* TF-IDF top-3 name-token key (M02);
* BM25 and TF-IDF rerankers of candidate pairs: each S1 name is the query,
  target names are documents with per-country corpus statistics.

They rank a bounded candidate set (the capped blocking pairs) and are no
retrieval (M04, M05 are open): what blocking does not offer is lost. They do
not probe whole posting lists: a full postings join emits every pair that
shares a term, which is quadratic for a hot term. Corpus statistics (N,
average length, document frequency) still come from all targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.functions import text as tx
from matchbook.operators.blocking import Blocks, block_pairs
from matchbook.operators.grams import cosines_of
from matchbook.operators.pair_kernels import compared
from matchbook.session import ship_package, written

K1, B = 1.2, 0.75


def keys_phonetic(norm: DataFrame) -> DataFrame:
    """``(entity_id, tag='phon', key=country|soundex(first token))``."""
    n0 = F.try_element_at(tx.tokens(F.coalesce(F.col("norm_name"), F.lit(""))), F.lit(1))
    return (norm.where(n0.isNotNull())
            .select("entity_id", F.lit("phon").alias("tag"),
                    F.concat_ws("|", tx.fold_country(F.col("country")), F.soundex(n0)).alias("key")))


def _name_terms(norm: DataFrame) -> DataFrame:
    """``(entity_id, country, term, tf, dl)`` from normalised names."""
    toks = tx.tokens(F.coalesce(F.col("norm_name"), F.lit("")))
    ex = norm.select("entity_id", tx.fold_country(F.col("country")).alias("cty"),
                     F.size(toks).alias("dl"), F.explode(toks).alias("term"))
    return ex.groupBy("entity_id", "cty", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def keys_tfidf_top3(norm: DataFrame) -> DataFrame:
    """Key of the three highest TF-IDF name tokens (ties by token), sorted.

    idf = ln((1+N)/(1+df)) + 1 over all records; N is a scalar subquery.
    """
    terms = _name_terms(norm)
    n = norm.select(F.count(F.lit(1))).scalar()
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = terms.join(df, "term").withColumn(
        "weight", F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1))
    r = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("weight"), "term"))
    top = w.withColumn("_r", r).where(F.col("_r") <= 3)
    return (top.groupBy("entity_id", "cty")
            .agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("_t"))
            .select("entity_id", F.lit("tfidf3").alias("tag"), F.concat_ws("|", "cty", "_t").alias("key")))


def rerank_bm25(pairs: DataFrame | Blocks, norm_s1: DataFrame, norm_targets: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` candidates per S1 by BM25 of the target name against the S1 name.

    idf = ln(1 + (N − df + 0.5)/(df + 0.5)), k1 = 1.2, b = 0.75, statistics
    per country over all targets; score rounded to 6 dp, ties by id. What each
    term of a target adds is computed once a target, so with blocks no pair is
    shuffled with its terms.
    """
    docs = _name_terms(norm_targets)
    stats = docs.select("entity_id", "cty", "dl").distinct().groupBy("cty").agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    dfs = docs.groupBy("cty", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = (dfs.join(stats, "cty")
           .withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (
        F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    terms = (docs.join(idf, ["cty", "term"]).groupBy(F.col("entity_id").alias("cand_id"))
             .agg(F.collect_list(F.struct("term", part.alias("part"))).alias("terms")))
    asked = (norm_s1.groupBy(F.col("entity_id").alias("s1_id"))
             .agg(F.flatten(F.collect_list(F.array_distinct(tx.tokens(F.coalesce(F.col("norm_name"), F.lit("")))))).alias("asked")))
    met = block_pairs(pairs, asked, terms) if isinstance(pairs, Blocks) else pairs.join(asked, "s1_id").join(terms, "cand_id")
    parts = F.transform("terms", lambda t: t["part"] * F.size(F.filter("asked", lambda x: x == t["term"])))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    # in an explode, so that the filter on it does not compute it again; a shared term adds more than 0
    scores = (met.select("s1_id", "cand_id", F.explode(F.array(total)).alias("_s")).where(F.col("_s") > 0)
              .withColumn("bm25", F.round("_s", 6)))
    w = Window.partitionBy("s1_id").orderBy(F.desc("bm25"), "cand_id")
    return (scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
            .select("s1_id", "cand_id", "bm25", "rank"))


def name_gram_weights(norm: DataFrame, n_lo: int = 2, n_hi: int = 4) -> DataFrame:
    """``(entity_id, grams, weights)``: L2-normalised TF-IDF weights of character n-grams of ``norm_name``.

    tf = occurrences in the name, idf = ln((1+N)/(1+df)) + 1 over all records.
    Grams are numbered; records of the same names share one vector.
    """
    name = F.col("x")
    L = F.length(name)

    def grams_of(n: int):
        # a one-argument lambda: transform passes (element, index) to two-argument ones
        return F.when(L >= n, F.transform(F.sequence(F.lit(1), L - n + 1), lambda i: name.substr(i, F.lit(n)))
                      ).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*[grams_of(n) for n in range(n_lo, n_hi + 1)]))
    records = written(norm.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.coalesce("norm_name", F.lit("")))).alias("names")), "gram-records")
    texts = records.groupBy("names").agg(F.count(F.lit(1)).alias("n"))
    texts = written(texts.withColumn("nid", F.monotonically_increasing_id()), "gram-texts")
    tf = (texts.select("nid", "n", F.explode("names").alias("x")).select("nid", "n", F.explode(grams).alias("gram"))
          .groupBy("nid", "n", "gram").agg(F.count(F.lit(1)).alias("tf")))
    n = norm.count()
    df = tf.groupBy("gram").agg(F.sum("n").alias("df"))
    df = written(df.withColumn("gid", F.monotonically_increasing_id()), "gram-numbers")
    w = tf.join(df, "gram").withColumn("w", F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    vectors = w.groupBy("nid").agg(F.collect_list(F.struct("gid", "w")).alias("x"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vectors = vectors.select("nid", F.col("x.gid").alias("grams"), F.transform("x.w", lambda x: x / F.col("norm")).alias("weights"))
    return (records.join(texts.select("names", "nid"), "names").join(vectors, "nid").select("entity_id", "grams", "weights"))


def pair_tfidf_cosine(pairs: DataFrame | Blocks, weights: DataFrame, records: DataFrame, best: int | None = None) -> DataFrame:
    """Cosine of the gram vectors for each given pair (M14); 0 when nothing is shared.

    The vectors of both sides meet as arrays, with blocks a vector once a block. ``records`` has all ids.
    With ``best`` pairs of blocks that cannot be among the ``best`` first of their S1 record may be left out.
    """
    ship_package(weights.sparkSession)
    every = records.select("entity_id").distinct().join(weights, "entity_id", "left")
    of = lambda i, p: every.select(F.col("entity_id").alias(i), F.coalesce("grams", F.array().cast("array<long>")).alias(f"{p}g"),
                                   F.coalesce("weights", F.array().cast("array<double>")).alias(f"{p}w"))
    if isinstance(pairs, Blocks):
        a, b = (of(i, "").withColumnsRenamed({"g": "grams", "w": "weights"}) for i in ("s1_id", "cand_id"))
        return compared(pairs, a, b, ["tfidf_cosine"], best)
    met = pairs.join(of("s1_id", "q"), "s1_id").join(of("cand_id", "d"), "cand_id")
    cosines = met.select(F.col("s1_id").alias("qn"), F.col("cand_id").alias("dn"), "qg", "qw", "dg", "dw") \
        .mapInArrow(cosines_of, "qn string, dn string, cosine double")
    return cosines.select(F.col("qn").alias("s1_id"), F.col("dn").alias("cand_id"), F.round("cosine", 6).alias("tfidf_cosine"))


def rerank_tfidf(cos: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` candidates per S1 by gram TF-IDF cosine, ties by id."""
    w = Window.partitionBy("s1_id").orderBy(F.desc("tfidf_cosine"), "cand_id")
    return (cos.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k))
