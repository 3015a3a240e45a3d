"""BM25 retrieval over all targets of the same country (M04): exact top K.

The names of S1 are queries, target names are documents. Nothing is restricted
to blocking pairs, and still no posting list of a frequent term is ever joined
as a whole:

* Names with the same bag of words score alike for every query, so distinct
  names are scored, of each of which the first K ids count.
* A key is a set of words. The list of a key holds the names that contain all
  of it. Lists of up to ``LIST`` names are joined as they are. Of a longer list
  only the best K names by (score of the key's words, first id) are joined, and
  the key is extended by one more word, level by level.

That is exact. Let M be the words that a query shares with one of its K best
names. If some part of M has a short list, the name is found there. Else M has a
long list, in which K names before it would share M too and so score at least as
much, with a smaller id on a tie: the name is among the best K of M.

Scale: a query emits at most max(``LIST``, K) rows a key, whatever the skew; keys
are extended only while their lists are long, and only if a query has them.
The words of a name bound every collected array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.functions import text as tx
from matchbook.session import written

K1, B = 1.2, 0.75
LIST = 40  # names in a list that is joined as it is


def _bags(norm: DataFrame) -> DataFrame:
    """(entity_id, cty, bag): sorted words of each name that has any."""
    bag = F.sort_array(tx.tokens(F.coalesce(F.col("norm_name"), F.lit(""))))
    return norm.select("entity_id", tx.fold_country(F.col("country")).alias("cty"), bag.alias("bag")).where(F.size("bag") > 0)


def weighted_names(bags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct names (did, cty, bag, first, terms of term, w and lists) and word lists (cty, term, lists).

    ``w`` is what a word adds to the score, ``lists`` the number of distinct names with it.
    """
    names = bags.groupBy("cty", "bag").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("first"))
    names = written(names, "bm25-names")
    stats = names.groupBy("cty").agg(F.sum("n").alias("n_docs"), (F.sum(F.col("n") * F.size("bag")) / F.sum("n")).alias("avgdl"))
    words = names.select("cty", "bag", "n", "first", F.explode(F.array_distinct("bag")).alias("term"))
    lists = written(words.groupBy("cty", "term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("lists")), "bm25-words")
    idf = lists.join(stats, "cty").withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    tf = F.size(F.filter("bag", lambda x: x == F.col("term")))
    w = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("bag") / F.col("avgdl")))
    weighted = (words.join(idf, ["cty", "term"]).withColumn("w", w).groupBy("cty", "bag", "first")
                .agg(F.sort_array(F.collect_list(F.struct("term", "w", "lists"))).alias("terms")))
    return written(weighted.withColumn("did", F.monotonically_increasing_id()), "bm25-weights"), lists.select("cty", "term", "lists")


def distinct_queries(bags: DataFrame, lists: DataFrame) -> DataFrame:
    """(qid, cty, query, terms of term and lists): distinct sets of words, without the words that no target has."""
    queries = bags.select("cty", F.array_distinct("bag").alias("query")).distinct()
    known = queries.withColumn("term", F.explode("query")).join(lists, ["cty", "term"])
    known = known.groupBy("cty", "query").agg(F.sort_array(F.collect_list(F.struct("term", "lists"))).alias("terms"))
    return written(known.withColumn("qid", F.monotonically_increasing_id()), "bm25-queries")


def _extended(level: int, keys: str) -> Column:
    """Keys of one word more, from sorted keys (key, w, last_w) that have all words but the last in common."""
    head = lambda x: F.slice(x["key"], 1, level - 1)
    last = lambda x: F.element_at(x["key"], level)
    return F.flatten(F.transform(keys, lambda a: F.transform(
        F.filter(keys, lambda b: (head(a) == head(b)) & (last(b) > last(a))),
        lambda b: F.struct(F.concat(a["key"], F.array(last(b))).alias("key"),
                           (a["w"] + b["last_w"]).alias("w"), b["last_w"].alias("last_w")))))


def _next_level(rows: DataFrame, by: list[str], level: int) -> DataFrame:
    grouped = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("key", "w", "last_w"))).alias("keys"))
    return grouped.where(F.size("keys") > 1).select(*by, F.explode(_extended(level, "keys")).alias("x")).select(*by, "x.*")


def candidate_names(names: DataFrame, queries: DataFrame, k: int, longest: int = LIST) -> DataFrame:
    """(qid, did): for each query all names that can be among its K best ones, and few others."""
    d = names.select("did", "cty", "first", F.explode("terms").alias("t")) \
        .select("did", "cty", "first", F.array("t.term").alias("key"), F.col("t.w").alias("w"), F.col("t.w").alias("last_w"), "t.lists")
    q = queries.select("qid", "cty", F.explode("terms").alias("t")) \
        .select("qid", "cty", F.array("t.term").alias("key"), F.lit(0.0).alias("w"), F.lit(0.0).alias("last_w"), "t.lists")
    found, level = [], 1
    while True:
        best = F.row_number().over(Window.partitionBy("cty", "key").orderBy(F.desc(F.round("w", 6)), "first"))
        long = d.where(F.col("lists") > longest)
        lists = d.where(F.col("lists") <= longest).select("cty", "key", "did") \
            .unionByName(long.withColumn("_r", best).where(F.col("_r") <= k).select("cty", "key", "did"))
        found.append(written(q.select("cty", "key", "qid").join(lists, ["cty", "key"]).select("qid", "did"), "bm25-found"))
        q = written(_next_level(q.where(F.col("lists") > longest), ["qid", "cty"], level), "bm25-query-keys")
        if q.isEmpty():
            break
        wanted = written(q.select("cty", "key").distinct(), "bm25-keys")
        d = written(_next_level(long, ["did", "cty", "first"], level).join(wanted, ["cty", "key"], "left_semi"), "bm25-name-keys")
        sizes = d.groupBy("cty", "key").agg(F.count(F.lit(1)).alias("lists"))
        d, q = (written(x.join(sizes, ["cty", "key"]), "bm25-sized") for x in (d, q))
        level += 1
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every.distinct()


def bm25_topk(norm_s1: DataFrame, norm_targets: DataFrame, k: int = 10, longest: int = LIST) -> DataFrame:
    """(s1_id, cand_id, bm25, rank): the ``k`` best targets of the same country for each S1 name.

    idf = ln(1 + (N - df + 0.5)/(df + 0.5)), k1 = 1.2, b = 0.75, statistics by
    country over all targets; scores are rounded to 6 places, ties go by id.
    Targets that share no word with a name are no result. Names without words,
    null ones too, neither find nor are found; a null country is a country of its own.
    """
    bags, asked = _bags(norm_targets), _bags(norm_s1)
    names, lists = weighted_names(bags)
    queries = distinct_queries(asked, lists)
    pairs = candidate_names(names, queries, k, longest)
    scored = (pairs.join(names.select("did", "first", "terms"), "did")
              .join(queries.select("qid", F.col("terms.term").alias("words")), "qid")
              .withColumn("bm25", F.round(F.aggregate(F.filter("terms", lambda t: F.array_contains("words", t["term"])),
                                                      F.lit(0.0), lambda s, t: s + t["w"]), 6)))
    order = Window.partitionBy("qid").orderBy(F.desc("bm25"), "first")
    best = scored.select("qid", "did", "bm25", "first").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    ids = bags.withColumn("_r", F.row_number().over(Window.partitionBy("cty", "bag").orderBy("entity_id"))).where(F.col("_r") <= k)
    members = names.select("did", "cty", "bag").join(ids, ["cty", "bag"]).select("did", F.col("entity_id").alias("cand_id"))
    ranked = (best.select("qid", "did", "bm25").join(members, "did")
              .withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bm25"), "cand_id")).cast("long"))
              .where(F.col("rank") <= k))
    of = asked.select(F.col("entity_id").alias("s1_id"), "cty", F.array_distinct("bag").alias("query")) \
        .join(queries.select("qid", "cty", "query"), ["cty", "query"]).select("s1_id", "qid")
    return of.join(ranked, "qid").select("s1_id", "cand_id", "bm25", "rank")
