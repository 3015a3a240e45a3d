"""Character n-gram cosine retrieval over all targets of the country.

Names are vectors of TF-IDF weights of their character 2- to 4-grams (tf in the
name, idf = ln((1+N)/(1+df)) + 1 over all records), of length 1. For each
S1 name the K targets with the largest cosine of ``FLOOR`` or more are returned.

Prefix filter: grams are ordered by document frequency, rarest first. The prefix
of a name ends where the grams that follow have a norm below ``FLOOR`` together.
If the rarest gram that two names share lies behind the prefix of one of them,
all they share does, and their cosine is below ``FLOOR``; so names that reach it
share a gram of both prefixes. Only those prefixes are indexed and joined; the
cosine is then computed from the whole vectors.

Scale: distinct names are joined, of a name of very many targets the first K ids
count. The frequent grams, which make quadratic posting lists, stand at the end
and lie outside the prefixes unless a name consists of them; AQE splits the
join of a gram that many prefixes have. Vectors meet in chunks of names, each once
a chunk (``name_cosines``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.functions import pairwise as pw
from matchbook.functions import text as tx
from matchbook.session import ship_package, written

FLOOR = 0.6
CHUNK = 20_000  # names that are compared in one task
LOT = 1 << 18   # pairs at once
SIZES = (2, 3, 4)


def gram_array(name: Column) -> Column:
    """All 2- to 4-grams of a name, repeated ones as often as they stand."""
    length = F.length(name)

    def of_size(n: int) -> Column:  # a lambda of one argument: transform passes the index to a second one
        return F.when(length >= n, F.transform(F.sequence(F.lit(1), length - n + 1), lambda i: name.substr(i, F.lit(n)))) \
            .otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of_size(n) for n in SIZES]))


def gram_vectors(norm: DataFrame) -> DataFrame:
    """(nid, name, grams, weights, cut): distinct names with grams by number, the rarest first; the first ``cut`` are the prefix."""
    names = norm.select(F.col("norm_name").alias("name")).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    names = written(names.withColumn("nid", F.monotonically_increasing_id()), "gram-names")
    total = norm.count()
    tf = names.select("nid", "n", F.explode(gram_array(F.col("name"))).alias("gram")).groupBy("nid", "n", "gram").agg(F.count(F.lit(1)).alias("tf"))
    grams = tf.groupBy("gram").agg(F.sum("n").alias("df"))
    grams = written(grams.withColumn("gid", F.monotonically_increasing_id()), "grams")
    weighted = tf.join(grams, "gram").withColumn("w", F.col("tf") * (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1))
    vectors = weighted.groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("df", "gid", "w"))).alias("x"),
                                          F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    square = lambda s, x: s + x["w"] * x["w"] / F.col("norm") / F.col("norm")
    # the squared norm from place i on; rounding must not shorten a prefix
    behind = lambda x, i: F.aggregate(F.slice("x", i + 1, F.size("x")), F.lit(0.0), square) >= FLOOR * FLOOR - 1e-9
    return written(vectors.select("nid", F.col("x.gid").alias("grams"),
                                  F.transform("x", lambda x: x["w"] / F.col("norm")).alias("weights"),
                                  F.size(F.filter("x", behind)).alias("cut")).join(names.select("nid", "name"), "nid"), "gram-vectors")


def cosines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dot products of all pairs of a batch at once: equal (pair, gram) of both sides meet."""
    for batch in batches:
        sides = []
        for grams, weights in (("qg", "qw"), ("dg", "dw")):
            ends = batch.column(grams).offsets.to_numpy()
            sides.append((np.repeat(np.arange(len(batch)), np.diff(ends)), batch.column(grams).flatten().to_numpy(),
                          batch.column(weights).flatten().to_numpy()))
        (pq, gq, wq), (pd, gd, wd) = sides
        _, number = np.unique(np.concatenate([gq, gd]), return_inverse=True)
        width = int(number.max(initial=0)) + 1
        _, a, b = np.intersect1d(pq * width + number[:len(gq)], pd * width + number[len(gq):], assume_unique=True, return_indices=True)
        cosine = np.bincount(pq[a], wq[a] * wd[b], len(batch))
        yield pa.RecordBatch.from_arrays([batch.column("qn"), batch.column("dn"), pa.array(cosine)], ["qn", "dn", "cosine"])


def _met_cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, nid, grams, weights, taken), the names of a chunk by number and then those that ask for some of them, to (qn, dn, cosine)."""
    chunk, names = None, []
    for batch in batches:
        chunks, asks = batch.column("chunk").to_numpy(), batch.column("taken").is_valid().to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero(np.append(True, (np.diff(chunks) != 0) | (np.diff(asks.astype(int)) != 0))), len(batch)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if chunks[low] != chunk:
                chunk, names = chunks[low], []
            if not asks[low]:
                names.append(batch.slice(low, high - low))
                continue
            rows = pa.Table.from_batches([*names, batch.slice(low, high - low)])
            known = sum(map(len, names))
            nid, taken = rows.column("nid").to_numpy(), batch.column("taken").slice(low, high - low)
            sets, weights = pw.Sets.of_lists(rows.column("grams").combine_chunks()), rows.column("weights").combine_chunks().flatten().to_numpy()
            wanted = taken.flatten().to_numpy()
            a = np.repeat(np.arange(known, known + high - low), pc.list_value_length(taken).to_numpy())
            for start in range(0, len(a), LOT):
                q, dn = a[start:start + LOT], wanted[start:start + LOT]
                cosine = pw.dot(sets, q, np.searchsorted(nid[:known], dn), weights)
                good = cosine > FLOOR - 1e-3  # what is certainly below FLOOR is not sent back
                yield pa.RecordBatch.from_arrays([pa.array(nid[q[good]]), pa.array(dn[good]), pa.array(cosine[good])], ["qn", "dn", "cosine"])


def name_cosines(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(qn, dn, tfidf_cosine)`` of the pairs of names that may reach ``FLOOR``, each once, six places.

    Names are dealt to chunks; a vector goes once to a chunk, with the numbers of the names that are asked there, not once a pair.
    """
    ship_package(vectors.sparkSession)
    chunks = max(vectors.count() // CHUNK + 1, vectors.sparkSession.sparkContext.defaultParallelism)
    of = lambda n: F.pmod(F.xxhash64(n), F.lit(chunks)).cast("int").alias("chunk")
    taken = pairs.groupBy("qn", of("dn")).agg(F.collect_set("dn").alias("taken"))
    asking = taken.join(vectors, taken.qn == vectors.nid).select("chunk", "nid", "grams", "weights", "taken")
    found = vectors.join(pairs.select(F.col("dn").alias("nid")).distinct(), "nid", "left_semi") \
        .select(of("nid"), "nid", "grams", "weights", F.lit(None).cast("array<long>").alias("taken"))
    rows = found.unionByName(asking).repartition(chunks, "chunk").sortWithinPartitions("chunk", F.col("taken").isNotNull(), "nid")
    return rows.mapInArrow(_met_cosines, "qn bigint, dn bigint, cosine double") \
        .select("qn", "dn", F.round("cosine", 6).alias("tfidf_cosine"))


def gram_topk(norm_s1: DataFrame, norm_targets: DataFrame, norm: DataFrame, k: int = 10) -> DataFrame:
    """(s1_id, cand_id, tfidf_cosine, rank): cosines are rounded to six places, ties go by id.

    ``norm`` has all records, whose names the idf comes from. Names that are
    null or shorter than two characters neither find nor are found.
    """
    ship_package(norm.sparkSession)
    vectors = gram_vectors(norm)
    side = lambda df: df.select("entity_id", tx.fold_country(F.col("country")).alias("cty"), F.col("norm_name").alias("name")) \
        .join(vectors.select("nid", "name"), "name")
    asked, targets = (written(side(df), "gram-records") for df in (norm_s1, norm_targets))
    prefixes = vectors.select("nid", F.explode(F.slice("grams", F.lit(1), F.col("cut"))).alias("gram"))
    q, d = (df.select("cty", "nid").distinct().join(prefixes, "nid") for df in (asked, targets))
    met = q.select("cty", "gram", F.col("nid").alias("qn")).join(d.select("cty", "gram", F.col("nid").alias("dn")), ["cty", "gram"])
    pairs = written(met.select("cty", "qn", "dn").distinct(), "gram-pairs")
    cosines = name_cosines(vectors, pairs).where(F.col("tfidf_cosine") >= FLOOR)
    good = written(pairs.join(cosines, ["qn", "dn"]), "gram-cosines")
    ids = targets.withColumn("_r", F.row_number().over(Window.partitionBy("cty", "nid").orderBy("entity_id"))).where(F.col("_r") <= k) \
        .select("cty", F.col("nid").alias("dn"), F.col("entity_id").alias("cand_id"))
    first = good.join(ids.groupBy("cty", "dn").agg(F.min("cand_id").alias("first")), ["cty", "dn"])
    best = Window.partitionBy("cty", "qn").orderBy(F.desc("tfidf_cosine"), "first")
    first = first.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("cty", "qn", "dn", "tfidf_cosine")
    order = Window.partitionBy("cty", "qn").orderBy(F.desc("tfidf_cosine"), "cand_id")
    ranked = first.join(ids, ["cty", "dn"]).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return asked.select(F.col("entity_id").alias("s1_id"), "cty", F.col("nid").alias("qn")).join(ranked, ["cty", "qn"]) \
        .select("s1_id", "cand_id", "tfidf_cosine", "rank")
