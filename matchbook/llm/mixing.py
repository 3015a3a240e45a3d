"""Operator 1: mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the wanted size
over its own size. Every document inverts a Poisson distribution of that mean
at a uniform number hashed from its id and the seed, is exploded into that
many copies, and all copies are dealt anew by a hash of (id, copy). Nothing is
random at run time, so a task that is run again draws the same counts.

Scale: one narrow aggregate (source, length), one small table of rates, one
shuffle of the text. The table of rates holds a row a source; it is broadcast
only if a count finds at most ``BROADCAST_SOURCES`` of them, otherwise joined
with the documents salted, so that a source with a third of all rows is spread
over ``SALTS`` tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.llm.common import without, written

BROADCAST_SOURCES = 50_000  # times about 100 bytes a row and its short table: some MB
SALTS = 64
MAX_MEAN = 16.0  # a larger mean is drawn as a sum of Poisson numbers of at most this mean
TERMS = 80  # P(X > 80) < 1e-30 at a mean of 16
ADDED = ("n_copies", "copy", "shuffle_key")


def uniform(*parts: Column) -> Column:
    """Hash to [0, 1) with 52 bits."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2 ** 52))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0,
                 size: Column | None = None) -> DataFrame:
    """(source, size, rate): mean copies of a document of each source.

    ``weights`` gives target shares in any unit; without it all sources get
    the same share. A source that ``weights`` leaves out has share 0. The
    wanted size is ``epochs`` times the size of all documents; ``size`` is
    characters unless given. A source of size 0 has rate 0.
    """
    size = F.length(F.coalesce(F.col("text"), F.lit(""))) if size is None else size
    sizes = docs.groupBy("source").agg(F.sum(size).cast("long").alias("size"))
    if weights is None:
        share = F.lit(1.0)
    else:
        pairs = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))]
        share = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
    shares = sizes.withColumn("share", F.when(F.col("size") > 0, share).otherwise(F.lit(0.0)))
    total = shares.agg(F.sum("size").alias("all_size"), F.sum("share").alias("all_share"))
    one = lambda c: total.select(c).scalar()
    rate = F.when((F.col("size") > 0) & (one("all_share") > 0),
                  F.lit(float(epochs)) * one("all_size") * F.col("share") / one("all_share") / F.col("size"))
    return shares.select("source", "size", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def _tables(rates: DataFrame) -> DataFrame:
    """Add the number of parts of the mean and the distribution of one part."""
    rates = (rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN)).cast("int"))
             .withColumn("mean", F.col("rate") / F.col("parts")))
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))
    grow = lambda s, k: F.struct(
        (s["p"] * F.col("mean") / k).alias("p"),
        F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * F.col("mean") / k)).alias("cdf"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, grow, lambda s: s["cdf"])
    # steps that no number below 1 reaches are left out
    return rates.withColumn("cdf", F.filter(cdf, lambda c: c < 1.0 - 2.0 ** -52)).select("source", "parts", "cdf")


def poisson_counts(docs: DataFrame, rates: DataFrame, seed: int = 0) -> DataFrame:
    """Add ``n_copies``: the inverted Poisson number of each document."""
    rates = written(_tables(rates), "rates").select(F.col("source").alias("__rate_source"), "parts", "cdf") \
        .withColumnsRenamed({"parts": "__parts", "cdf": "__cdf"})
    docs = without(docs, ["n_copies"])
    on = F.col("source").eqNullSafe(F.col("__rate_source"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rates), on)
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("__doc_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))) \
            .join(salted, on & (F.col("__salt") == F.col("__doc_salt")))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    draw = lambda part: F.size(F.filter(F.col("__cdf"), lambda c: c <= uniform(
        F.lit(str(seed)), part.cast("string"), key)))
    first = uniform(F.lit(str(seed)), F.lit("1"), key)
    one = F.size(F.filter(F.col("__cdf"), lambda c: c <= F.col("__u")))
    more = F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("__parts"))), F.lit(0),
                       lambda acc, part: acc + draw(part))
    return (joined.withColumn("__u", first)
            .withColumn("n_copies", one + F.when(F.col("__parts") > 1, more).otherwise(0))
            .drop("__rate_source", "__parts", "__cdf", "__salt", "__doc_salt", "__u"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0,
                seed: int = 0) -> DataFrame:
    """Replicate documents to the target weights and shuffle them globally.

    Adds ``n_copies`` (long), ``copy`` (long, from 1) and ``shuffle_key`` (32
    hex digits); input columns of these names are replaced. The rows of the
    result are dealt to partitions by shuffle_key and sorted by it there, so
    reading the partitions in turn gives a random order.

    A null source is a source like the others; a null text has size 0. Rows
    that share a doc_id draw the same number, as do all rows with a null one;
    rows with a null doc_id are ordered by their text, so that they spread.
    Documents whose number is 0 have no row. An empty table stays empty.
    """
    docs = without(docs, ADDED)
    counted = poisson_counts(docs, source_rates(docs, weights, epochs), seed)
    copies = (counted.where(F.col("n_copies") > 0)
              .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies")))))
    by_text = F.concat(F.lit("text "), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(
        "|", F.lit(str(seed)), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), by_text), F.col("copy"))))
    return (keyed.withColumn("copy", F.col("copy").cast("long")).withColumn("n_copies", F.col("n_copies").cast("long"))
            .repartition("shuffle_key").sortWithinPartitions("shuffle_key"))


ORACLE = f"""
WITH s AS (SELECT source, sum(length(coalesce(text, '')))::BIGINT AS size FROM documents GROUP BY source),
w AS (SELECT *, CASE WHEN size > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS share FROM s),
r AS (SELECT source, CASE WHEN size > 0 THEN (SELECT sum(size) FROM w)::DOUBLE * share / (SELECT sum(share) FROM w) / size ELSE 0.0 END AS rate FROM w),
m AS (SELECT source, greatest(1, ceil(rate / {MAX_MEAN}))::BIGINT AS parts, rate / greatest(1, ceil(rate / {MAX_MEAN})) AS mean FROM r),
p AS (SELECT source, k, CASE WHEN k = 0 THEN exp(-mean) WHEN mean = 0 THEN 0 ELSE exp(-mean + k * ln(mean) - lgamma(k + 1.0)) END AS p
      FROM m, (SELECT unnest(range(0, {TERMS + 1})) AS k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
d AS (SELECT doc_id, text, lang, d.source, n_chars, unnest(range(1, parts + 1)) AS part FROM documents d JOIN m ON d.source IS NOT DISTINCT FROM m.source),
u AS (SELECT *, ('0x' || substr(md5('0|' || part || '|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM d),
n AS (SELECT doc_id, text, lang, source, n_chars,
        sum((SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM u.source AND c <= u.u AND c < 1 - power(2.0, -52)))::BIGINT AS n_copies
      FROM u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy, md5('0|order|' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) || '|' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM n WHERE n_copies > 0)
"""
