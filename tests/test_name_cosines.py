"""Names are compared in chunks, with the cosines that each pair alone has."""

from pyspark.sql import functions as F

from matchbook.operators import grams as gr

NAMES = ["oak mill", "oak mills", "mill oak", "elm press", "elm pres", "oak", "zz top", "ab", "oak mill works", "oak mill work"] + [f"oak mill {i}" for i in range(30)]


def made(spark):
    norm = spark.createDataFrame([(f"S1-{i}", n, "US") for i, n in enumerate(NAMES)], "entity_id string, norm_name string, country string")
    vectors = gr.gram_vectors(norm)
    ids = vectors.select("nid")
    every = ids.select(F.col("nid").alias("qn")).crossJoin(ids.select(F.col("nid").alias("dn")))
    return vectors, every.unionByName(every)


def test_cosines_of_chunks_are_those_of_pairs(spark, monkeypatch):
    vectors, pairs = made(spark)
    of = lambda p: vectors.select(F.col("nid").alias(f"{p}n"), F.col("grams").alias(f"{p}g"), F.col("weights").alias(f"{p}w"))
    both = pairs.distinct().join(of("q"), "qn").join(of("d"), "dn").select("qn", "dn", "qg", "qw", "dg", "dw")
    want = {(r.qn, r.dn): round(r.cosine, 5) for r in both.mapInArrow(gr.cosines_of, "qn bigint, dn bigint, cosine double").collect() if r.cosine >= gr.FLOOR}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for chunk, lot, batch in ((20_000, 1 << 18, 10_000), (5, 7, 3)):
        monkeypatch.setattr(gr, "CHUNK", chunk)
        monkeypatch.setattr(gr, "LOT", lot)
        spark.conf.set(key, batch)
        try:
            got = [(r.qn, r.dn, round(r.tfidf_cosine, 5)) for r in gr.name_cosines(vectors, pairs).where(f"tfidf_cosine >= {gr.FLOOR}").collect()]
        finally:
            spark.conf.set(key, before)
        assert len(got) == len(want) > len(NAMES) and {(q, d): c for q, d, c in got} == want


def test_a_vector_is_not_sent_once_a_pair(spark):
    """Each name comes to its chunk once, and once a chunk that it asks, whatever the number of its pairs."""
    vectors, pairs = made(spark)
    read = spark.sparkContext.accumulator(0)
    seen = gr._met_cosines

    def counted(batches):
        def each():
            for b in batches:
                read.add(len(b))
                yield b
        return seen(each())

    gr._met_cosines, was = counted, gr._met_cosines
    try:
        gr.name_cosines(vectors, pairs).count()
    finally:
        gr._met_cosines = was
    chunks = spark.sparkContext.defaultParallelism
    assert read.value <= len(NAMES) * (1 + chunks) < len(NAMES) ** 2
