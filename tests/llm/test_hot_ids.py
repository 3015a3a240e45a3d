"""Rows without an id."""

from matchbook.llm import mixing


def test_rows_without_an_id_spread(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "a") for i in range(500)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs, epochs=3.0).collect()
    assert len(rows) % 500 == 0 and len({(r.shuffle_key, r.copy) for r in rows}) == len(rows)
