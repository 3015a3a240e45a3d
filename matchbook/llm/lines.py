"""Operator 12: line deduplication by document counts of hashed lines.

Every text is split at line feeds. A line's key is the line without ASCII
white space at its ends, A-Z lowered. Keys of ``MIN_CHARS`` code points or more
that stand in ``MIN_DOCS`` documents or more lose all their lines, except in the
largest document that holds them; the other lines are put together again in
their order.

Scale: one scan explodes the texts to their distinct keys, 128 bits of hash and
the document. Documents per key are counted by two aggregates, both combined
within map tasks, so a line that stands in a third of all documents is one
partial count a task. The keys over the threshold are joined with the written
hashes (AQE splits a very frequent key) and grouped by document, which its own
number of lines bounds; the texts themselves are shuffled once, by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.llm.common import map_arrow, without, written

MIN_CHARS = 40
MIN_DOCS = 5
ROWS = 100_000  # hashes in an Arrow batch
ADDED = ("n_lines", "n_dropped")

_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_CONTINUES = bytes(range(0x80, 0xC0))  # bytes that begin no code point


def keys_of(text: bytes, min_chars: int) -> list[bytes | None]:
    """The 128-bit hash of each line's key; None for lines with shorter keys."""
    from xxhash import xxh3_128_digest

    out = []
    for line in text.translate(_LOWER).split(b"\n"):
        key = line.strip(_SPACE)
        long = len(key) >= min_chars and (key.isascii() or len(key.translate(None, _CONTINUES)) >= min_chars)
        out.append(xxh3_128_digest(key) if long else None)
    return out


def _explode(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, owns = [], [], []

        def flush() -> pa.RecordBatch:
            both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])),
                 pa.array(docs, pa.int64()), pa.array(owns, pa.int64())], ["ha", "hb", "doc", "own"])

        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, doc, own in zip(texts, batch.column("doc").to_pylist(), batch.column("own").to_pylist()):
                found = set(keys_of(text or b"", min_chars)) - {None}
                hashes.extend(found)
                docs.extend([doc] * len(found))
                owns.extend([own] * len(found))
                if len(hashes) >= ROWS:
                    yield flush()
                    hashes, docs, owns = [], [], []
        if hashes:
            yield flush()
    return run


def _drop(names: list[str], min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            drops = zip(batch.column("drop_a").to_pylist(), batch.column("drop_b").to_pylist())
            for text, (a, b) in zip(batch.column("text").cast(pa.binary()).to_pylist(), drops):
                lines = (text or b"").split(b"\n")
                n_lines.append(len(lines))
                kept = lines
                if a:
                    gone = {x.tobytes() for x in np.stack([np.array(a, "<i8"), np.array(b, "<i8")], axis=1)}
                    kept = [x for x, key in zip(lines, keys_of(text or b"", min_chars)) if key not in gone]
                n_dropped.append(len(lines) - len(kept))
                texts.append(text if text is None else b"\n".join(kept))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                             names=[*names, *ADDED])
    return run


def _identity() -> tuple[Column, Column]:
    """doc_id, and for rows without one a hash of the text, else 0."""
    doc = F.col("doc_id").cast("long")
    return doc, F.when(doc.isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(ha, hb, doc, own) of all distinct keys in documents, and (fa, fb, keep_doc, keep_own) of those in too many."""
    doc, own = _identity()
    found = written(map_arrow(docs.select(doc.alias("doc"), own.alias("own"), "text"), _explode(min_chars),
                              "ha bigint, hb bigint, doc bigint, own bigint"), "lines")
    frequent = (found.distinct().groupBy("ha", "hb")
                .agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("doc"), F.max("own").alias("own"))
                .where(F.col("n") >= min_docs)
                .select(F.col("ha").alias("fa"), F.col("hb").alias("fb"), F.col("doc").alias("keep_doc"),
                        F.when(F.col("doc").isNull(), F.col("own")).otherwise(F.lit(0).cast("long")).alias("keep_own")))
    return found, written(frequent, "frequent")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Replace ``text`` by its kept lines joined by line feeds; add n_lines (before) and n_dropped.

    Every row stays. A null text stays null and counts as one empty line, as
    does an empty one; a text that loses all lines becomes empty. Rows that
    share a doc_id are one document, in which a kept key keeps all its lines;
    rows without a doc_id are one document for each different text and come
    before all ids. Input columns with the added names are replaced, an empty
    table stays empty.
    """
    docs = without(docs, ADDED)
    found, frequent = frequent_lines(docs, min_docs, min_chars)
    later = found.join(frequent, (F.col("ha") == F.col("fa")) & (F.col("hb") == F.col("fb"))) \
        .where(~(F.col("doc").eqNullSafe(F.col("keep_doc")) & (F.col("own") == F.col("keep_own"))))
    pairs = later.groupBy("doc", "own").agg(F.collect_set(F.struct("ha", "hb")).alias("x")) \
        .select(F.col("doc").alias("drop_doc"), F.col("own").alias("drop_own"),
                F.col("x.ha").alias("drop_a"), F.col("x.hb").alias("drop_b"))
    names = ["text" if c.lower() == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    doc, own = _identity()
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], doc.alias("doc"), own.alias("own"))
    joined = rows.join(pairs, F.col("doc").eqNullSafe(F.col("drop_doc")) & (F.col("own") == F.col("drop_own")), "left")
    narrow = joined.select(*names, "drop_a", "drop_b")
    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)],
                           *[T.StructField(c, T.LongType()) for c in ADDED]])
    return map_arrow(narrow, _drop(names, min_chars), schema).toDF(*docs.columns, *ADDED)


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT rid, doc_id, pos, line, translate(trim(line, {_STRIP}), {_AZ}) AS key FROM l),
f AS (SELECT key, max(doc_id) AS keep_doc FROM k WHERE length(key) >= {MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.rid, k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keep_doc AS gone
      FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""
