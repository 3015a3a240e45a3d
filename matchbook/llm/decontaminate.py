"""Operator 2: benchmark decontamination by n-gram windows.

The benchmark's normalised windows become a broadcast hash index. Documents
stream past it: words are mapped to the benchmark's vocabulary, the rolling
hashes of all windows of known words are looked up, and a hit is verified word
by word. Spans or whole documents are then removed.

Scale: documents are scanned, not shuffled. The index comes in blocks of at
most ``BLOCK_CHARS`` characters of benchmark text; a usual benchmark is one
block. With more blocks the documents are scanned once a block, each scan
keeps only hits (one row a distinct contaminated text), and these few rows are
merged by text digest and joined back.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.llm.common import map_arrow, without, written

NGRAM = 10
BLOCK_CHARS = 16_000_000
CHUNK_BYTES = 4_000_000
ADDED = ("n_words", "n_hit", "hit_spans", "hit_items", "n_items", "items_sha256", "contaminated", "clean_text")

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
# A-Z to a-z, bytes outside words to a space; UTF-8 sequences pass unchanged
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD_BYTES else 0x20 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_NEXT_TEXT = b"\x01"  # no word: marks the border of two texts
_HITS = "array<struct<start:int,end:int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WindowIndex:
    """Distinct windows of the items, by length; built from (item id, text) pairs."""

    def __init__(self, items: list[tuple[str, bytes]], ngram: int):
        self.vocabulary: dict[bytes, int] = {_NEXT_TEXT: 0}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            size = min(ngram, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                windows.setdefault(tuple(ids[i:i + size]), set()).add(item)
        self.items: list[list[str]] = []
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({len(w) for w in windows}):
            own = [w for w in windows if len(w) == size]
            table = np.array(own, np.int64)
            keys = rolling_hash(table.ravel(), size)[::size]
            order = np.argsort(keys, kind="stable")
            numbers = np.arange(len(self.items), len(self.items) + len(own))
            self.items.extend(sorted(windows[w]) for w in own)
            self.by_size[size] = keys[order], table[order], numbers[order]

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, size and window number of every occurrence in a stream of word ids."""
        unknown = np.concatenate([[0], np.cumsum(ids <= 0)])
        found = []
        for size, (keys, table, numbers) in self.by_size.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            key = rolling_hash(ids, size)[at]
            first = np.searchsorted(keys, key, "left")
            last = np.searchsorted(keys, key, "right")
            while len(at := at[keep := first < last]):  # equal keys: usually a single window
                first, last = first[keep], last[keep]
                same = (table[first] == ids[at[:, None] + np.arange(size)]).all(axis=1)
                found.append((at[same], np.full(int(same.sum()), size), numbers[first[same]]))
                first = first + 1
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


def rolling_hash(ids: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each run of ``size`` ids, modulo 2**64."""
    ids = ids.astype(np.uint64)
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k:len(ids) - size + 1 + k]
    return out ^ (out >> np.uint64(29))


def _scan_texts(index: WindowIndex, texts: list[bytes]) -> list[tuple[int, list, list]]:
    """(words, merged hit spans, items) of each text."""
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) + 1 for w in split])
    stream = np.concatenate([index.ids(w) if w else np.zeros(0, np.int64) for w in
                             (x for words in split for x in (words, [_NEXT_TEXT]))])
    at, size, window = index.hits(stream)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out: list[tuple[int, list, list]] = [(len(w), [], []) for w in split]
    if not len(at):
        return out
    order = np.argsort(at, kind="stable")
    at, size, window = at[order], size[order], window[order]
    text_of = np.searchsorted(begins, at, "right") - 1
    for i in np.unique(text_of):
        own = text_of == i if len(texts) < 8 else slice(*np.searchsorted(text_of, [i, i + 1]))
        spans: list[list[int]] = []
        for s, e in zip((at[own] - begins[i]).tolist(), (at[own] + size[own] - begins[i]).tolist()):
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(e, spans[-1][1])
            else:
                spans.append([s, e])
        items = sorted({x for w in np.unique(window[own]).tolist() for x in index.items[w]})
        out[i] = len(split[i]), [{"start": s, "end": e} for s, e in spans], items
    return out


_INDEX: dict[str, WindowIndex] = {}


def _index_of(name: str, items: list[tuple[str, bytes]], ngram: int) -> WindowIndex:
    """The block's index, built once a worker process; the one before is let go."""
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = WindowIndex(items, ngram)
    return _INDEX[name]


def _scanner(shared, ngram: int, only_hits: bool):
    """Append n_words, hit_spans and hit_items to every batch."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = _index_of(name, shared.value, ngram)
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            rows, start, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= CHUNK_BYTES or i == len(texts) - 1:
                    rows += _scan_texts(index, texts[start:i + 1])
                    start, size = i + 1, 0
            out = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                 pa.array([r[2] for r in rows], pa.list_(pa.string()))],
                names=[*batch.schema.names, "n_words", "hit_spans", "hit_items"])
            if only_hits:
                out = out.filter(pa.array([bool(r[1]) for r in rows], pa.bool_())).drop_columns(["text"])
            yield out
    return run


def _blocks(items: DataFrame, n: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in ``n`` blocks, dealt by a hash of the item."""
    for b in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield [(r["item"], r["text"].encode()) for r in own.sort("item", "text").toLocalIterator()]


def _merge(spans: Column) -> Column:
    """Union of spans, sorted."""
    start = F.array().cast(_HITS)
    return F.aggregate(F.array_sort(spans), start, lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))["end"], F.lit(-1)) >= x["start"]),
        F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"),
            F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))))


def find_contamination(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM,
                       block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Add to every document: n_words, n_hit, n_items (long), hit_spans
    (merged word ranges), hit_items, items_sha256 and contaminated.

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered. A
    window is ``ngram`` consecutive words of an item, or all words of a
    shorter one; an item without words has none. A null text has no words. An
    item whose id is null counts under the empty id, items with the same id
    are one. Repeated documents are judged alike; an empty benchmark hits
    nothing. Input columns with the names of added ones are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, ADDED)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text") \
        .where(F.col("text").isNotNull()).distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-chars // block_chars))
    schema = lambda df: T.StructType([*df.schema.fields, *_ADDED_FIELDS])
    if n_blocks == 1:
        shared = spark.sparkContext.broadcast(next(_blocks(items, 1)))
        found = map_arrow(docs, _scanner(shared, ngram, False), schema(docs))
    else:
        texts = docs.select("text", F.sha2("text", 256).alias("__digest"))
        parts = []
        for block in _blocks(items, n_blocks):
            shared = spark.sparkContext.broadcast(block)
            scanned = map_arrow(texts, _scanner(shared, ngram, True), T.StructType(
                [T.StructField("__digest", T.StringType()), *_ADDED_FIELDS]))
            one = scanned.groupBy("__digest").agg(F.first("hit_spans").alias("s"), F.first("hit_items").alias("i"))
            parts.append(written(one, "hits"))
            shared.unpersist()
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.unionByName(p)
        merged = hits.groupBy("__digest").agg(
            _merge(F.flatten(F.collect_list("s"))).alias("hit_spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("i")))).alias("hit_items"))
        n_words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"),
                                  lambda w: w != ""))
        found = (docs.withColumn("__digest", F.sha2("text", 256)).join(merged, "__digest", "left")
                 .withColumn("n_words", n_words.cast("long"))
                 .withColumn("hit_spans", F.coalesce("hit_spans", F.array().cast(_HITS)))
                 .withColumn("hit_items", F.coalesce("hit_items", F.array().cast("array<string>"))).drop("__digest"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return (found.withColumn("n_hit", hit).withColumn("n_items", F.size("hit_items").cast("long"))
            .withColumn("items_sha256", F.sha2(F.array_join("hit_items", ","), 256))
            .withColumn("contaminated", F.col("n_hit") > 0))


_ADDED_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()),
                                                         T.StructField("end", T.IntegerType())]))),
    T.StructField("hit_items", T.ArrayType(T.StringType()))]


def remove_spans(text: str, spans: list) -> str:
    """Cut word ranges out of a text, with what stands between their words."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for span in spans:
        out.append(text[at:words[span["start"]][0]])
        at = words[span["end"] - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", ngram: int = NGRAM) -> DataFrame:
    """Remove what the benchmark contaminates; the columns of ``docs`` stay.

    ``documents`` drops every contaminated document, ``spans`` cuts the hit
    words out of its text and keeps it.
    """
    found = find_contamination(docs, benchmark, ngram)
    if remove == "documents":
        kept = found.where(~F.col("contaminated"))
    elif remove == "spans":
        @F.pandas_udf("string")
        def cut(text, spans):
            return text.combine(spans, lambda t, s: t if t is None or not len(s) else remove_spans(t, s))

        kept = found.withColumn("text", F.when(F.col("contaminated"), cut("text", "hit_spans")).otherwise(F.col("text")))
    else:
        raise ValueError("remove: documents or spans")
    return kept.drop(*[c for c in ADDED if c in found.columns])


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g FROM (
  SELECT item_id, w, least({NGRAM}, len(w)) AS n, unnest(range(1, len(w) - least({NGRAM}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
w AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN t USING (doc_id)
"""
