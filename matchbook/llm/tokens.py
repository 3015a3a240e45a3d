"""Operator 7: token ids in wavelet-matrix shards.

Documents are range-partitioned and sorted by doc_id, encoded, and cut into
shards of about a million ids at document boundaries. A shard is one row of a
Parquet file: the wavelet matrix (alphabet, bit planes, rank directories) and
the documents' ids and lengths. Parquet is only the container: its committer
makes the write safe against lost executors, and the files can be in any
store that Spark reaches.

Scale: one range exchange of the text; a task holds one batch and one shard at
a time. Offsets need no pass over the tokens: a shard knows how many ids of
its own partition come before it, and the partitions' totals are one row a
partition.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice
from operator import attrgetter
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.llm.common import map_arrow, scratch_path
from matchbook.llm.wavelet import WaveletMatrix

SHARD_IDS = 1 << 20
CHUNK_CHARS = 1 << 21
CACHED_PIECES = 1_000_000  # of one dictionary and a chunk; some 150 MB in a worker
END_ID = 2
_ID = attrgetter("id")
_WORD_AND_MARK = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,]?)")
SHARD_SCHEMA = """part int, shard int, part_start bigint, n_ids bigint, n_docs bigint, doc_ids array<bigint>,
  doc_lengths array<bigint>, alphabet binary, zeros array<bigint>, planes array<binary>, directory array<binary>"""
DOCS_SCHEMA = "doc_id bigint, part int, shard int, local_start bigint, n_tokens bigint, ids_crc32 bigint"


def _byte_points() -> np.ndarray:
    """Byte-level alphabet: a byte that is no visible Latin-1 character is written as U+0100 and up."""
    points = np.arange(256, dtype="<u4")
    visible = np.zeros(256, bool)
    for first, end in ((0x21, 0x7F), (0xA1, 0xAD), (0xAE, 0x100)):
        visible[first:end] = True
    points[~visible] = 0x100 + np.arange((~visible).sum(), dtype="<u4")
    return points


_BYTE_POINTS = _byte_points()


def _spelt(text: str) -> str:
    return _BYTE_POINTS[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")


class _Pieces(dict):
    """Ids of the pieces of lines as little-endian 32-bit bytes; None for one with white space or empty.

    A new piece is encoded when it is first looked up: a Latin word, which is
    a single pre-token, by the library's BPE model, a word with a full stop or
    comma as that word and its mark, others as a text. The dictionary has two
    halves: when the newer one is full it becomes the older one, from which
    pieces in use come back.
    """

    def __init__(self, encoder: PieceEncoder, lead: str):
        super().__init__()
        self.encoder, self.lead, self.spelt_lead = encoder, lead, _spelt(lead)
        self.older: dict[str, bytes | None] = {}

    def make_room(self) -> None:
        if len(self) >= CACHED_PIECES // 2:
            self.older = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes | None:
        self[piece] = ids = self.older[piece] if piece in self.older else self._ids(piece)
        return ids

    def _ids(self, piece: str) -> bytes | None:
        ascii_ = piece.isascii()
        if ascii_ and piece.isalpha() or (m := _WORD_AND_MARK.fullmatch(piece)) and not m[2]:
            ids = [*map(_ID, self.encoder.model.tokenize(self.spelt_lead + (piece if ascii_ else _spelt(piece))))]
            return pack(f"<{len(ids)}I", *ids)
        if m:
            return self[m[1]] + self.encoder.mark[m[2]]
        return self.encoder.whole(self.lead + piece) if piece.split() == [piece] else None


class PieceEncoder:
    """Encodes texts with a byte-level BPE tokenizer of the public library.

    Its pre-tokenizer always cuts before a single space and around a single
    newline, and between a Latin word and a full stop or comma at the end of a
    piece. So a text without other or adjacent white space is the
    concatenation of the space-separated pieces of its lines, and each distinct
    piece is encoded once; other texts are encoded whole, and so are texts with
    the string of an added token, which the library cuts out before all else.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.model = self.tokenizer.model
        self.newline = self.whole("\n")
        self.mark = {c: self.whole(c) for c in ".,"}
        self.first, self.later = _Pieces(self, ""), _Pieces(self, " ")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        self.first.make_room()
        self.later.make_room()
        head, tail = self.first, self.later.__getitem__
        out = []
        for text in texts:
            try:
                ids = None if self.added(text) else self.newline.join(
                    [b"".join([head[p[0]], *map(tail, islice(p, 1, None))]) for p in (line.split(" ") for line in text.split("\n"))])
            except TypeError:  # a piece without ids
                ids = None
            out.append(self.whole(text) if ids is None else ids)
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder_of(path: str) -> PieceEncoder:
    """One encoder a worker process: what it has learnt serves all its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _chunks(texts: list[str], chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _shards(path: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(path)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        docs: list = []
        raw: list[bytes] = []
        held = shard = before = 0

        def flush():
            nonlocal held, shard, before
            ids = np.frombuffer(b"".join(raw), "<u4")
            row = WaveletMatrix.build(ids).parts() | {
                "part": part, "shard": shard, "part_start": before, "n_docs": len(docs),
                "doc_ids": list(docs), "doc_lengths": [len(r) // 4 for r in raw]}
            shard, before, held = shard + 1, before + len(ids), 0
            docs.clear()
            raw.clear()
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in _chunks(texts):
                for doc, encoded in zip(ids[a:b], encoder.encode(texts[a:b])):
                    docs.append(doc)
                    raw.append(encoded + end)
                    held += len(encoded) // 4 + 1
                    if held >= shard_ids:
                        yield flush()
        if docs:
            yield flush()

    return run


_ARROW = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()),
    ("n_docs", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())),
    ("alphabet", pa.binary()), ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())),
    ("directory", pa.list_(pa.binary()))])


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
                       shard_ids: int = SHARD_IDS, partitions: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write wavelet-matrix shards to ``path``.

    Documents are in ascending (doc_id, text); a null doc_id comes first, a
    null text counts as empty and yields the end id alone. Repeated rows are
    documents of their own. Other columns are ignored. A document is never
    split: one longer than ``shard_ids`` is a shard by itself. An empty table
    writes no shard.
    """
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange(n, F.col("doc_id")).sortWithinPartitions("doc_id", "text"))
    shards = map_arrow(ordered, _shards(tokenizer, end_id, shard_ids), SHARD_SCHEMA)
    shards.write.option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
            raw = WaveletMatrix.from_parts(row).ids().astype("<u4").tobytes()
            ends = np.cumsum(row["doc_lengths"])
            starts = ends - row["doc_lengths"]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "part": pa.array([row["part"]] * len(ends), pa.int32()),
                "shard": pa.array([row["shard"]] * len(ends), pa.int32()),
                "local_start": pa.array(starts + row["part_start"], pa.int64()),
                "n_tokens": pa.array(row["doc_lengths"], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(starts, ends)], pa.int64())})


def read_token_shards(spark, path: str) -> DataFrame:
    """One row a document, from the files alone: doc_id, part, shard, start,
    n_tokens (with the end id) and the crc32 of its ids as 32-bit integers."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # one row a range partition, whose number the writer has fixed
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_offset"))
    docs = map_arrow(shards, _read, DOCS_SCHEMA)
    return (docs.join(F.broadcast(offsets), "part")
            .select("doc_id", "part", "shard", (F.col("part_offset") + F.col("local_start")).alias("start"),
                    "n_tokens", "ids_crc32"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenize_documents(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write the shards (to ``path``, or below the checkpoint folder) and read them back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_token_shards(docs, path, tokenizer or default_tokenizer())
    return read_token_shards(spark, path)
