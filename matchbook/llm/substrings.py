"""Operator 9: substring deduplication by sliding sentence spans.

Texts are cut into sentences; from every sentence a span runs over the fewest
consecutive sentences, ``MIN_SENTENCES`` at least, that have ``MIN_WORDS``
words together. Spans are compared by a 128-bit hash over the whole corpus,
and every sentence covered by a span that is not the first of its kind is
removed. First is the smallest (doc_id, place).

Sentences end at a full stop, question or exclamation mark or a line break.
One of more than ``LONG`` words is cut further after commas and by winnowing:
after the word of the smallest hash in every run of ``RUN`` words, the last one
of equals. A passage that was pasted into the middle of a sentence is so cut at
the same words as its original, but for its first and last ``RUN`` words. No
piece is longer than 10 words, so a span from a common cut among the first 10
words of a passage ends within 10 + 19 + 10 of them, and from word 41 of 51 back
all cuts are common: a repeated passage of more than 50 words always has a
common span. In scripts without spaces each character counts as a word.

Tasks cut chunks of texts with array operations; a span's hash comes from the
hashes of its words by differences of running sums. Cuts and hashes of a text
do not depend on its neighbours in the chunk.

Scale: two exchanges of some 35 bytes a sentence. The first is aggregated
within map tasks, the second is a plain join with the written table of spans
that occur twice or more, which AQE splits where one span is very frequent. No
task sees all places of a span. The removed places of a document are
collected by document, which its own length bounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.llm.common import map_arrow, without, written
from matchbook.llm.decontaminate import words_of
from matchbook.llm.hashing import mix

MIN_SENTENCES = 2
MIN_WORDS = 20
LONG = RUN = 10  # three of them and 19 words fit in 51
CHUNK_CHARS = 1 << 17  # texts cut at once; a longer text is a chunk of its own
ADDED = ("n_sentences", "n_removed")

_MARKS, _FULL_MARKS, _CLOSERS, _PAUSES = ".!?…", "。！？", "\"'”’»)]", ",;:"
# Thai, Lao, Myanmar, Khmer, kana, Han
_SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_APART = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65"
_OTHER = re.compile(f"[{_SPACELESS}{_APART}\u0e00-\U0010ffff]")
_SPACED = re.compile(f"([{_SPACELESS}])|[{_APART}]")
_SPACE, _LINE, _MARK, _FULL_MARK, _CLOSER, _PAUSE = range(1, 7)  # kinds of characters
_LETTER, _ALONE = 1, 2  # parts of words, words by themselves
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F)


def _words(piece: str) -> list[bytes]:
    if _OTHER.search(piece):
        piece = _SPACED.sub(r" \1 ", piece)
    return words_of(piece.encode("utf-8", "surrogatepass"))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each code point, and its part in words; marks beyond ASCII may be both."""
    part = np.full(0x110000, _LETTER, np.uint8)
    part[:0x80] = 0
    for a, b in ("09", "AZ", "az"):
        part[ord(a):ord(b) + 1] = _LETTER
    for ranges, value in ((_APART, 0), (_SPACELESS, _ALONE)):
        for a, b in re.findall("(.)(?:-(.))?", ranges):
            part[ord(a):ord(b or a) + 1] = value
    kind = np.zeros(0x110000, np.uint8)
    kind[[c for c in range(0x3001) if chr(c).isspace()]] = _SPACE
    for chars, value in (("\n", _LINE), (_MARKS, _MARK), (_FULL_MARKS, _FULL_MARK), (_CLOSERS, _CLOSER), (_PAUSES, _PAUSE)):
        kind[[ord(c) for c in chars]] = value
    return kind, part


@lru_cache(8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    out = []
    for factor in (base, pow(base, -1, 1 << 64)):
        values = np.full(size, factor, np.uint64)
        values[0] = 1
        out.append(np.cumprod(values, dtype=np.uint64))
    return out[0], out[1]


def _run_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[begin:end], the same wherever a run stands."""
    powers, inverse = _powers(base, 1 << max(10, int(len(values)).bit_length()))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[:len(values)], dtype=np.uint64, out=sums[1:])
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def _next_after(sorted_places: np.ndarray, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The first of the places beyond ``at``, ``limit`` at most."""
    if not len(sorted_places):
        return limit
    i = np.searchsorted(sorted_places, at, "right")
    return np.where(i < len(sorted_places), np.minimum(sorted_places[np.minimum(i, len(sorted_places) - 1)], limit), limit)


class Cut:
    """Pieces and spans of a chunk of texts, as offsets into the joined texts.

    ``bounds`` are the begins of the pieces and the ends of the texts; those of
    text i are bounds[first[i]:first[i + 1]].
    """

    def __init__(self, texts: list[str]):
        joined = "\0".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(sizes + 1) - sizes - 1  # of the texts
        self.end = self.begin + sizes
        kind, part = (np.append(table[points], np.uint8(0)) for table in _tables())
        self._find_words(points, part)
        cuts = self._sentence_ends(kind)
        cuts = np.union1d(cuts, self._inner_cuts(kind, cuts))
        self.bounds = cuts
        self.first = np.append(np.searchsorted(cuts, self.begin), len(cuts))

    def _find_words(self, points: np.ndarray, part: np.ndarray) -> None:
        letter, alone = part == _LETTER, part == _ALONE
        edge = np.diff(np.concatenate([[False], letter]).view(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if alone.any():
            single = np.flatnonzero(alone)
            starts, ends = np.sort(np.concatenate([starts, single])), np.sort(np.concatenate([ends, single + 1]))
        self.starts, self.ends = starts, ends
        upper = (points >= 65) & (points <= 90)
        self.words = _run_hashes((points + (upper * np.uint32(32)) + np.uint32(1)).astype(np.uint64), starts, ends, _BASES[0])
        self.text_of = np.searchsorted(self.begin, starts, "right") - 1

    def _sentence_ends(self, kind: np.ndarray) -> np.ndarray:
        """Begins and ends of the texts, and the places behind the white space or the mark after a sentence."""
        space = (kind == _SPACE) | (kind == _LINE)
        edge = np.diff(np.concatenate([[False], space]).view(np.int8))
        run_starts, run_ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.space_ends = run_ends
        lines = np.flatnonzero(kind == _LINE)
        has_line = np.searchsorted(lines, run_ends) > np.searchsorted(lines, run_starts)
        before = np.maximum.accumulate(np.where(kind != _CLOSER, np.arange(len(kind)), -1))
        at = before[np.maximum(run_starts - 1, 0)]
        marked = (run_starts > 0) & (at >= 0) & np.isin(kind[np.maximum(at, 0)], (_MARK, _FULL_MARK))
        full = kind == _FULL_MARK
        full_ends = np.flatnonzero(full[:-1] & ~full[1:] & ~space[1:]) + 1
        return np.unique(np.concatenate([self.begin, self.end, run_ends[has_line | marked], full_ends]))

    def _inner_cuts(self, kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Cuts within long sentences: after pauses and by winnowing."""
        none = np.zeros(0, np.int64)
        n = len(self.words)
        if n <= LONG:
            return none
        of = np.searchsorted(ends, self.ends - 1, "right")  # the sentence of a word
        long = np.bincount(of, minlength=len(ends) + 1) > LONG
        if not long.any():
            return none
        place = np.arange(n)
        least = (self.words & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - place.astype(np.uint64))
        width = 1
        while width < RUN:  # smallest of runs of 2, 4, 8, 10 words
            step = min(width, RUN - width)
            least, width = np.minimum(least[:-step], least[step:]), width + step
        whole = self.text_of[:n - RUN + 1] == self.text_of[RUN - 1:]
        chosen = np.unique(np.uint64(0xFFFFFFFF) - (least[whole] & np.uint64(0xFFFFFFFF))).astype(np.int64)
        chosen = chosen[long[of[chosen]]]
        following = np.append(self.starts, self.end[-1])[chosen + 1]
        limit = np.minimum(following, self.end[self.text_of[chosen]])
        pause = np.flatnonzero((kind[:-1] == _PAUSE) & ((kind[1:] == _SPACE) | (kind[1:] == _LINE)))
        pause = pause[long[np.searchsorted(ends, pause, "right")]]
        return np.concatenate([_next_after(self.space_ends, self.ends[chosen], limit),
                               _next_after(self.space_ends, pause + 1, np.full(len(pause), len(kind)))])

    def spans(self) -> tuple[np.ndarray, ...]:
        """(text, first piece in the text, end piece, two hashes) of the span from each piece with words."""
        piece_of = np.searchsorted(self.bounds, self.ends - 1, "right") - 1
        at = np.flatnonzero(np.diff(piece_of, prepend=-1))  # first words of pieces
        border = np.append(at, len(piece_of))
        i = np.arange(len(at))
        j = np.maximum(i + MIN_SENTENCES, np.searchsorted(border, at + MIN_WORDS))
        i = i[j < len(border)]
        j = j[:len(i)]
        fits = self.text_of[at[i]] == self.text_of[at[j - 1]]
        i, j = i[fits], j[fits]
        a, b = at[i], border[j]
        text = self.text_of[a]
        return (text, piece_of[a] - self.first[text], piece_of[at[j - 1]] + 1 - self.first[text],
                _run_hashes(self.words, a, b, _BASES[1]), _run_hashes(self.words, a, b, _BASES[2]))

    def pieces(self, i: int) -> np.ndarray:
        """Bounds of the pieces of text i, from 0 to its length; one bound if it is empty."""
        return self.bounds[self.first[i]:self.first[i + 1]] - self.begin[i]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def sentences(text: str) -> list[str]:
    """Pieces whose concatenation is the text."""
    places = Cut([text]).pieces(0).tolist()
    return [text[a:b] for a, b in zip(places, places[1:])]


def spans(pieces: list[str]) -> list[tuple[int, int, bytes]]:
    """(first sentence, end, words) of the span from each sentence; wordless pieces don't count.

    What a span is; ``Cut.spans`` finds those of many texts at once.
    """
    words = [_words(p) for p in pieces]
    at = [i for i, w in enumerate(words) if w]
    out, j, total = [], 0, 0
    for i, first in enumerate(at):
        while j < len(at) and (j - i < MIN_SENTENCES or total < MIN_WORDS):
            total += len(words[at[j]])
            j += 1
        if j - i < MIN_SENTENCES or total < MIN_WORDS:
            break
        out.append((first, at[j - 1] + 1, b" ".join(w for k in at[i:j] for w in words[k])))
        total -= len(words[first])
    return out


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a span: 128 bits of hash, doc_id, and text hash with place in one number."""
    for batch in batches:
        docs, digests = batch.column("doc"), batch.column("digest").to_numpy()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for a, b in _chunks(texts):
            text, first, _, high, low = Cut(texts[a:b]).spans()
            yield pa.RecordBatch.from_arrays(
                [pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), docs.take(pa.array(text + a)),
                 pa.array(digests[text + a] + first)], ["ha", "hb", "doc", "place"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc: the id; digest: 31 bits of the text's hash above 32 bits for a place."""
    digest = F.shiftleft(F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1)), 32)
    return docs.withColumn("doc", F.col("doc_id").cast("long")).withColumn("digest", digest)


def repeated_places(docs: DataFrame) -> DataFrame:
    """(doc, digest, starts): first sentences of spans that occur earlier in the corpus."""
    found = map_arrow(_keyed(docs.select("doc_id", "text")).select("doc", "digest", "text"), _emit,
                      "ha bigint, hb bigint, doc bigint, place bigint")
    firsts = (found.groupBy("ha", "hb").agg(F.min(F.struct("doc", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
              .where(F.col("n") > 1)
              .select(F.col("ha").alias("fa"), F.col("hb").alias("fb"), F.col("first.doc").alias("fdoc"),
                      F.col("first.place").alias("fplace")))
    firsts = written(firsts, "spans")
    later = found.join(firsts, (F.col("ha") == F.col("fa")) & (F.col("hb") == F.col("fb"))) \
        .where(~F.col("doc").eqNullSafe(F.col("fdoc")) | (F.col("place") != F.col("fplace")))
    low = F.lit((1 << 32) - 1)
    return (later.groupBy("doc", (F.col("place") - F.col("place").bitwiseAND(low)).alias("digest"))
            .agg(F.collect_set(F.col("place").bitwiseAND(low).cast("int")).alias("starts")))


def _without(text: str, places: np.ndarray, starts: list[int] | None, ends: dict[int, int]) -> tuple[str, int, int]:
    n = max(len(places) - 1, 0)
    if not starts:
        return text, n, 0
    gone = np.zeros(n + 1, bool)
    for s in starts:
        gone[s:ends[s]] = True
    at = places.tolist()
    return "".join(text[at[i]:at[i + 1]] for i in np.flatnonzero(~gone[:n])), n, int(gone.sum())


def _removed(texts: list[str], starts: list[list[int] | None]) -> Iterator[tuple[str, int, int]]:
    for a, b in _chunks(texts):
        cut = Cut(texts[a:b])
        ends: list[dict[int, int]] = [{} for _ in range(a, b)]
        if any(starts[a:b]):
            for i, first, end in zip(*(x.tolist() for x in cut.spans()[:3])):
                if starts[a + i]:
                    ends[i][first] = end
        for i in range(b - a):
            yield _without(texts[a + i], cut.pieces(i), starts[a + i], ends[i])


def remove_places(text: str, starts: list[int]) -> tuple[str, int, int]:
    """Text without the spans that begin at ``starts``; sentences before, sentences removed."""
    return next(_removed([text], [starts]))


def _remove(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = list(_removed([t or "" for t in texts], batch.column("starts").to_pylist()))
            rows = [(None, 0, 0) if t is None else r for t, r in zip(texts, rows)]
            kept, counts, gone = zip(*rows) if rows else ((), (), ())
            columns = [pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())],
                                             names=[*names, *ADDED])
    return run


def dedup_spans(docs: DataFrame) -> DataFrame:
    """Replace ``text`` by what remains of it; add n_sentences and n_removed (long).

    Every row stays, also one whose text is removed entirely: it becomes
    empty. A null text stays null and has no sentences. Documents are
    identified by doc_id and text; rows that repeat both are one document and
    are treated alike, a null doc_id comes first. Input columns with the
    added names are replaced; an empty table stays empty.
    """
    docs = without(docs, ADDED)
    keyed = _keyed(docs.withColumnRenamed("doc", "__doc").withColumnRenamed("digest", "__digest")) \
        .withColumnsRenamed({"doc": "__key_doc", "digest": "__key_digest"})
    places = repeated_places(docs)
    joined = keyed.join(places, F.col("__key_doc").eqNullSafe(F.col("doc"))
                        & (F.col("__key_digest") == F.col("digest")), "left")
    joined = joined.drop("__key_doc", "__key_digest", "doc", "digest") \
        .withColumnsRenamed({"__doc": "doc", "__digest": "digest"})
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in ADDED]])
    return map_arrow(joined.select(*[f"`{c}`" for c in names], "starts"), _remove(names), schema)
