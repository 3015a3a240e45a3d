"""Operator 8: language identification with a string kernel.

Two texts are compared by the character n-grams (n = 1 to 3, the blended
spectrum) that both contain: k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|).
Landmark texts span a Nystroem feature space, a ridge regression for each
language against the rest is solved in it, and texts are scored in batches of
presence vectors by matrix products.

Scale: fitting takes a bounded sample, ``FIT_TEXTS`` texts over all languages
(landmarks among them), chosen by a hash of the id; only their n-gram sets
reach the driver. Scoring is one scan without an exchange; the model is a matrix of
landmark n-grams by languages, some MB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.llm.common import map_arrow, without

LENGTHS = (1, 2, 3)
FIT_TEXTS = 1600  # labelled texts that the regression sees, evenly over the languages
LANDMARKS = 200  # of them, evenly over the languages
RIDGE = 0.1
BATCH = 64  # texts of one matrix product
PIECE = 1 << 20  # characters of a long text taken at a time; pieces overlap, nothing is cut off
DENSE = 1 << 22  # n-gram space that is marked instead of sorted
UNKNOWN = "und"
MIN_SCORE = 0.3  # far below what texts of three words get; see the held-out test
ADDED = ("lang_pred", "score")

_LETTER = re.compile(r"[^\W\d_]")
# ASCII characters other than letters are one symbol; code points keep their number otherwise
_FOLD = np.arange(0x110000, dtype=np.uint32)
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def has_letter(text: str | None) -> bool:
    found = _LETTER.search(text) if text else None
    return bool(found) and (found[0].isalpha() or any(map(str.isalpha, text[found.start():])))


def _piece_grams(codes: np.ndarray) -> list[np.ndarray]:
    top = int(codes.max()) + 1
    if top <= 4096:
        seen = np.zeros(top, bool)
        seen[codes] = True
        alphabet = np.flatnonzero(seen)
        local = (np.cumsum(seen) - 1)[codes]
    else:
        alphabet, local = np.unique(codes, return_inverse=True)
    a, out, ids = len(alphabet), [], None
    for n in LENGTHS:
        if len(codes) < n:
            break
        ids = local if n == 1 else ids[:-1] * a + local[n - 1:]
        if a ** n <= DENSE:
            seen = np.zeros(a ** n, bool)
            seen[ids] = True
            distinct = np.flatnonzero(seen)
        else:
            distinct = np.unique(ids)
        key = np.zeros(len(distinct), np.int64)
        for i in range(n):
            key |= alphabet[distinct // a ** i % a].astype(np.int64) << (21 * i)
        out.append(key)
    return out


def grams(text: str) -> np.ndarray:
    """Distinct n-grams of the whole text, sorted; 21 bits a character."""
    codes = _FOLD[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    if not len(codes):
        return np.zeros(0, np.int64)
    overlap = max(LENGTHS) - 1
    found = [k for i in range(0, max(1, len(codes) - overlap), PIECE) for k in _piece_grams(codes[i:i + PIECE + overlap])]
    # lengths have disjoint keys, as no character is 0
    return np.unique(np.concatenate(found))


@dataclass
class KernelModel:
    languages: list[str]
    keys: np.ndarray  # sorted n-grams of the landmarks
    weights: np.ndarray  # n-grams by languages: landmark presences times dual weights
    bias: np.ndarray

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Ridge regression values, texts by languages, of n-gram sets."""
        out = np.zeros((len(texts), len(self.languages)), np.float32)
        for start in range(0, len(texts), BATCH):
            batch = texts[start:start + BATCH]
            presence = _presence(batch, self.keys)
            norm = np.sqrt([max(1, len(g)) for g in batch]).astype(np.float32)
            out[start:start + BATCH] = presence @ self.weights / norm[:, None] + self.bias
        return out


def _presence(texts: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), len(keys)), np.float32)
    for row, g in enumerate(texts):
        at = np.searchsorted(keys, g)
        at[at == len(keys)] = 0
        out[row, at[keys[at] == g]] = 1
    return out


def fit_kernel(texts: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """Nystroem features of the landmarks and one ridge regression a language."""
    languages = sorted(set(labels))
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    each = max(1, landmarks // len(languages))
    chosen = [i for lang in languages for i in [j for j, x in enumerate(labels) if x == lang][:each]]
    keys = np.unique(np.concatenate([texts[i] for i in chosen]))
    marks = _presence([texts[i] for i in chosen], keys) / np.sqrt([[len(texts[i])] for i in chosen])
    kernel = np.concatenate([
        _presence(texts[i:i + BATCH], keys) @ marks.T / np.sqrt([[len(g)] for g in texts[i:i + BATCH]])
        for i in range(0, len(texts), BATCH)])
    values, vectors = np.linalg.eigh(marks @ marks.T)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # landmark kernel to the power -1/2
    features = kernel @ root
    mean, middle = features.mean(axis=0), y.mean(axis=0)
    # rows of rare languages weigh as much as those of frequent ones
    weight = (1 / (y > 0).sum(axis=0))[(y > 0).argmax(axis=1)][:, None] * len(y) / len(languages)
    centred = features - mean
    solved = np.linalg.solve(centred.T @ (weight * centred) + ridge * np.eye(features.shape[1]),
                             centred.T @ (weight * (y - middle)))
    dual = root @ solved
    return KernelModel(languages, keys, (marks.T @ dual).astype(np.float32), (middle - mean @ solved).astype(np.float32))


def fit_languages(docs: DataFrame, fit_texts: int = FIT_TEXTS, landmarks: int = LANDMARKS) -> KernelModel | None:
    """Fit on (doc_id, text, lang); rows without a language or a letter are left out.

    Of every language the ``fit_texts`` / languages rows with the smallest hash
    of their id are taken. None if no row is left.
    """
    narrow = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    langs = max(1, narrow.select("lang").distinct().count())
    order = Window.partitionBy("lang").orderBy("__h", "doc_id", "__t")
    ids = (narrow.select("lang", "doc_id", F.xxhash64("doc_id").alias("__h"), F.xxhash64("text").alias("__t"))
           .withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= max(2, fit_texts // langs)))
    # at most ``fit_texts`` narrow rows, or two a language
    chosen = narrow.withColumn("__t", F.xxhash64("text")).join(
        F.broadcast(ids.select("lang", "doc_id", "__t").distinct()), ["lang", "doc_id", "__t"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [grams(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array(sets, pa.binary())],
                                             ["lang", "doc_id", "grams"])

    rows = map_arrow(chosen.select("lang", F.col("doc_id").cast("string").alias("doc_id"), "text").distinct(), run,
                     "lang string, doc_id string, grams binary").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["doc_id"] or "", r["grams"]))
    if not rows:
        return None
    return fit_kernel([np.frombuffer(r["grams"], np.int64) for r in rows], [r["lang"] for r in rows], landmarks)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            good = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
            for start in range(0, len(good), BATCH):
                own = good[start:start + BATCH]
                values = model.scores([grams(texts[i]) for i in own])
                for i, best, v in zip(own, values.argmax(axis=1).tolist(), values.max(axis=1).tolist()):
                    lang[i], score[i] = model.languages[best], min(1.0, max(0.0, (v + 1) / 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(score, pa.float64())],
                                             names=[*batch.schema.names, *ADDED])
    return run


def identify(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """Add lang_pred and score (0 to 1) by the text alone.

    A null text or one without a letter is ``und`` with score 0, as is every
    text if there is no model. The score is the winning regression value,
    mapped from its targets -1 and 1. Input columns of the added names are
    replaced; repeated rows get the same answer.
    """
    docs = without(docs, ADDED)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return map_arrow(docs, _scorer(shared), schema)


def held_out(docs: DataFrame) -> DataFrame:
    """Add held_out: the fifth of the ids that no model learns from."""
    remainder = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    return without(docs, ["held_out"]).withColumn("held_out", remainder == 0)


def language_model(docs: DataFrame) -> KernelModel | None:
    """Model of the labelled documents outside the held-out fold."""
    return fit_languages(held_out(docs).where(~F.col("held_out")))


def keep_known_languages(docs: DataFrame, model: KernelModel | None, min_score: float = MIN_SCORE) -> DataFrame:
    """Drop documents without a language: ``und``, or no regression above ``min_score``."""
    away = {c: f"__in_{c}" for c in docs.columns if c.lower() in ADDED}
    found = identify(docs.withColumnsRenamed(away), model)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).drop(*ADDED)
    return kept.withColumnsRenamed({v: k for k, v in away.items()})
