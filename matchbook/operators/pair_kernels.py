"""Features of the pairs of blocks, computed for many pairs at once (``functions.pairwise``).

The records of a block and the S1 records that read it come to one task as rows, the block's first, and leave it as
pairs with their features: no pair is made before, and what a record brings is sent once a block, not once a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.functions import pairwise as pw
from matchbook.functions import similarity as sim
from matchbook.functions import text as tx
from matchbook.operators.blocking import Blocks, copy_of, whole_groups
from matchbook.session import ship_package

GIVEN = 2**31 - 1  # the place of an S1 record: behind those of its block
PAIRS = 32_768     # pairs of a batch that goes back


def record_columns() -> dict[str, Column]:
    """What a record brings to its pairs; words and grams are cut from texts behind the shuffle."""
    name, address = F.col("norm_name"), F.col("norm_address")
    return {"norm_name": name, "norm_address": address, "zip_pin": F.col("zip_pin"), "country": tx.fold_country(F.col("country")),
            "sorted": sim.token_sort(name), "sound": sim.soundex_first(name), "number": sim.first_number(address),
            "parts": F.array_join(sim.address_components(F.col("business_address")), ",")}


class Rows:
    """Columns of a batch, coded when they are first asked for."""

    def __init__(self, batch: pa.Table):
        self.batch, self.made = batch, {}

    def _of(self, kind: str, column: str, make: Callable):
        if (kind, column) not in self.made:
            self.made[kind, column] = make(self.column(column))
        return self.made[kind, column]

    def column(self, name: str) -> pa.Array:
        return self.batch.column(name).combine_chunks()

    def texts(self, column: str) -> pw.Texts:
        return self._of("texts", column, pw.Texts)

    def words(self, column: str) -> pw.Tokens:
        return self._of("words", column, pw.Tokens)

    def parts(self, column: str) -> pw.Tokens:
        return self._of("parts", column, lambda x: pw.Tokens(x, pw.COMMAS))

    def codes(self, column: str) -> np.ndarray:
        return self._of("codes", column, pw.codes)

    def known(self, column: str) -> np.ndarray:
        return self._of("known", column, lambda x: x.is_valid().to_numpy(zero_copy_only=False))


def _filled(rows: Rows, column: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs whose texts are neither null nor empty."""
    some = rows.texts(column).sizes > 0
    return some[a] & some[b]


def _where(valid: np.ndarray, of: Callable, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = of(a[valid], b[valid])
    out = np.zeros(len(a), found.dtype)
    out[valid] = found
    return out, valid


def _lev(column: str) -> Callable:
    def run(rows: Rows, a: np.ndarray, b: np.ndarray):
        texts, known = rows.texts(column), rows.known(column)
        both = known[a] & known[b]
        # with one null, a ratio to a text is null and one to an empty text is 0
        return pw.lev_ratio(texts, a, b), both | (np.maximum(texts.sizes[a], texts.sizes[b]) == 0)
    return run


def _equal(column: str, filled: bool = False) -> Callable:
    def run(rows: Rows, a: np.ndarray, b: np.ndarray):
        codes = rows.codes(column)
        valid = (codes[a] >= 0) & (codes[b] >= 0)
        return (codes[a] == codes[b]).astype(np.int64), valid & _filled(rows, column, a, b) if filled else valid
    return run


def _length_ratio(rows: Rows, a: np.ndarray, b: np.ndarray):
    sizes, known = rows.texts("norm_name").sizes, rows.known("norm_name")
    longer = np.maximum(sizes[a], sizes[b])
    shorter = np.where(known[a] & known[b], np.minimum(sizes[a], sizes[b]), longer)  # the least of the known ones
    return pw.round6(np.where(longer > 0, shorter / np.maximum(longer, 1), 0.0)), None


def _both_address(rows: Rows, a: np.ndarray, b: np.ndarray):
    some, known = rows.texts("norm_address").sizes > 0, rows.known("norm_address")
    empty = known & ~some
    return (some[a] & some[b]).astype(np.int64), (known[a] & known[b]) | empty[a] | empty[b]


def _overlap(rows: Rows, a: np.ndarray, b: np.ndarray):
    known = rows.known("parts")
    return _where(known[a] & known[b], lambda x, y: pw.dot(rows.parts("parts").sets, x, y), a, b)


def _truths(rows: Rows) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Numbers of the ids, one more than the largest, (S1 row, number of a true match) as one sorted number each, and how often each is given."""
    ids, true_ids = rows.column("id"), rows.column("true_ids")
    numbers = pw.codes(pa.concat_arrays([ids, true_ids.flatten()]))
    width = int(numbers.max()) + 1
    own = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(true_ids), 0).to_numpy())
    keys, times = np.unique(own * width + numbers[len(ids):], return_counts=True)
    return numbers[:len(ids)], width, np.append(keys, -1), np.append(times, 0)


def _n_true(rows: Rows, a: np.ndarray, b: np.ndarray):
    if "truths" not in rows.made:
        rows.made["truths"] = _truths(rows)
    numbers, width, keys, times = rows.made["truths"]
    wanted = a * width + numbers[b]
    at = np.searchsorted(keys[:-1], wanted)
    return np.where(keys[at] == wanted, times[at], 0), None


def _cosine(rows: Rows, a: np.ndarray, b: np.ndarray):
    sets = rows._of("sets", "grams", pw.Sets.of_lists)
    return pw.round6(pw.dot(sets, a, b, rows._of("values", "weights", lambda x: x.flatten().to_numpy()))), None


#: feature -> (record columns, type, values and where they are not null, of the rows ``a`` and ``b``)
FEATURES: dict[str, tuple[list[str], str, Callable]] = {
    "name_char3_jaccard": (["norm_name"], "double", lambda r, a, b: (pw.jaccard(r.texts("norm_name").grams, a, b), None)),
    "name_token_jaccard": (["norm_name"], "double", lambda r, a, b: (pw.jaccard(r.words("norm_name").sets, a, b), None)),
    "name_lev_ratio": (["norm_name"], "double", _lev("norm_name")),
    "token_sort_ratio": (["sorted"], "double", _lev("sorted")),
    "prefix_tokens": (["norm_name"], "long", lambda r, a, b: (pw.common_prefix(r.words("norm_name"), a, b), None)),
    "name_phonetic_match": (["sound"], "int", _equal("sound")),
    "name_jaro_winkler": (["norm_name"], "double", lambda r, a, b: (pw.jaro_winkler(r.texts("norm_name"), a, b), None)),
    "zip_match": (["zip_pin"], "int", _equal("zip_pin", filled=True)),
    "street_no_match": (["number"], "int", _equal("number")),
    "addr_token_jaccard": (["norm_address"], "double", lambda r, a, b: _where(
        _filled(r, "norm_address", a, b), lambda x, y: pw.jaccard(r.words("norm_address").sets, x, y), a, b)),
    "addr_lev_ratio": (["norm_address"], "double", lambda r, a, b: _where(
        _filled(r, "norm_address", a, b), lambda x, y: pw.lev_ratio(r.texts("norm_address"), x, y), a, b)),
    "addr_component_overlap": (["parts"], "long", _overlap),
    "country_match": (["country"], "int", _equal("country")),
    "name_len_ratio": (["norm_name"], "double", _length_ratio),
    "both_address": (["norm_address"], "int", _both_address),
    "tfidf_cosine": (["grams", "weights"], "double", _cosine),  # of vectors of length 1
    "n_true": (["true_ids"], "long", _n_true),  # how often the pair is in the truth
}
_TYPES = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32()}


def _pairs(rows: pa.Table, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of both sides of each pair of whole blocks, those of an S1 record one after another."""
    at = rows.column("at").to_numpy()
    block = np.cumsum(np.append(True, (np.diff(rows.column("bid").to_numpy()) != 0) | (np.diff(rows.column("copy").to_numpy()) != 0))) - 1
    given, members = np.flatnonzero(at == GIVEN), np.flatnonzero(at != GIVEN)
    asked = rows.select(["taken", "ranks", "first"]).take(given)
    taken = asked.column("taken").combine_chunks()
    n = pc.list_value_length(taken).to_numpy()
    of = np.repeat(np.arange(len(given)), n)
    places = taken.flatten().to_numpy()
    ranks = asked.column("first").to_numpy()[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    own = pc.list_value_length(asked.column("ranks")).combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    ranks[own[of]] = asked.column("ranks").combine_chunks().flatten().to_numpy()
    kept = ranks <= cap
    width = int(max(places.max(initial=0), at[members].max(initial=0))) + 1
    keys, wanted = block[members] * width + at[members], (block[given][of] * width + places)[kept]
    low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
    m = high - low  # several rows where an id repeats, none where it has no record
    return np.repeat(given[of][kept], m), members[np.repeat(low - np.cumsum(m) + m, m) + np.arange(m.sum())]


def _best(rows: Rows, a: np.ndarray, b: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Which pairs are among the ``k`` of their row with the largest value, ties by id."""
    place = rows._of("order", "id", lambda ids: np.argsort(pc.sort_indices(ids).to_numpy(), kind="stable"))
    order = np.lexsort((place[b], -values, a))
    first = np.flatnonzero(np.append(True, np.diff(a[order]) != 0))
    n = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    return np.sort(order[n < k])


def computer(features: list[str], cap: int, best: int | None = None) -> Callable:
    """Rows of ``meeting``, sorted, to ``(s1_id, x)``: an S1 record with some of its pairs and their features.

    With ``best`` only those of each lot that have the largest values of the first feature, ties by id.
    """
    fields = [pa.field("cand_id", pa.string()), *[pa.field(f, _TYPES[FEATURES[f][1]]) for f in features]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bid", "copy"]):
            rows = Rows(table)
            ids = rows.column("id")
            all_a, all_b = _pairs(table, cap)
            for start in range(0, len(all_a), PAIRS):
                a, b = all_a[start:start + PAIRS], all_b[start:start + PAIRS]
                if best:
                    kept = _best(rows, a, b, FEATURES[features[0]][2](rows, a, b)[0], best)
                    a, b = a[kept], b[kept]
                out = [ids.take(pa.array(b))]
                for f in features:
                    values, valid = FEATURES[f][2](rows, a, b)
                    out.append(pa.array(values, _TYPES[FEATURES[f][1]], mask=None if valid is None else ~valid))
                begins = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(a)), pa.int32()), pa.StructArray.from_arrays(out, fields=fields))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[begins])), lists], ["s1_id", "x"])

    return run


def meeting(blocks: Blocks, left: DataFrame, right: DataFrame) -> DataFrame:
    """``(bid, copy, at, id, first, taken, ranks)`` with the columns that ``left`` has by ``s1_id`` and ``right`` by ``cand_id``.

    The records of a block come at their places, then the S1 records that read it; a hot block comes in copies. Ids that repeat in
    ``left`` or ``right`` give repeated rows.
    """
    columns = [c for c in left.columns if c != "s1_id"]
    ids = blocks.members.select("bid", "copies", F.posexplode("ids").alias("at", "cand_id"))
    members = (ids.join(right, "cand_id")
               .select("bid", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), (F.col("at") + 1).alias("at"),
                       F.col("cand_id").alias("id"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("array<int>").alias("taken"),
                       F.lit(None).cast("array<int>").alias("ranks"), *columns))
    given = blocks.given.join(left, "s1_id").select(
        "bid", copy_of(F.col("s1_id")).alias("copy"), F.lit(GIVEN).alias("at"), F.col("s1_id").alias("id"), "first", "taken", "ranks", *columns)
    return members.unionByName(given).repartition(blocks.tasks, "bid", "copy").sortWithinPartitions("bid", "copy", "at")


def block_features(blocks: Blocks, norm: DataFrame, features: list[str], truth: DataFrame | None = None) -> DataFrame:
    """``(s1_id, cand_id)`` of the candidates of blocks with the named features, and with ``truth`` how often it has the pair, ``n_true``."""
    made = record_columns()
    columns = list(dict.fromkeys(c for f in features for c in FEATURES[f][0]))
    left, right = (norm.select(F.col("entity_id").alias(side), *[made[c].alias(c) for c in columns]) for side in ("s1_id", "cand_id"))
    if truth is not None:
        features = [*features, "n_true"]
        left = left.join(truth.groupBy("s1_id").agg(F.collect_list("cand_id").alias("true_ids")), "s1_id", "left")
        right = right.withColumn("true_ids", F.lit(None).cast("array<string>"))
    return compared(blocks, left, right, features)


def compared(blocks: Blocks, left: DataFrame, right: DataFrame, features: list[str], best: int | None = None) -> DataFrame:
    """``(s1_id, cand_id)`` with features of what ``left`` has by ``s1_id`` and ``right`` by ``cand_id``.

    With ``best`` at least all pairs that are among the ``best`` first of their S1 record by the first feature, ties by id.
    """
    ship_package(left.sparkSession)
    types = ", ".join(["cand_id string", *[f"{f} {FEATURES[f][1]}" for f in features]])
    found = meeting(blocks, left, right).mapInArrow(computer(features, blocks.cap, best), f"s1_id string, x array<struct<{types}>>")
    return found.select("s1_id", F.explode("x").alias("x")).select("s1_id", "x.*")
