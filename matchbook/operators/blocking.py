"""Candidate generation: inverted-index probe over truncated blocks.

Semantics (reference phase 3): for every S1 record, the union over its keys of
all S2/S3 records sharing that key, without itself, capped at ``cap``
candidates per S1. The reference's cap keeps an arbitrary subset; we keep the
first ``cap`` by ``(most specific shared key, md5 of cand_id, cand_id)``: this
is deterministic, and the hash prefers no source where the id would (every
``S2-`` sorts before every ``S3-``). The number of shared keys is no part of
the order, as it is not known before the join.

Scale design. A key block's join output is |S1_k| x |T_k|, quadratic in a hot
key (``n1all`` = country + first token), and even the capped result has ``cap``
rows a record. Neither is ever shuffled (``blocks_of``):

* Every block is truncated to its first ``cap + 2`` ids (proof in
  ``truncate_blocks``) and kept as one array.
* An S1 record keeps its keys up to the first full block. Records of the same
  blocks have the same candidates, which are chosen once: for each block the
  places of those that are new in it.
* The places travel to the blocks, where arrays of candidates are cut out
  (``block_lists``) or pairs are made with the attributes of both sides
  (``block_pairs``), each in one task and without a shuffle of pairs.

What is shuffled is a row per record and key, and a row per S1 record and block
that gives it candidates, whatever the skew. The result is exactly equal to
ranking the full, uncapped union — tests check this against a brute-force oracle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.operators.keys import KEY_PRIORITY, explode_keys, priority_of, profile_tags
from matchbook.session import ship_package, written

SPREAD = 50_000  # records in a task that makes keys
SHARE = 500       # S1 records that read one copy of a block
TASK = 2_000      # S1 records in a task that makes pairs
LOT = 500_000     # ids at once, of which the first are taken


def id_order(col: str) -> list[Column]:
    """Order of ids that prefers no prefix; equal hashes go by the id."""
    return [F.md5(F.col(col)), F.col(col)]


def truncate_blocks(target_keys: DataFrame, keep: int) -> DataFrame:
    """Keep the first ``keep`` targets (by ``id_order``) of every (tag, key) block.

    Rows that repeat an id share its place.

    Exactness: if candidate c is in an S1's final top ``cap`` with best key
    k, every target of block k with an earlier id ranks ahead of c (its best
    key is at least as specific), so fewer than ``cap`` of them exist and c
    survives truncation of block k at ``cap + 1`` (one slot spare for the
    self id). Candidates that survive only through a less specific key rank
    no better than truly, so the top ``cap`` is unchanged. One more id keeps
    "more than cap candidates" exact.
    """
    return _places(target_keys, keep).drop("_rk")


def _places(target_keys: DataFrame, keep: int) -> DataFrame:
    # keys first: the sort tells most of them apart by their first bytes, but types hardly; bytes take half the room of hex digits
    w = Window.partitionBy("key", "tag").orderBy(F.unhex(F.md5("entity_id")), "entity_id")
    return target_keys.withColumn("_rk", F.dense_rank().over(w)).where(F.col("_rk") <= keep)


def probe(s1_keys: DataFrame, target_keys: DataFrame) -> DataFrame:
    """Equi-join S1 keys with target keys on (tag, key); drop self pairs."""
    s = s1_keys.select(F.col("entity_id").alias("s1_id"), "tag", "key")
    t = target_keys.select(F.col("entity_id").alias("cand_id"), "tag", "key")
    return (s.join(t, ["tag", "key"])
            .where(F.col("s1_id") != F.col("cand_id"))
            .select("s1_id", "cand_id", "tag"))


class Blocks(NamedTuple):
    """``members`` (bid, ids): first ids of each block. ``given`` (s1_id, bid, copies, prio, first, taken, ranks):
    a row per S1 record and block that gives it candidates, at the places ``taken`` of ``ids``; their ranks are
    ``ranks``, or follow one another from ``first`` on if that is null. ``tasks`` is for the rows of ``given``."""

    members: DataFrame
    given: DataFrame
    tasks: int
    cap: int


def spread(norm: DataFrame) -> DataFrame:
    """Tasks of bounded size: the sort of exploded keys takes many times the room of the records."""
    known = norm.where("entity_id IS NOT NULL")
    return known.repartition(1 + known.count() // SPREAD, "entity_id")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of whole groups of equal numbers ``keys``, which stand together: those of the last one of a batch wait for the next."""
    waiting = []
    for batch in batches:
        if not len(batch):
            continue
        values = [batch.column(k).to_numpy() for k in keys]
        others = np.flatnonzero(np.logical_or.reduce([v != v[-1] for v in values]))
        start = int(others[-1]) + 1 if len(others) else 0
        if start or (waiting and any(waiting[-1].column(k)[-1].as_py() != v[-1] for k, v in zip(keys, values, strict=True))):
            yield pa.Table.from_batches([*waiting, batch.slice(0, start)])
            waiting = []
        waiting.append(batch.slice(start))
    if waiting:
        yield pa.Table.from_batches(waiting)


_md5 = partial(hashlib.md5, usedforsecurity=False)


def _hash_places(ids: pa.Array, wanted: np.ndarray) -> np.ndarray:
    """Places of the ids in ``id_order``, for the ``wanted`` ones among themselves."""
    ids_wanted = ids.take(pa.array(wanted)).cast(pa.binary())
    high, low = np.frombuffer(b"".join([_md5(i).digest() for i in ids_wanted.to_pylist()]), ">u8").astype(np.uint64).reshape(-1, 2).T
    by = np.argsort(high)
    if not np.diff(high[by]).all():  # equal first halves: the second ones, then the ids decide
        by = np.lexsort((np.argsort(pc.sort_indices(ids_wanted).to_numpy()), low, high))
    places = np.zeros(len(ids), np.int64)
    places[wanted[by]] = np.arange(len(wanted))
    return places


def _stable_order(keys: np.ndarray) -> np.ndarray:
    """Places by key, those of equal keys as they stand; small keys are sorted with their places, which is several times as fast."""
    n = max(1, len(keys))
    if int(keys.max(initial=0)) >= 2**62 // n:
        return np.argsort(keys, kind="stable")
    both = keys * n + np.arange(len(keys))
    both.sort()
    return both % n


def _take(table: pa.Table, cap: int) -> tuple[np.ndarray, ...]:
    """Of rows (sid, own, prio, bid, ids), sorted: (row, place, rank) of the first ``cap + 1`` ids of each sid, by row and rank."""
    sid, prio = (table.column(c).to_numpy() for c in ("sid", "prio"))
    lists = table.column("ids").combine_chunks()
    n = pc.list_value_length(lists).to_numpy()
    row = np.repeat(np.arange(len(sid)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1
    every = pa.concat_arrays([lists.flatten(), table.column("own").combine_chunks()]).dictionary_encode()
    codes = pc.fill_null(every.indices, -1).to_numpy().astype(np.int64)
    code, own = codes[:len(row)], codes[len(row):]
    who = np.cumsum(np.append(True, np.diff(sid) != 0)) - 1
    lot = np.cumsum(np.append(True, (np.diff(sid) != 0) | (np.diff(prio) != 0))) - 1  # blocks of one sid and prio
    shared = (np.bincount(lot) > 1)[lot][row]  # the ids of a single block are in their order
    if shared.any():
        order = place.copy()
        order[shared] = _hash_places(every.dictionary, np.unique(code[shared]))[code[shared]]
        by = _stable_order(lot[row] * (int(order.max()) + 1) + order)
        row, place, code = row[by], place[by], code[by]
    keys = who[row] * len(every.dictionary) + code
    by = _stable_order(keys)
    new = np.zeros(len(row), bool)
    new[by[np.append(True, np.diff(keys[by]) != 0)[:len(by)]]] = True
    new &= code != own[row]
    row, place = row[new], place[new]
    counts = np.bincount(who[row], minlength=int(who[-1]) + 1)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    within = rank <= cap + 1
    row, place, rank = row[within], place[within], rank[within]
    by = _stable_order(row)
    return row[by], place[by], rank[by]


_TAKEN = pa.schema([("sid", pa.int64()), ("bid", pa.int64()), ("prio", pa.int32()), ("first", pa.int32()),
                    ("taken", pa.list_(pa.int32())), ("ranks", pa.list_(pa.int32()))])


def _taker(cap: int):
    """Rows (sid, own, prio, bid, ids), those of a sid one after another, to rows of ``_TAKEN``."""
    def lots(table: pa.Table) -> Iterator[pa.Table]:
        """Some sids at once: their ids, whatever the number of blocks, in bounded room."""
        sid = table.column("sid").to_numpy()
        ends = np.append(np.flatnonzero(np.diff(sid)) + 1, len(sid))
        before = np.cumsum(pc.list_value_length(table.column("ids")).to_numpy())
        start = 0
        for end in ends[np.append(np.diff(before[ends - 1] // LOT) != 0, True)].tolist():
            yield table.slice(start, end - start)
            start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in (lot for whole in whole_groups(batches, ["sid"]) for lot in lots(whole)):
            row, place, rank = _take(table, cap)
            if not len(row):
                continue
            begins = np.flatnonzero(np.append(True, np.diff(row) != 0))
            n = np.diff(np.append(begins, len(row)))
            gaps = rank[begins + n - 1] - rank[begins] + 1 != n  # ranks that do not follow one another
            listed = np.repeat(gaps, n)
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(place, pa.int32()))
            ranks = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(gaps, n, 0))), pa.int32(), mask=np.append(~gaps, False)),
                                             pa.array(rank[listed], pa.int32()))
            chosen = table.select(["sid", "bid", "prio"]).take(pa.array(row[begins]))
            yield from pa.table([*[c.cast(t) for c, t in zip(chosen.columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)],
                                 pa.array(rank[begins], pa.int32()), lists, ranks], schema=_TAKEN).to_batches(max_chunksize=2000)

    return run


def blocks_of(s1_keys: DataFrame, target_keys: DataFrame, cap: int, prio: Column, targets: DataFrame | None = None) -> Blocks:
    """Blocks of keys ``(entity_id, tag, key)`` and the first ``cap + 1`` candidates of each S1 record.

    Records without an id must have been left out. ``prio`` is the place of a key's type, a column over ``tag``: candidates go by their least one, then by
    ``id_order``. The last rank tells that more than ``cap`` exist. ``targets`` holds the ``entity_id`` of every target
    record where that is cheaper to read than the keys.

    Keys behind the first full block of a record are left out, exactly: a block of ``cap + 2`` ids gives at
    least ``cap + 1`` candidates whose best key is at least that specific.
    """
    spark = s1_keys.sparkSession
    ship_package(spark)
    kept = _places(target_keys, cap + 2)
    kept = kept.groupBy("tag", "key").agg(F.array_sort(F.collect_set(F.struct("_rk", "entity_id"))).alias("m"))
    blocks = written(kept.select(F.monotonically_increasing_id().alias("bid"), "tag", "key", F.col("m.entity_id").alias("ids")), "blocks")

    found = (s1_keys.join(blocks.select("tag", "key", "bid", F.size("ids").alias("n")), ["tag", "key"])
             .groupBy(F.col("entity_id").alias("s1_id")).agg(F.array_sort(F.collect_set(F.struct(prio.alias("prio"), "bid", "n"))).alias("b")))
    stop = F.array_min(F.transform(F.filter("b", lambda b: b["n"] > cap + 1), lambda b: b["prio"]))
    found = found.withColumn("_stop", stop).withColumn("b", F.filter("b", lambda b: F.col("_stop").isNull() | (b["prio"] <= F.col("_stop"))))
    # a record that is a target too is no candidate of its own
    selves = (target_keys if targets is None else targets).select(F.col("entity_id").alias("s1_id")).distinct().withColumn("own", F.col("s1_id"))
    found = written(found.select("s1_id", "b").join(selves, "s1_id", "left"), "blocks-found")
    alike = found.groupBy("b", "own").agg(F.count(F.lit(1)).alias("records"))
    alike = written(alike.withColumn("sid", F.monotonically_increasing_id()), "blocks-alike")

    wanted = alike.select("sid", "own", F.explode("b").alias("b")).select("sid", "own", "b.prio", "b.bid")
    rows = wanted.join(blocks.select("bid", "ids"), "bid").select("sid", "own", "prio", "bid", "ids")
    rows = rows.repartition(1 + alike.count() // TASK, "sid").sortWithinPartitions("sid", "prio", "bid")
    taken = written(rows.mapInArrow(_taker(cap), "sid long, bid long, prio int, first int, taken array<int>, ranks array<int>"), "blocks-taken")
    copies = taken.join(alike.select("sid", "records"), "sid").groupBy("bid").agg(F.ceil(F.sum("records") / SHARE).cast("int").alias("copies"))
    copies = written(copies, "blocks-copies")
    members = blocks.select("bid", "ids").join(copies, "bid")
    given = found.join(alike, (found.b == alike.b) & found.own.eqNullSafe(alike.own)).select("s1_id", "sid") \
        .join(taken.join(copies, "bid"), "sid")
    return Blocks(members, given, 1 + found.count() // TASK, cap)


def copy_of(s1_id: Column) -> Column:
    """The copy of a block that an S1 record reads."""
    return F.pmod(F.xxhash64(s1_id), F.col("copies")).cast("int")


def _meet(given: DataFrame, members: DataFrame, tasks: int) -> DataFrame:
    """Each row of ``given`` with its block, of which there are ``copies`` for a hot one."""
    copied = members.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    return given.withColumn("copy", copy_of(F.col("s1_id"))).drop("copies").repartition(tasks, "bid", "copy").join(copied, ["bid", "copy"])


def _rank(i: Column) -> Column:
    return F.coalesce(F.get("ranks", i), F.col("first") + i).cast("long")


def block_lists(blocks: Blocks, last: int) -> DataFrame:
    """``(s1_id, prio, ranks, cand_ids)``: arrays of candidates up to rank ``last``, a row per S1 record and block."""
    met = _meet(blocks.given, blocks.members, blocks.tasks)
    taken = F.transform("taken", lambda at, i: F.struct(_rank(i).alias("rank"), F.get("ids", at - 1).alias("id")))
    within = F.filter(taken, lambda x: x["rank"] <= last)
    return (met.select("s1_id", "prio", within.alias("x")).where(F.size("x") > 0)
            .select("s1_id", "prio", F.col("x.rank").alias("ranks"), F.col("x.id").alias("cand_ids")))


def block_pairs(blocks: Blocks, left: DataFrame, right: DataFrame) -> DataFrame:
    """``(s1_id, cand_id, prio, rank)`` with the columns of ``left`` by ``s1_id`` and of ``right`` by ``cand_id``.

    As inner joins give it, so ids that repeat in ``left`` or ``right`` give repeated pairs. The attributes of the
    targets are gathered by block, once for all S1 records that read it.
    """
    cols = [c for c in right.columns if c != "cand_id"]
    rows = right.where("cand_id IS NOT NULL").groupBy("cand_id").agg(F.collect_list(F.struct(*cols)).alias("rows"))
    ids = blocks.members.select("bid", F.posexplode("ids").alias("at", "cand_id"))
    members = (ids.join(rows, "cand_id", "left").groupBy("bid")
               .agg(F.array_sort(F.collect_list(F.struct("at", "cand_id", "rows"))).alias("m"))
               .join(blocks.members.select("bid", "copies"), "bid"))
    met = _meet(blocks.given.join(left, "s1_id"), members, blocks.tasks)

    def pairs(at: Column, i: Column) -> Column:
        m = F.get("m", at - 1)
        return F.transform(F.when(_rank(i) <= blocks.cap, m["rows"]), lambda r: F.struct(
            m["cand_id"].alias("cand_id"), _rank(i).alias("rank"), r.alias("r")))

    out = met.select("s1_id", "prio", *[c for c in left.columns if c != "s1_id"],
                     F.explode(F.flatten(F.filter(F.transform("taken", pairs), lambda x: x.isNotNull()))).alias("x"))
    return out.select("s1_id", "x.cand_id", "prio", "x.rank", *[c for c in left.columns if c != "s1_id"], "x.r.*")


def best_key(prio: Column, version: str) -> Column:
    """Within one profile a priority names exactly one key type."""
    return F.try_element_at(F.create_map(*[x for t in profile_tags(version) for x in (F.lit(KEY_PRIORITY[t]), F.lit(t))]), prio)


def profile_blocks(norm_s1: DataFrame, norm_targets: DataFrame, version: str, cap: int) -> Blocks:
    s1, targets = spread(norm_s1), spread(norm_targets)
    return blocks_of(explode_keys(s1, version), explode_keys(targets, version), cap, priority_of(F.col("tag")),
                     norm_targets.select("entity_id"))


def listed_pairs(lists: DataFrame) -> DataFrame:
    """One row a candidate: ``cand_id`` and ``rank`` for ``cand_ids`` and ``ranks``."""
    rows = lists.withColumn("x", F.explode(F.arrays_zip("ranks", "cand_ids")))
    return rows.select("s1_id", F.col("x.cand_ids").alias("cand_id"), *[c for c in lists.columns if c not in ("s1_id", "ranks", "cand_ids")],
                       F.col("x.ranks").alias("rank"))


def block(norm_s1: DataFrame, norm_targets: DataFrame, version: str, cap: int,
          with_overflow: bool = False, listed: bool = False) -> DataFrame:
    """Capped candidate pairs ``(s1_id, cand_id, best_key, rank)``, or their lists ``(s1_id, best_key, ranks, cand_ids)``.

    With ``with_overflow`` the (cap+1)-th candidate is kept as a marker row
    (``rank = cap + 1``) so callers can count capped entities exactly.
    """
    lists = block_lists(profile_blocks(norm_s1, norm_targets, version, cap), cap + 1 if with_overflow else cap)
    lists = lists.select("s1_id", best_key(F.col("prio"), version).alias("best_key"), "ranks", "cand_ids")
    return lists if listed else listed_pairs(lists)


def lists_by_s1(pairs: DataFrame) -> DataFrame:
    """``(s1_id, cand_ids)``: the at most ``cap`` candidates of each S1 record, of pairs or of their lists."""
    if "cand_ids" in pairs.columns:
        return pairs.groupBy("s1_id").agg(F.flatten(F.collect_list("cand_ids")).alias("cand_ids"))
    return pairs.groupBy("s1_id").agg(F.collect_list("cand_id").alias("cand_ids"))


def candidate_lists(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per S1 incl. empty lists; ids sorted and comma-joined.

    Each list holds at most ``cap`` ids, so ``collect_list`` is bounded.
    """
    agg = lists_by_s1(pairs).select("s1_id", F.array_join(F.sort_array("cand_ids"), ",").alias("candidate_entity_ids"))
    return (s1.select(F.col("entity_id").alias("s1_id"))
            .join(agg, "s1_id", "left")
            .select(F.col("s1_id").alias("source1_entity_id"),
                    F.coalesce("candidate_entity_ids", F.lit("")).alias("candidate_entity_ids")))


def shared_keys(pairs: DataFrame, s1_keys: DataFrame, target_keys: DataFrame) -> DataFrame:
    """All keys each given pair shares, ``(s1_id, cand_id, tag)``.

    Linear in pairs x keys-per-record: used for per-key recall on truth pairs
    without materialising whole blocks.
    """
    s = s1_keys.select(F.col("entity_id").alias("s1_id"), "tag", "key")
    t = target_keys.select(F.col("entity_id").alias("cand_id"), "tag", "key")
    return (pairs.select("s1_id", "cand_id").join(s, "s1_id")
            .join(t, ["cand_id", "tag", "key"], "left_semi")
            .select("s1_id", "cand_id", "tag"))
