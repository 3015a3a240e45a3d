"""The first candidates of S1 records, chosen for many records at once."""

import hashlib
import random

import pyarrow as pa
import pytest

from matchbook.operators import blocking as bl

ROWS = pa.schema([("sid", pa.int64()), ("own", pa.string()), ("prio", pa.int32()), ("bid", pa.int64()), ("ids", pa.list_(pa.string()))])


def hash_order(i):
    return hashlib.md5(i.encode()).digest(), i


def plain(rows, cap):
    """(sid, bid, place, rank): the ids of each sid by prio and hash order, each once, but its own."""
    out = []
    for sid in {r["sid"] for r in rows}:
        seen, rank = {r["own"] for r in rows if r["sid"] == sid}, 0
        entries = [(r["prio"], hash_order(i), r["bid"], at, i) for r in rows if r["sid"] == sid for at, i in enumerate(r["ids"], 1)]
        for *_, bid, at, i in sorted(entries):
            if i not in seen and rank <= cap:
                seen.add(i)
                rank += 1
                out.append((sid, bid, at, rank))
    return sorted(out)


@pytest.mark.parametrize("seed", range(12))
def test_first_candidates(seed, monkeypatch):
    rng = random.Random(seed)
    ids, cap, prios = sorted([f"S2-{i}" for i in range(rng.choice([5, 40, 200]))] + ["é"], key=hash_order), rng.choice([1, 5, 20]), rng.choice([1, 2, 6])
    blocks = {b: (rng.randrange(prios), [i for i in ids if rng.random() < rng.choice([0.05, 0.3, 0.9])][:cap + 2]) for b in range(12)}
    rows = []
    for sid in range(rng.choice([1, 30])):
        own = rng.choice([None, rng.choice(ids)])
        rows += [{"sid": sid * 7, "own": own, "prio": p, "bid": b, "ids": blocks[b][1]}
                 for p, b in sorted((blocks[b][0], b) for b in rng.sample(range(12), rng.randint(1, 8)))]
    monkeypatch.setattr(bl, "LOT", rng.choice([1, 50, 500_000]))
    got = []
    for batch in bl._taker(cap)(iter(pa.Table.from_pylist(rows, ROWS).to_batches(max_chunksize=rng.choice([1, 3, 1000])))):
        for r in batch.to_pylist():
            ranks = r["ranks"] or range(r["first"], r["first"] + len(r["taken"]))
            got += [(r["sid"], r["bid"], at, k) for at, k in zip(r["taken"], ranks, strict=True)]
    assert sorted(got) == plain(rows, cap)


def test_ids_are_no_longer_told_one_by_one():
    """A lot of ids is sorted at once: no Python string is made of an id whose block needs no other order."""
    rows = [{"sid": 1, "own": None, "prio": 0, "bid": 1, "ids": ["a", "b"]}, {"sid": 1, "own": None, "prio": 1, "bid": 2, "ids": ["b", "c"]}]
    row, place, rank = bl._take(pa.Table.from_pylist(rows, ROWS), 5)
    assert (row.tolist(), place.tolist(), rank.tolist()) == ([0, 0, 1], [1, 2, 2], [1, 2, 3])
