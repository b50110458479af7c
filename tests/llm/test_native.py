"""Sharding and mixing against what they promise."""

from collections import Counter
from fractions import Fraction
from zlib import crc32

import pytest

from cuewright.llm.mixing import edf_period, mix_documents, mixed, phases, shares
from cuewright.llm.sharding import overflow_plan, ring, shard_documents

from .conftest import documents

DATA = "/root/testdata/sf0.001"


def shards_hold(rows, n):
    sizes = Counter(r.shard for r in rows)
    assert sum(sizes.values()) == len(rows)
    assert max(sizes.values(), default=0) - min((sizes.get(s, 0) for s in range(n)), default=0) <= 1
    for shard in sizes:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sizes[shard]))


def test_shards(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = shard_documents(docs).collect()
    shards_hold(rows, 40)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, crc32(raw), "rows", None)
    assert sum(r.shard != r.home_shard for r in rows) < len(rows) / 2


def test_shards_of_odd_rows(odd, nothing):
    rows = shard_documents(odd, 5).collect()
    shards_hold(rows, 5)
    assert len(rows) == odd.count() and sorted(r["size"] for r in rows)[:3] == [16, 16, 16]
    assert {r.text_crc32 for r in rows if r["size"] == 16} == {0}
    assert shard_documents(nothing).collect() == []


def test_overflow_goes_clockwise():
    # arcs 0..3 of shards 0, 1, 0, 2; shard 0 is full after two rows
    plan = overflow_plan([2, 1, 3, 0], [0, 1, 0, 2], [2, 2, 2])
    assert sorted(plan) == [(0, 0, 2, 0, 0), (1, 0, 1, 1, 0), (2, 0, 2, 2, 0), (2, 2, 3, 1, 1)]
    with pytest.raises(ValueError):
        ring(40, 10_000)


def test_little_moves_when_a_shard_is_added():
    before, after = ring(40, 64), ring(41, 64)
    owner = lambda points, cell: next((s for c, s in points if c >= cell), points[0][1])
    moved = [(owner(before, c), owner(after, c)) for c in range(0, 1 << 16, 16)]
    assert sum(a != b and b != 40 for a, b in moved) < len(moved) * 0.01 and 0 < sum(b == 40 for _, b in moved) < len(moved) * 0.05


@pytest.mark.parametrize("weights", [[1], [1, 1], [5, 3, 2], [0.5, 0.01, 0.3, 0.07], [97, 1, 1, 1], [1 / 3, 1 / 7, 1 / 11, 1 / 13]])
def test_deviation_is_below_a_block(weights):
    share = shares(weights, 128)
    slots = edf_period(share)
    assert sorted(s for x in slots for s in x) == list(range(128))
    for n, mine in zip(share, slots):
        assert len(mine) == n >= 1
        for t in range(129):
            assert abs(sum(s < t for s in mine) - Fraction(n * t, 128)) < 1
        for j, s in enumerate(mine):
            assert n * s >= n * (j * 128 // n) and s < -(-(j + 1) * 128 // n)


def test_phases_place_every_block_once():
    blocks = [100, 7, 0, 31]
    taken = {}
    for p in phases(blocks, [1.0, 2.0, 5.0, 1.0], 16):
        for j in range(p["end"] - p["first"]):
            slot = p["slot0"] + j // len(p["slots"]) * p["period"] + p["slots"][j % len(p["slots"])]
            assert slot not in taken
            taken[slot] = (p["source"], p["first"] + j)
    assert sorted(taken) == list(range(138)) and set(taken.values()) == {(i, j) for i, n in enumerate(blocks) for j in range(n)}


@pytest.mark.parametrize("weights", [[1.0, 2 ** 0.5, 3 ** 0.5, 0.0007], [0.9999, 0.0001], [1 / 3, 1 / 7, 1 / 11, 1 / 13]])
def test_deviation_from_the_given_weights(weights):
    """Over some hundred periods, in the first phase, each source stays within a block of its own weight, not of a rounded one."""
    total = sum(map(Fraction, weights))
    blocks = [int(w / sum(weights) * 200_000) + 2 for w in weights]
    stretches = list(phases(blocks, weights, 1_024))
    over = min(p["slot0"] + p["slots"][-1] for p in stretches if p["end"] == blocks[p["source"]])
    assert over > 100_000
    for i, w in enumerate(weights):
        mine = [p["slot0"] + s for p in stretches if p["source"] == i for s in p["slots"] if p["slot0"] + s <= over]
        for j, slot in enumerate(mine):  # the deviation is largest just before and after a block
            assert abs(j - Fraction(w) / total * slot) < 1 and abs(j + 1 - Fraction(w) / total * (slot + 1)) < 1


def test_slots_lie_in_the_windows_of_the_given_weights(spark):
    rows = [(i, "x" * 10, "en", "abc"[0 if i % 50 else 1 + i // 50 % 2]) for i in range(6_000)]
    weights = {"a": 0.98037, "b": 0.0097, "c": 0.00993}
    total = sum(map(Fraction, weights.values()))
    for r in mix_documents(documents(spark, rows, False), block=10, weights=weights).filter("slot < 5000").collect():
        share = Fraction(weights[r.source]) / total
        assert (r.release, r.deadline) == (r.block // share, -(-(r.block + 1) // share)) and r.release <= r.slot < r.deadline


def test_mix(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mix_documents(docs, block=4_000, weights={f"src{i}": 1.0 + i for i in range(20)}).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    blocks = {(r.source, r.block): r.slot for r in rows}
    assert len(set(blocks.values())) == len(blocks)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for mine in by.values():  # blocks follow the running size, and slots the blocks
        mine.sort(key=lambda r: (r.slot, r.place))
        total = 0
        for r in mine:
            assert r.block == total // 4_000
            total += r["size"]
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.source, r.place))]
    assert [r.doc_id for r in mixed(docs, block=4_000, weights={f"src{i}": 1.0 + i for i in range(20)}).collect()] == order


def test_mix_of_odd_rows(odd, nothing):
    rows = mix_documents(odd, block=50).collect()
    assert len(rows) == odd.count() and len({(r.slot, r.source, r.place) for r in rows}) == len(rows)
    out = mixed(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert mix_documents(nothing).collect() == [] and mixed(nothing).collect() == []
    with pytest.raises(ValueError):
        mix_documents(odd, max_sources=2)
    with pytest.raises(ValueError):
        mix_documents(odd, weights={"s": -1.0})
