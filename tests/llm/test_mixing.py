import math
import random
from fractions import Fraction

import pytest

from lodestone.llm import mixing

from . import data


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 3, "c": 1}, {"a": 24, "b": 12, "c": 8, "d": 7, "e": 1}, {f"s{i}": i + 1 for i in range(20)}])
def test_period_stays_within_one_block(weights):
    total, seen = sum(weights.values()), dict.fromkeys(weights, 0)
    plan = mixing.period(weights)
    assert len(plan) == total
    for slot, (s, k) in enumerate(plan):
        assert seen[s] == k and k * total // weights[s] <= slot < -(-(k + 1) * total // weights[s])
        seen[s] += 1
        assert all(abs(seen[x] - (slot + 1) * w / total) < 1 for x, w in weights.items())


def brute(blocks, weights):
    """The source of each slot, from the definition: releases and deadlines are exact fractions, counted anew when a source ends."""
    left, out = {s: n for s, n in blocks.items() if n}, []
    while left:
        begun, done, total = len(out), dict.fromkeys(left, 0), sum(weights[s] for s in left)
        while all(left.values()):
            share = {s: Fraction(weights[s], total) for s in left}
            released = [s for s in left if math.floor(done[s] / share[s]) <= len(out) - begun]
            s = min(released, key=lambda s: (math.ceil((done[s] + 1) / share[s]), s))
            out.append(s)
            done[s] += 1
            left[s] -= 1
        left = {s: n for s, n in left.items() if n}
    return out


def counted(rows, weights, block):
    names = [s if s in weights and s != mixing.OTHER else mixing.OTHER for s in rows]
    return {s: -(-names.count(s) // block) for s in set(names)}


def expand(plan, blocks):
    """The source of each slot of a plan of phases."""
    slots = {}
    for first, total, now in plan:
        for s, (begin, until, w, at) in now.items():
            for b in range(begin, until):
                k = b - begin
                assert slots.setdefault(first + k // w * total + at[k % w], s) == s
    assert sorted(slots) == list(range(sum(blocks.values())))
    return [slots[i] for i in sorted(slots)]


CASES = [
    ({"a": 100, "b": 100}, {"a": 24, "b": 12}),
    ({"a": 11, "b": 11}, {"a": 24, "b": 12}),
    ({"a": 1, "b": 1, "c": 1}, {"a": 24, "b": 12, "c": 3}),
    ({"a": 7, "b": 0, "c": 90, "d": 33}, {"a": 5, "b": 9, "c": 2, "d": 3}),
    ({f"s{i}": 3 * i % 17 + 1 for i in range(20)}, {f"s{i}": 20 - i for i in range(20)}),
    ({f"src{i}": n for i, n in enumerate([53, 9, 9, 8, 8, *[5] * 15])}, {f"src{i}": 24 if i == 0 else 12 if i == 1 else 8 if i < 5 else 4 for i in range(20)}),
]


@pytest.mark.parametrize("blocks,weights", CASES)
def test_every_prefix_holds_the_target_weights_until_a_source_ends(blocks, weights):
    order = expand(mixing.phases(blocks, weights), blocks)
    assert order == brute(blocks, weights)
    left, begun = {s: n for s, n in blocks.items() if n}, 0
    placed = dict.fromkeys(left, 0)
    for slot, s in enumerate(order):
        total = sum(weights[x] for x in left)
        placed[s] += 1
        assert all(abs(placed[x] - Fraction((slot + 1 - begun) * weights[x], total)) < 1 for x in left)
        if placed[s] == left[s]:
            left = {x: n - placed[x] for x, n in left.items() if n > placed[x]}
            begun, placed = slot + 1, dict.fromkeys(left, 0)
    assert not left


@pytest.mark.parametrize("block", [1, 7])
def test_schedule_equals_the_slots_one_by_one(spark, block):
    rnd = random.Random(block)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "c", None, "zz"])) for i in range(400)]
    weights = {mixing.OTHER: 1, "a": 3, "b": 2, "c": 1}
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), weights, "source", ["doc_id"], block=block).collect()
    assert sorted(r["mix_position"] for r in got) == list(range(len(rows)))
    slots = {}
    for r in got:
        assert slots.setdefault(r["mix_slot"], r["mix_source"]) == r["mix_source"]
    assert [slots[i] for i in sorted(slots)] == brute(counted([s for _, s in rows], weights, block), weights)
    order = [r["mix_slot"] for r in sorted(got, key=lambda r: r["mix_position"])]
    assert order == sorted(order)


def test_awkward_rows_stay(spark):
    df = data.frame(spark)
    got = mixing.mixed(df, {"src0": 2, "src1": 1}, block=4)
    assert got.columns == df.columns
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got.collect())) == sorted(map(key, df.collect()))
    assert mixing.mixed(df.limit(0), {"src0": 2}).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(df, {"src0": 0}, "source", ["doc_id"])
