"""Packing over shards: the number of sequences for shards of any size, odd lengths, and a long piece beside many short ones."""

from collections import defaultdict

import numpy as np
import pytest

from ledgerloom.llm import packing


def packed(spark, lengths, capacity, shard):
    rows = [(n % 7, int(x), n) for n, x in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id long, length long, row long").repartition(4)
    out = packing.pack_pieces(df, capacity, shard)
    assert out.columns == ["doc_id", "length", "sequence_id", "offset"]
    bins, got = defaultdict(list), []
    for r in out.collect():
        bins[r.sequence_id].append((r.offset, r.length))
        got.append((r.doc_id, r.length))
    assert sorted(got) == sorted(r[:2] for r in rows)
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


@pytest.mark.parametrize("shard, over", [(60, 1.003), (400, 1.001), (3_000, 1.001), (8_000, 1.001)])
def test_shards_of_any_size_are_near_the_bound(spark, shard, over):
    lengths = np.minimum(np.random.default_rng(1).lognormal(6, 1, 6000).astype(np.int64) + 1, 4095)
    bound = -(-int(lengths.sum()) // 4096)
    assert bound <= packed(spark, lengths, 4096, shard) <= over * bound + 1


def test_lengths_that_fill_nothing(spark):
    assert 500 <= packed(spark, [1500] * 1000, 4096, 50) <= 502  # a shard with an odd number leaves one alone
    assert packed(spark, [4095] * 30, 4096, 10) == 30
    assert packed(spark, [1] * 9000, 4096, 1000) == 3
    assert packed(spark, [4095] + [1] * 500, 4096, 100) == 2
    assert packed(spark, [], 4096, 100) == 0


def plain_search(lengths, bins, capacity):
    """The rule of local_search(), every move and exchange looked at one by one."""
    bins, improved = list(bins), True
    fill = [sum(x for x, b in zip(lengths, bins) if b == k) for k in range(max(bins, default=-1) + 1)]
    spare = lambda: [k for k, f in enumerate(fill) if 0 < f < capacity]
    settled = lambda: len(spare()) < 2 or sum(capacity - fill[k] for k in spare()) < capacity
    while improved and not settled():
        improved, given = False, set()
        while not settled() and (left := sorted((k for k in spare() if k not in given), key=lambda k: fill[k])):
            donor, inside = left[0], set(spare()) - {left[0]}
            given.add(donor)
            while fill[donor]:
                own = [n for n, b in enumerate(bins) if b == donor]
                groups = [(n,) for n in own] + [(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
                best = None
                for to, item, back in [(k, None, 0) for k in sorted(inside)] + [(b, n, lengths[n]) for n, b in enumerate(bins) if b in inside]:
                    room = capacity - fill[to]
                    most = max((s for g in groups if (s := sum(lengths[n] for n in g)) <= back + room), default=0)
                    gain = most - back
                    if gain > 0 and fill[to] + gain > fill[donor] and (best is None or room - 2 * gain < best[0]):
                        best = (room - 2 * gain, to, item, gain, next(g for g in groups if sum(lengths[n] for n in g) == most))
                if best is None:
                    break
                _, to, item, gain, group = best
                for n in group:
                    bins[n] = to
                if item is not None:
                    bins[item] = donor
                fill[to], fill[donor], improved = fill[to] + gain, fill[donor] - gain, True
                inside -= {to} if fill[to] == capacity else set()
    return bins


def test_search_takes_what_the_plain_rule_takes():
    rng = np.random.default_rng(5)
    for n, capacity in [(0, 5), (1, 5), (30, 1), (40, 7), (60, 50), (60, 4096), (80, 300)]:
        lengths = np.clip(rng.lognormal(np.log(capacity / 6 + 1), 1, n).astype(np.int64), 1, capacity)
        for start in (packing.next_fit(lengths, capacity), packing.best_fit(lengths, capacity)):
            assert packing.local_search(lengths, start, capacity).tolist() == plain_search(lengths.tolist(), start.tolist(), capacity)


def test_the_greatest_fitting_sum_is_looked_up():
    """One table for each giver says what fits into any room, so that no room is searched for among the sums."""
    sums, fitting = packing.group_sums(np.array([5, 3, 9]), 10)
    assert sums.tolist() == [5, 3, 9, 8, 14, 12] and fitting.tolist() == [0, 0, 0, 3, 3, 5, 5, 5, 8, 9, 9]
    assert [packing.places_of(k, 3) for k in range(6)] == [[0], [1], [2], [0, 1], [0, 2], [1, 2]]
