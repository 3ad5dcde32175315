"""Branch and bound over sets of stores against all sets."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.operators import store_sets as S


def all_sets(lines, fees, unit):
    """(total, mask) of the first cheapest set; lines: for each store None or (rank, cost)."""
    n, best = len(fees), None
    for size in range(1, n + 1):
        for some in itertools.combinations(range(n), size):
            subtotal = {}
            for line in lines:
                offers = [(line[k][0], k) for k in some if line[k] is not None]
                if not offers:
                    break
                k = min(offers)[1]
                subtotal[k] = subtotal.get(k, 0) + line[k][1]
            else:
                total = sum(t + int(S.fee(fees[k], np.array([t]), unit)[0]) for k, t in subtotal.items())
                if best is None or total < best[0]:
                    best = (total, sum(1 << k for k in some))
    return best


def made(rng, stores, baskets):
    out = []
    for _ in range(baskets):
        lines = []
        for _ in range(rng.randint(0, 5)):
            prices = [rng.choice([None, None, rng.randint(0, 6) * 100]) for _ in range(stores)]
            order = sorted((p, k) for k, p in enumerate(prices) if p is not None)
            lines.append([None if p is None else (order.index((p, k)), p) for k, p in enumerate(prices)])
        out.append(lines)
    return out


def arrow(baskets):
    offers = [[[k for _, k in sorted((o[0], k) for k, o in enumerate(line) if o)] for line in lines] for lines in baskets]
    costs = [[[line[k][1] for k in ks] for ks, line in zip(stores, lines)] for stores, lines in zip(offers, baskets)]
    return pa.array(offers, pa.list_(pa.list_(pa.int32()))), pa.array(costs, pa.list_(pa.list_(pa.int64())))


FEES = [(None, ((0.0, 80), (5.0, 0))), (40, ()), (None, ()), (None, ((3.0, 10), (4.0, 60))), (0, ()), (None, ((0.0, 5),)), (70, ())]


@pytest.mark.parametrize("seed", range(6))
def test_equals_all_sets(seed):
    rng = random.Random(seed)
    fees = [rng.choice(FEES) for _ in range(rng.randint(1, 7))]
    baskets = made(rng, len(fees), 40)
    got = S.cheapest_sets(*arrow(baskets), fees, 100).to_pylist()
    for lines, found in zip(baskets, got, strict=True):
        want = all_sets(lines, fees, 100) if lines else None
        assert (None if found is None else (found["total"], found["mask"])) == want


def test_twenty_stores_are_bounded():
    """With fees the bound leaves out nearly all of the million sets."""
    rng = random.Random(1)
    n = 20
    fees = [(6_000, ())] * n
    baskets = []
    for _ in range(30):
        lines = []
        for _ in range(10):
            prices = [rng.randint(9_000, 11_000) for _ in range(n)]
            order = sorted((p, k) for k, p in enumerate(prices))
            lines.append([(order.index((p, k)), p) for k, p in enumerate(prices)])
        baskets.append(lines)
    offers, costs = arrow(baskets)
    cost = np.array([[o[1] for o in line] for lines in baskets for line in lines])
    rank = np.array([[o[0] for o in line] for lines in baskets for line in lines])
    search = S.Search(cost, rank, np.arange(31) * 10, fees, 10_000).run()
    assert search.tried < 30 * 20_000
    # the same with the bound taken away, on fewer stores
    few = [[line[:8] for line in lines] for lines in baskets[:5]]
    few = [[[(sorted((o[1], k) for k, o in enumerate(line)).index((line[k][1], k)), line[k][1]) for k in range(8)] for line in lines] for lines in few]
    got = S.cheapest_sets(*arrow(few), fees[:8], 10_000).to_pylist()
    assert [(g["total"], g["mask"]) for g in got] == [all_sets(lines, fees[:8], 10_000) for lines in few]


def test_places():
    n = 5
    order = sorted(range(1, 1 << n), key=lambda m: (m.bit_count(), [k for k in range(n) if m >> k & 1]))
    assert order == sorted(range(1, 1 << n), key=lambda m: S.place(m, n))
