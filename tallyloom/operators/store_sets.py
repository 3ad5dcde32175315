"""The cheapest set of stores that fill a basket together, by branch and bound over many baskets at a time.

Sets grow by one store after another, in order.  A set's children take up a later store, so for all of them
a line costs no less than at the cheapest store of the set or after its last one, and each store that is in has to be paid its
least fee; a basket for which this bound exceeds the best set so far is left out
of the branch, and a branch without baskets is not entered.  The best set uses all its stores (the used ones alone cost the same and come
first), so sets with a store that is never the cheapest need not be told apart from it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Stands for no offer; a basket with one is never filled.  Costs lie below it, and so many lines of it can still be summed.
NEVER = 1 << 50
MOST_LINES = 1 << 12
Fees = tuple[int | None, tuple[tuple[float, int], ...]]


def fee(fees: Fees, subtotal: np.ndarray, unit: int) -> np.ndarray:
    """The flat fee, else that of the highest tier reached, else 0."""
    flat, tiers = fees
    out = np.full(len(subtotal), flat or 0, np.int64)
    if flat is None:
        for least, cost in tiers:  # in order of their minima
            out[subtotal / float(unit) >= least] = cost
    return out


def least_fee(fees: Fees) -> int:
    flat, tiers = fees
    return flat if flat is not None else min([0, *(cost for _, cost in tiers)])


def place(mask: int, n: int) -> int:
    """Where a set stands among all: smaller ones first, then those with the earlier stores."""
    backwards = sum(1 << (n - 1 - k) for k in range(n) if mask >> k & 1)
    return (mask.bit_count() << n) + (1 << n) - 1 - backwards


class Search:
    """Baskets as consecutive lines: ``costs`` and ``ranks`` (lines by stores; the least rank is bought), ``first`` line of each."""

    def __init__(self, costs: np.ndarray, ranks: np.ndarray, first: np.ndarray, fees: list[Fees], unit: int):
        self.costs, self.ranks, self.fees, self.unit = costs, ranks, fees, unit
        self.n, sizes = len(fees), np.diff(first)
        if sizes.max(initial=0) > MOST_LINES or costs.max(initial=0) > NEVER:
            raise ValueError(f"a basket has at most {MOST_LINES} lines, a line costs less than {NEVER} units")
        self.first, self.sizes = first[:-1], sizes
        self.total = np.full(len(sizes), NEVER, np.int64)
        self.place = np.full(len(sizes), np.iinfo(np.int64).max)
        self.mask = np.zeros(len(sizes), np.int64)
        self.tried = 0
        self.least = [least_fee(f) for f in fees]
        # the cheapest offer at each store or after it
        self.after = np.full((self.n + 1, len(costs)), NEVER, np.int64)
        for k in range(self.n - 1, -1, -1):
            self.after[k] = np.minimum(self.after[k + 1], costs[:, k])

    def _lines(self, baskets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lines of some baskets, and where each basket's begin among them."""
        sizes = self.sizes[baskets]
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        return np.repeat(self.first[baskets] - starts, sizes) + np.arange(sizes.sum()), starts

    def _try(self, stores: list[int], baskets: np.ndarray) -> None:
        self.tried += len(baskets)
        lines, starts = self._lines(baskets)
        bought = self.ranks[np.ix_(lines, stores)].argmin(1)
        cost = self.costs[lines, np.array(stores)[bought]]
        total = np.zeros(len(baskets), np.int64)
        for i, k in enumerate(stores):
            here = bought == i
            subtotal = np.add.reduceat(np.where(here, cost, 0), starts)
            used = np.add.reduceat(here.astype(np.int64), starts) > 0
            total += np.where(used, subtotal + fee(self.fees[k], np.minimum(subtotal, NEVER), self.unit), 0)
        filled = np.maximum.reduceat(cost, starts) < NEVER
        mask = sum(1 << k for k in stores)
        at = place(mask, self.n)
        better = filled & ((total < self.total[baskets]) | ((total == self.total[baskets]) & (at < self.place[baskets])))
        some = baskets[better]
        self.total[some], self.place[some], self.mask[some] = total[better], at, mask

    def _grow(self, stores: list[int], baskets: np.ndarray, cheapest: np.ndarray, fees: int) -> None:
        """All sets that begin with these stores, for baskets that one of them may serve best; ``cheapest`` of their lines at these stores."""
        for k in range(stores[-1] + 1 if stores else 0, self.n):
            lines, starts = self._lines(baskets)
            mine = np.minimum(cheapest, self.costs[lines, k])
            bound = np.add.reduceat(np.minimum(np.minimum(mine, self.after[k + 1][lines]), NEVER), starts) + fees + self.least[k]
            # equal ones may still come earlier in the order
            keep = bound <= np.minimum(self.total[baskets], NEVER - 1)
            if not keep.any():
                continue
            some = baskets[keep]
            grown = [*stores, k]
            self._try(grown, some)
            self._grow(grown, some, mine[np.repeat(keep, self.sizes[baskets])], fees + self.least[k])

    def run(self) -> "Search":
        every = np.flatnonzero(self.sizes > 0)
        if not len(every) or not self.n:
            return self
        for k in range(self.n):
            self._try([k], every)
        self._try(list(range(self.n)), every)
        self._grow([], every, np.full(int(self.sizes[every].sum()), NEVER, np.int64), 0)
        return self


def cheapest_sets(stores: pa.Array, costs: pa.Array, fees: list[Fees], unit: int) -> pa.Array:
    """Of each basket, given the stores and costs of each line's offers, the cheapest first: total, mask and used (both the set's bits); null if no set fills it."""
    n, baskets = len(fees), len(stores)
    of_basket = stores.value_lengths().fill_null(0).to_numpy()
    first = np.concatenate(([0], np.cumsum(of_basket))).astype(np.int64)
    lines, line_costs = stores.flatten(), costs.flatten()
    sizes = lines.value_lengths().fill_null(0).to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = lines.flatten().to_numpy().astype(np.int64)
    nth = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes)
    cost, rank = np.full((len(sizes), n), NEVER, np.int64), np.full((len(sizes), n), n, np.int64)
    cost[row, column], rank[row, column] = line_costs.flatten().to_numpy(), nth
    found = Search(cost, rank, first, fees, unit).run()
    none = found.total >= NEVER
    mask = pa.array(found.mask.astype(np.int32))
    return pa.StructArray.from_arrays([pa.array(found.total), mask, mask], ["total", "mask", "used"], mask=pa.array(none)) if baskets else pa.array([], pa.struct([("total", pa.int64()), ("mask", pa.int32()), ("used", pa.int32())]))
