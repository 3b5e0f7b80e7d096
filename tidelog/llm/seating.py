"""Chinese-restaurant seatings of many dishes at once, in numpy.

:func:`draw_tables` seats all customers of each dish anew in one step. Only the number of a dish's tables matters to
its probabilities, so that is what it draws, and no table is kept. :class:`Seating` makes the same Gibbs moves a
customer at a time; the draws are tested against it.

With opening weight w and discount d, c customers have t tables with probability in proportion to S(c, t) * w**t, where
the generalised Stirling numbers S(c + 1, t) = S(c, t - 1) + (c - t * d) * S(c, t) count the seatings.
"""

from __future__ import annotations

import numpy as np

#: Up to so many customers the draw is from the exact distribution.
EXACT = 128
CELLS = 1 << 21


def _log_stirling(discount: float) -> np.ndarray:
    """Row c, column t - 1: log of S(c, t) / S(c, 1), for up to EXACT customers."""
    table = np.zeros((EXACT + 1, EXACT))
    table[1, 0] = 1.0
    t = np.arange(1, EXACT + 1)
    for c in range(1, EXACT):
        table[c + 1] = np.maximum(c - t * discount, 0) * table[c]
        table[c + 1, 1:] += table[c, :-1]
        table[c + 1] /= c - discount
    with np.errstate(divide="ignore"):
        return np.log(table)


def _weights(row: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """A row a dish: weights of 1, 2, ... tables, the largest about 1."""
    logs = row + np.log(opening)[:, None] * np.arange(len(row))
    return np.exp(logs - logs.max(axis=1, keepdims=True))


def _exact(row: np.ndarray, opening: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    out, step = np.empty(len(opening), dtype=np.int64), max(1, CELLS // len(row))
    for a in range(0, len(opening), step):
        sums = np.cumsum(_weights(row, opening[a : a + step]), axis=1)
        out[a : a + step] = 1 + (sums < (rng.random(len(sums)) * sums[:, -1])[:, None]).sum(axis=1)
    return out


def _many(customers: np.ndarray, opening: np.ndarray, discount: float, row: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The tables of dishes with more than EXACT customers.

    The first EXACT customers have t tables in proportion to S(EXACT, t) * (w * q**d)**t, and those who come after
    them open about Poisson(w * (1 - q**d) / d) more. q is the saddle point of the generating function of all ways to
    seat the later ones, (1 - x)**-(EXACT - t * d) * exp(w * (1 - (1 - x)**d) / d) with x = 1 - q.
    """
    later, q, mean = (customers - EXACT).astype(float), np.ones(len(customers)), np.ones(len(customers))
    for _ in range(4):
        seats = EXACT - mean * discount
        low, high = np.log(seats / (seats + later)), np.zeros(len(customers))
        for _ in range(50):
            middle = (low + high) / 2
            q = np.exp(middle)
            above = (1 - q) * (seats / q + opening * q ** (discount - 1)) > later
            low, high = np.where(above, middle, low), np.where(above, high, middle)
        weights = _weights(row, opening * q**discount)
        mean = (weights @ np.arange(1, EXACT + 1)) / weights.sum(axis=1)
    first = _exact(row, opening * q**discount, rng)
    rate = opening * (1 - q**discount) / discount
    # All later customers are a fixed number, which narrows the number of tables that they open.
    joint = (1 - q) * opening * q ** (discount - 1)
    spread = joint + (1 - q) ** 2 * opening * (1 - discount) * q ** (discount - 2) + seats * (1 - q) / q**2
    narrow = np.clip(joint**2 / spread / np.maximum(rate, 1e-300), 0.0, 1.0)
    trials = np.maximum(1, np.rint(rate / np.maximum(narrow, 0.01)))
    opened = np.where(narrow < 0.01, rng.poisson(rate), rng.binomial(trials.astype(np.int64), np.minimum(1.0, rate / trials)))
    return first + np.minimum(opened, customers - EXACT)


def draw_tables(customers: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """The number of tables of each dish, drawn given its customers and the weight of a new table: a full Gibbs pass."""
    opening = np.maximum(opening, 1e-12)
    tables = np.minimum(customers, 1).astype(np.int64)
    several = np.flatnonzero(customers > 1)
    several = several[np.argsort(np.minimum(customers[several], EXACT + 1), kind="stable")]
    size = np.minimum(customers[several], EXACT + 1)
    ends = np.searchsorted(size, np.arange(2, EXACT + 3)).tolist()
    logs = _log_stirling(discount)
    for c, a, b in zip(range(2, EXACT + 2), ends[:-1], ends[1:], strict=True):
        for a in range(a, b, CELLS // EXACT):  # noqa: B020, PLW2901
            some = several[a : min(b, a + CELLS // EXACT)]
            if c <= EXACT:
                tables[some] = _exact(logs[c, :c], opening[some], rng)
            else:
                tables[some] = _many(customers[some], opening[some], discount, logs[EXACT], rng)
    return tables


class Seating:
    """The tables of each dish in one or more restaurants: dish k has `tables[k]` tables, whose sizes follow each
    other in `sizes`, and `customers[k]` customers."""

    def __init__(self, tables: np.ndarray, sizes: np.ndarray):
        self.tables, self.sizes = tables.astype(np.int64), sizes.astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(self.sizes)))
        at = np.concatenate(([0], np.cumsum(self.tables)))
        self.customers = ends[at[1:]] - ends[at[:-1]]

    @classmethod
    def start(cls, customers: np.ndarray, tables: np.ndarray) -> Seating:
        """Customers spread evenly over the given numbers of tables; a dish without customers has none."""
        tables = np.where(customers > 0, np.minimum(np.maximum(tables, 1), np.maximum(customers, 1)), 0)
        dish = np.repeat(np.arange(len(tables)), tables)
        place = np.arange(len(dish)) - np.repeat(np.cumsum(tables) - tables, tables)
        return cls(tables, customers[dish] // tables[dish] + (place < customers[dish] % tables[dish]))

    def _settle(self, dish_of_table: np.ndarray) -> None:
        kept = self.sizes > 0
        self.sizes = self.sizes[kept]
        self.tables = np.bincount(dish_of_table[kept], minlength=len(self.tables)).astype(np.int64)

    def leave(self, dishes: np.ndarray, count: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Takes `count` customers, spread at random, from each of these different dishes; how many tables closed."""
        before = self.tables[dishes]
        dish_of_table = np.repeat(np.arange(len(self.tables)), self.tables)
        ends = np.cumsum(self.sizes)
        first = np.concatenate(([0], np.cumsum(self.customers)))[dishes]
        which = np.repeat(np.arange(len(dishes)), count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        here = self.customers[dishes][which]
        spot = np.minimum(((rng.random(len(dishes))[which] + step) * (here / count[which])).astype(np.int64), here - 1)
        np.subtract.at(self.sizes, np.searchsorted(ends, first[which] + spot, side="right"), 1)
        self.customers[dishes] -= count
        self._settle(dish_of_table)
        return before - self.tables[dishes]

    def enter(self, dishes: np.ndarray, count: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
        """Seats `count` customers of each of these different dishes; how many tables opened.

        A customer opens a table with weight `opening`, or joins one with weight its size less the discount. The
        customers of one call see the tables as they were before it.
        """
        which = np.repeat(np.arange(len(dishes)), count)
        joining = self.customers[dishes] - discount * self.tables[dishes]
        draw = rng.random(len(which)) * (joining + opening)[which]
        joins = (draw < joining[which]) & (self.customers[dishes][which] > 0)
        ends = np.cumsum(self.sizes - discount)
        table_at = np.concatenate(([0], np.cumsum(self.tables)))
        base = np.concatenate(([0.0], ends))[table_at[dishes]]
        found = np.searchsorted(ends, (base[which] + draw)[joins], side="right")
        found = np.clip(found, table_at[dishes][which][joins], table_at[dishes + 1][which][joins] - 1)
        np.add.at(self.sizes, found, 1)
        opened = np.bincount(which[~joins], minlength=len(dishes)).astype(np.int64)
        self.sizes = np.insert(self.sizes, np.repeat(table_at[dishes + 1], opened), 1)
        self.tables[dishes] += opened
        self.customers[dishes] += count
        return opened

    def resample(self, dishes: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """One Gibbs move a dish: a customer at random leaves and is seated anew. (tables closed, tables opened)."""
        one = np.ones(len(dishes), dtype=np.int64)
        return self.leave(dishes, one, rng), self.enter(dishes, one, opening, discount, rng)
