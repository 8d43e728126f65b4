"""Chinese-restaurant seating of Pitman-Yor restaurants, sampled by Gibbs.

A restaurant seats customers (tokens) of dishes (words) at tables; every table draws its dish
from the parent, so that a dish of c customers at t tables has the weight

    [strength | discount] by all t's of the restaurant * (parent's share) ** t * the number of ways,

whose first factor couples the dishes of a restaurant. Given a gamma variable of each
restaurant, x ~ Gamma(strength / discount + tables), the dishes are independent, and a new
table of a dish weighs discount * x * (parent's share) against (customers - discount *
tables) for the old ones. A sweep draws all x, then offers every dish a new seating, made
customer by customer, by a Metropolis step that leaves exactly that distribution as it is,
then the discount and the strength given the tables. Dishes are independent, so numpy takes
all of them together, a customer of each at a time. From EXACT customers on, a dish's
customers come in runs of 1 / EXACT of those seated, within which the odds stand still.
"""

from __future__ import annotations

import numpy as np

EXACT = 32
BURN, SAMPLES = 8, 4


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers, by Stirling's series eight steps up."""
    x = np.asarray(x, float)
    product, y = np.ones_like(x), x + 8
    for i in range(8):
        product = product * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


class Seats:
    """Seatings of dishes of at least two customers (descending), kept as the tables opened at every step."""

    def __init__(self, customers: np.ndarray):
        self.customers, self.plan, n = customers, [], 1
        while live := int(np.searchsorted(-customers, -n, side="left")):  # those with more than n customers
            run = max(1, n // EXACT)
            self.plan.append((n, live, np.minimum(run, customers[:live] - n)))
            n += run
        self.opened = [np.zeros(live, np.int32) for _, live, _ in self.plan]
        self.tables = np.ones(len(customers))

    def _cost(self, new: np.ndarray, discount: float) -> np.ndarray:
        """log of what proposing this seating divides by."""
        t, cost = np.ones(len(self.customers)), np.zeros(len(self.customers))
        for (n, live, more), opened in zip(self.plan, self.opened):
            cost[:live] += more * np.log(new[:live] + n - discount * t[:live])
            t[:live] += opened
        return cost

    def draw(self, new: np.ndarray, discount: float, rng) -> float:
        """Offers each dish a seating in which a new table weighs `new`; the share of dishes that took it."""
        if not len(self.customers):
            return 1.0
        old = self._cost(new, discount)
        t, cost, offered = np.ones(len(new)), np.zeros(len(new)), []
        for n, live, more in self.plan:
            total = new[:live] + n - discount * t[:live]
            odds = new[:live] / total
            opened = (rng.random(live) < odds).astype(np.int32) if n < 2 * EXACT else rng.binomial(more, np.clip(odds, 0, 1)).astype(np.int32)
            cost[:live] += more * np.log(total)
            t[:live] += opened
            offered.append(opened)
        taken = np.log(rng.random(len(t))) < cost - old
        self.tables = np.where(taken, t, self.tables)
        self.opened = [np.where(taken[: len(a)], a, b) for a, b in zip(offered, self.opened)]
        return float(taken.mean())

    def joined(self, discount: float) -> float:
        """The part of the seatings' log weight that depends on the discount, but for the restaurants' factor."""
        t, total = np.ones(len(self.customers)), 0.0
        for (n, live, more), opened in zip(self.plan, self.opened):
            total += float(((more - opened) * np.log(n - discount * t[:live])).sum())
            t[:live] += opened
        return total


def _tallied(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(x[x > 1], return_counts=True)


def sampled(restaurant: np.ndarray, customers: np.ndarray, share, restaurants: int, rng, burn: int = BURN, samples: int = SAMPLES, discount: float = 0.8, strength: float = 1.0):
    """(discount, strength, tables of each dish, tables of each restaurant) after each of `samples` sweeps.

    restaurant and customers (at least 1) of each dish; share: the parent's share of each
    dish, an array, or a function of the tables that gives it before each sweep.
    """
    order = np.argsort(-customers, kind="stable")
    order = order[: int((customers > 1).sum())]
    seats = Seats(customers[order])
    tables = np.ones(len(customers))
    guests, times = _tallied(np.bincount(restaurant, weights=customers, minlength=restaurants).astype(np.int64))

    def of_tables(d: float, s: float) -> float:
        return float((held[1] * ((held[0] - 1) * np.log(d) + lgamma(s / d + held[0]) - lgamma(s / d + 1))).sum())

    def of_guests(s: float) -> float:
        return -float((times * (lgamma(s + guests) - lgamma(s + 1))).sum()) - s  # and an exponential prior

    for sweep in range(burn + samples):
        total = np.bincount(restaurant, weights=tables, minlength=restaurants)
        x = rng.gamma(strength / discount + total)
        p = share(tables) if callable(share) else share
        seats.draw(discount * x[restaurant[order]] * p[order], discount, rng)
        tables[order] = seats.tables
        total = np.bincount(restaurant, weights=tables, minlength=restaurants)
        held = _tallied(total.astype(np.int64))
        for _ in range(2):
            d = discount + 0.03 * rng.standard_normal()
            if 0.01 < d < 0.99 and np.log(rng.random()) < of_tables(d, strength) + seats.joined(d) - of_tables(discount, strength) - seats.joined(discount):
                discount = d
            s = strength * np.exp(0.3 * rng.standard_normal())
            if np.log(rng.random()) < of_tables(discount, s) + of_guests(s) + np.log(s) - of_tables(discount, strength) - of_guests(strength) - np.log(strength):
                strength = s
        if sweep >= burn:
            yield discount, strength, tables.copy(), total
