"""Chinese-restaurant seatings of a Pitman-Yor process, drawn by Gibbs sampling.

What predictions need of a seating is, for each dish of a restaurant, its customers and its
tables.  Given everything else, the number of tables ``t`` of a dish with ``c`` customers has
the weight ``S(c, t) * prod_{i<t} (strength + discount * (T + i)) * base^t``: ``S`` counts the
ways to seat ``c`` customers at ``t`` tables (generalised Stirling numbers), ``T`` are the
tables of the other dishes.  Up to ``EXACT`` customers the draw is from all these weights.
Beyond, a few random-walk steps are accepted or rejected by them, with ``S`` from its
generating function, so that a dish costs the same however many customers it has.  All dishes of a
sweep are drawn at once, each against the totals before the sweep.
"""

from __future__ import annotations

import math

import numpy as np

EXACT = 64
STEPS = 6  # of a random walk in a sweep
FIRST_STEPS = 40  # in the first sweep
SERIES, TERMS = 1.5, 40
SERIES_DISHES = 2_000


def stirling(discount: float, size: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c, t up to ``size``."""
    table = np.full((size + 1, size + 1), -np.inf)
    table[0, 0] = 0.0
    t = np.arange(1, size + 1)
    for c in range(1, size + 1):
        stay = np.where(t < c, np.log(np.maximum(c - 1 - discount * t, 1e-300)), -np.inf)
        table[c, 1:] = np.logaddexp(table[c - 1, :-1], table[c - 1, 1:] + stay)
    return table


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for positive numbers, by Stirling's series above 8."""
    shift = np.zeros_like(x)
    y = x.astype(float).copy()
    while (low := y < 8).any():
        shift[low] += np.log(y[low])
        y[low] += 1
    inverse = 1 / y
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square / 1260))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_stirling(c: np.ndarray, t: np.ndarray, discount: float,
                 prepared: np.ndarray | None = None) -> np.ndarray:
    """log S(c, t) for many customers: a coefficient of the generating function.

    S is ``c! / (t! d^t)`` times the coefficient of x^c in (1 - (1-x)^d)^t.  For few tables,
    up to SERIES * c^d, the binomial series of the power is added up; for more, the
    coefficient is taken at its saddle point, which is off by a few hundredths at most.
    ``prepared`` is ``series(c, discount)``, for callers that ask again for the same customers.
    """
    few = t <= SERIES * c**discount
    if few.all():
        return _by_series(c, t, discount, prepared)
    found = np.zeros(len(c))
    many = ~few & (t < c)
    if few.any():
        found[few] = _by_series(
            c[few], t[few], discount, None if prepared is None else prepared[:, few])
    if many.any():
        found[many] = _by_saddle_point(c[many], t[many], discount)
    return found


def series(c: np.ndarray, d: float) -> np.ndarray:
    """What of the binomial series does not depend on the tables: log Gamma(c - d), and for each
    term j what the j factors (t - i) / c^d are multiplied by."""
    found = np.zeros((TERMS, len(c)))
    found[0] = log_gamma(c - d)
    # At a pole of Gamma the term is nothing.
    terms = [j for j in range(1, TERMS) if abs(d * j - round(d * j)) >= 1e-12]
    column = lambda f: np.array([[f(j)] for j in terms])
    j, sign = column(lambda j: j), column(lambda j: (-1) ** (j + math.floor(-d * j)))
    order, pole = column(lambda j: math.lgamma(j + 1)), column(lambda j: math.lgamma(-d * j))
    # All terms of some dishes at once: there may be few dishes, for which calls cost the most.
    for at in range(0, len(c), SERIES_DISHES):
        part = slice(at, at + SERIES_DISHES)
        n = c[part]
        there = n > d * j
        size = (log_gamma(np.where(there, n - d * j, 8.0)) - found[0, part] - pole - order
                + j * (d * np.log(n)))
        found[terms, part] = sign * np.where(there, np.exp(np.where(there, size, 0.0)), 0.0)
    return found


def _by_series(c: np.ndarray, t: np.ndarray, d: float, prepared: np.ndarray | None = None) -> np.ndarray:
    if prepared is None:
        prepared = series(c, d)
    total, scale = np.zeros(len(c)), c**-d
    for j in range(TERMS - 1, 0, -1):  # a term beyond t has a factor 0
        total += prepared[j]
        total *= (t - (j - 1)) * scale
    return np.log(np.maximum(total, 1e-300)) + prepared[0] - log_gamma(t + 1) - t * math.log(d)


def _by_saddle_point(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    low, high = np.full(len(c), -60.0 / d), np.full(len(c), -1e-12)  # of log(1-x)
    for _ in range(50):
        z = (low + high) / 2
        over = t * d * -np.expm1(z) * np.exp((d - 1) * z) / -np.expm1(d * z) > c
        low, high = np.where(over, z, low), np.where(over, high, z)
    z = (low + high) / 2
    x, u = -np.expm1(z), np.exp(d * z)
    spread = c * (1 + x * ((1 - d) * np.exp(-z) - d * np.exp((d - 1) * z) / (1 - u)))
    return (
        log_gamma(c + 1.0) - log_gamma(t + 1.0) + t * np.log((1 - u) / d) - c * np.log(x)
        - 0.5 * np.log(2 * np.pi * np.maximum(spread, 1e-12))
    )


class Seating:
    """Tables of every dish, and how they are drawn anew."""

    def __init__(self, customers: np.ndarray, restaurant: np.ndarray, discount: float,
                 strength: float, random: np.random.Generator, other_tables: float = 0.0):
        """``restaurant`` numbers the restaurant of each dish; all customers count 1 or more.

        ``other_tables`` stand in every restaurant for dishes that are seated elsewhere.
        """
        self.customers, self.restaurant = customers, restaurant
        self.discount, self.strength, self.random = discount, strength, random
        self.other, self.size = other_tables, int(restaurant.max()) + 1 if len(restaurant) else 0
        self.tables = np.minimum(customers, 1)
        self._fresh = True
        self._stirling = stirling(discount)
        # Dishes of one customer have one table; the others are drawn by number of customers.
        several = np.flatnonzero(customers > 1)
        seated = np.minimum(customers[several], EXACT)
        order = np.argsort(seated, kind="stable")
        self._groups = np.split(
            several[order], np.flatnonzero(np.diff(seated[order])) + 1) if len(several) else []

    def totals(self) -> np.ndarray:
        """Tables of every restaurant."""
        return np.bincount(self.restaurant, self.tables, self.size)

    def sweep(self, base: np.ndarray) -> None:
        """Draw all seatings once; ``base`` is the parent's probability of each dish."""
        totals = self.totals() + self.other
        for group in self._groups:
            count = min(int(self.customers[group[0]]), EXACT)
            for part in np.array_split(group, 1 + len(group) * count // 2_000_000):
                others = totals[self.restaurant[part]] - self.tables[part]
                if count < EXACT:
                    self.tables[part] = self._exact(count, others, base[part])
                else:
                    self.tables[part] = self._walk(part, others, base[part])
        self._fresh = False

    def _exact(self, count: int, others: np.ndarray, base: np.ndarray) -> np.ndarray:
        step = np.arange(count)
        opening = np.log(self.strength + self.discount * (others[:, None] + step))
        weight = np.cumsum(opening + np.log(base)[:, None], axis=1) + self._stirling[count, 1:count + 1]
        chosen = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        u = self.random.random(len(base)) * chosen[:, -1]
        return np.minimum((chosen < u[:, None]).sum(axis=1) + 1, count)

    def _walk(self, part: np.ndarray, others: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Tables of dishes of many customers, by steps that their weights accept."""
        c, t = self.customers[part].astype(float), self.tables[part].astype(float)
        d, prior = self.discount, self.strength / self.discount + others
        opening = (self.strength + d * others) * base
        guess = np.clip(np.round(np.minimum(opening / d, c**d)), 1, c)
        if self._fresh:
            t = guess
        # Steps depend on nothing that they change, so they are as likely back as forth.
        width = 1 + np.sqrt(np.minimum(guess, c - guess + 1))

        # Customers and base stay the same in all steps.
        prepared, each, start = series(c, d), np.log(base * d), log_gamma(prior)

        def weight(t: np.ndarray) -> np.ndarray:
            return log_stirling(c, t, d, prepared) + t * each + log_gamma(prior + t) - start

        now = weight(t)
        for _ in range(FIRST_STEPS if self._fresh else STEPS):
            to = t + np.round(self.random.normal(0, width))
            inside = (to >= 1) & (to <= c)
            to = np.where(inside, to, t)
            then = weight(to)
            take = inside & (np.log(self.random.random(len(t))) < then - now)
            t, now = np.where(take, to, t), np.where(take, then, now)
        return t.astype(self.tables.dtype)

    def predictive(self, base: np.ndarray, restaurant_customers: np.ndarray) -> np.ndarray:
        """Probability of each dish in its restaurant."""
        total = self.strength + restaurant_customers[self.restaurant]
        opened = self.strength + self.discount * self.totals()[self.restaurant]
        return (self.customers - self.discount * self.tables + opened * base) / total
