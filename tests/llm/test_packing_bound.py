"""The configuration LP against its own bound, best fit and exact packing."""

from functools import lru_cache

import numpy as np
import pytest

from tessella.llm.packing import best_fit, plan, solve


@pytest.mark.parametrize(("lengths", "within"), [([100, 129, 171, 172, 257, 342], 1.015), (list(range(130, 330)), 1.02)])
def test_near_the_dual_bound(lengths, within):
    demand = np.bincount(np.random.default_rng(0).choice(lengths, 20_000), minlength=513)
    p = plan(demand, 512)
    assert p.lp <= p.sequences <= within * p.lp and p.sequences <= sum(best_fit(demand, 512).values())


def test_at_the_production_limit():
    demand = np.bincount(np.random.default_rng(1).integers(500, 1300, 3000), minlength=2049)
    p = plan(demand, 2048)
    assert p.lp <= p.sequences <= 1.025 * p.lp and p.sequences <= sum(best_fit(demand, 2048).values())


def exact(pieces, limit):
    """Least number of sequences, by search."""

    @lru_cache(None)
    def least(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        found = set()

        def fill(room, k, kept):
            if k == len(rest):
                found.add(kept)
                return
            if rest[k] <= room:
                fill(room - rest[k], k + 1, kept)
            fill(room, k + 1, (*kept, rest[k]))

        fill(limit - first, 0, ())
        return 1 + min(map(least, found))

    return least(tuple(sorted(pieces, reverse=True)))


def test_small_cases_against_exact_packing():
    rng = np.random.default_rng(2)
    for _ in range(25):
        pieces = rng.integers(3, 21, 9).tolist()
        demand = np.bincount(pieces, minlength=21)
        p, best = plan(demand, 20), exact(pieces, 20)
        assert p.lp <= best + 1e-9 and best <= p.sequences <= best + 1


def test_bound_holds_for_large_counts():
    demand = np.zeros(101, np.int64)
    demand[[30, 45, 70]] = [10**9, 10**9, 10**8]
    x, bound = solve(demand, 100)
    p = plan(demand, 100)
    assert bound <= p.sequences <= 1.01 * bound
