"""Interpolated modified Kneser-Ney smoothing: the discounts."""

from __future__ import annotations


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2, and 3 or more, from the numbers of n-grams seen 1 to 4 times.

    Where a number is missing (tiny corpora), half of the count's step is taken: 0.5, 0.75, 0.9.
    """
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.01), k - 0.01) for k, d in enumerate(raw, 1))
