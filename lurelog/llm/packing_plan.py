"""A packing plan from a histogram of lengths: configurations and how often each is used.

The fractional problem, to cover every length by as few configurations as
possible, is solved by multiplicative weights: each length has a price that
falls as its pieces are covered, and each round takes the configuration of the
highest price, found by a knapsack dynamic program over the capacity.  A round
covers at least one length whole, so there are at most as many rounds as
lengths, and at the end every length is covered.  The solution is rounded down,
and best fit in decreasing order packs what rounding leaves, also on the
histogram.  Work and result depend on the capacity, never on the number of
pieces.
"""

from __future__ import annotations

import numpy as np

#: A configuration: ``(length, copies)`` pairs in descending order of length.
Configuration = tuple[tuple[int, int], ...]

#: How fast a price falls while its length is covered.
FALL = 1.0
#: Prices grow a little faster than lengths, which keeps short pieces to fill the last sequences.
GROWTH = 1.05


def dearest(price: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """Copies of each length that fill at most ``capacity`` at the highest total price.

    ``price[l]`` is the price of length ``l``; negative infinity keeps a length out.
    """
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(np.isfinite(price[1 : capacity + 1])) + 1
    worth = price[lengths]
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        n = fitting[room]
        if n:
            offers = worth[:n] + best[room - lengths[:n]]
            k = int(offers.argmax())
            if offers[k] > best[room]:
                best[room], last[room] = offers[k], lengths[k]
    copies: dict[int, int] = {}
    room = capacity
    while room > 0:
        if last[room] == 0:
            room -= 1
        else:
            length = int(last[room])
            copies[length] = copies.get(length, 0) + 1
            room -= length
    return copies, float(best[capacity])


def fractional(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], float]]:
    """Configurations with fractional uses that cover the histogram, by multiplicative weights."""
    present = counts > 0
    covered = np.zeros(len(counts))
    size = (np.arange(len(counts)) / capacity) ** GROWTH
    uses: dict[Configuration, float] = {}
    while True:
        # A length that has no open pieces costs nothing to leave out.
        price = np.where(present & (covered < 1), size * np.exp(-FALL * covered), -np.inf)
        if not np.isfinite(price[1:]).any():
            break
        copies, _ = dearest(price, capacity)
        step = min((1 - covered[length]) * counts[length] / n for length, n in copies.items())
        for length, n in copies.items():
            covered[length] += step * n / counts[length]
            if covered[length] > 1 - 1e-9:
                covered[length] = 1.0
        key = tuple(sorted(copies.items(), reverse=True))
        uses[key] = uses.get(key, 0.0) + step
    return [(dict(c), x) for c, x in uses.items()]


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Configuration, int]]:
    """Best fit in decreasing order on a histogram; sequences of one content are handled together."""
    by_room: dict[int, list[tuple[Configuration, int]]] = {}
    rooms = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            free = int(rooms[length:].argmax()) + length
            if rooms[free]:
                content, n = by_room[free].pop()
                if not by_room[free]:
                    rooms[free] = False
            else:
                free, content, n = capacity, (), left
            # As many copies go into one sequence as fit there.
            copies = min(free // length, left)
            used = min(n, max(1, left // copies))
            if n > used:
                by_room.setdefault(free, []).append((content, n - used))
                rooms[free] = free < capacity
                if free == capacity:
                    by_room[free].pop()
            after = free - copies * length
            by_room.setdefault(after, []).append(((*content, (length, copies)), used))
            rooms[after] = after > 0
            left -= copies * used
    return [(content, n) for held in by_room.values() for content, n in held if content]


def rounded(counts: np.ndarray, uses: list[tuple[dict[int, int], float]]) -> tuple[list[tuple[Configuration, int]], np.ndarray]:
    """Fractional uses rounded down, and the counts of the pieces that this leaves."""
    left = counts.astype(np.int64).copy()
    taken: list[tuple[Configuration, int]] = []
    for copies, x in uses:
        n = min(int(x + 1e-9), *(int(left[length]) // k for length, k in copies.items()))
        if n > 0:
            for length, k in copies.items():
                left[length] -= n * k
            taken.append((tuple(sorted(copies.items(), reverse=True)), n))
    return taken, left


def plan(counts: np.ndarray, capacity: int) -> list[tuple[Configuration, int]]:
    """Configurations and whole uses that pack ``counts[l]`` pieces of each length ``l``."""
    if not counts.any():
        return []
    taken, left = rounded(counts, fractional(counts, capacity))
    return taken + best_fit(left, capacity)
