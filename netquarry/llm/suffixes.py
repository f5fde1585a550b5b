"""Suffix arrays and what is read off them, over integer symbols, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix order by prefix doubling; only suffixes that still tie are sorted again.

    Returns the order, each suffix's rank, and the ranks by the first 1, 2, 4, ...
    symbols. With ``most``, suffixes are told apart by that many symbols at least;
    those that still tie share a rank and stand in text order.
    """
    n = len(symbols)
    _, ranks = np.unique(symbols, return_inverse=True)
    # a group's rank is the place of its first member in suffix order
    sizes = np.bincount(ranks, minlength=1)
    first = np.cumsum(sizes) - sizes
    rank = first[ranks].astype(np.int64) if n else np.zeros(0, np.int64)
    levels = [rank.astype(np.int32)]
    active = np.flatnonzero(sizes[ranks] > 1) if n else np.zeros(0, np.int64)
    step = 1
    while len(active) and (most is None or step < most):
        after = active + step
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old = rank[active]
        new_old = np.r_[True, old[1:] != old[:-1]]
        new_key = np.r_[True, key[1:] != key[:-1]]
        place = np.arange(len(active))
        old_start = np.maximum.accumulate(np.where(new_old, place, 0))
        key_start = np.maximum.accumulate(np.where(new_key, place, 0))
        rank = rank.copy()
        rank[active] = old + key_start - old_start
        step *= 2
        levels.append(rank.astype(np.int32))
        alone = new_key & np.r_[new_key[1:], True]
        active = active[~alone]
    order = np.empty(n, np.int64)
    if most is None or not len(active):
        order[rank] = np.arange(n)
    else:
        order = np.argsort(rank, kind="stable")
    return order, rank, levels


def common_prefix(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Symbols that the suffixes at a and b share from their start, from the ranks by 1, 2, 4, ... symbols.

    Exact for suffixes that the levels tell apart; a shared run ends at the end of the row.
    """
    n = len(levels[0])
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + length, b + length
        inside = np.maximum(i, j) < n
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][i[inside]] == levels[k][j[inside]]
        length[same] += 1 << k
    return length


def repeat_lengths(symbols: np.ndarray) -> np.ndarray:
    """For each position, the longest run of symbols from there that also starts elsewhere."""
    n = len(symbols)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    order, _, levels = suffix_array(symbols)
    a, b = order[:-1], order[1:]
    tied = np.flatnonzero(levels[0][a] == levels[0][b])
    shared = common_prefix(a[tied], b[tied], levels)
    np.maximum.at(longest, a[tied], shared)
    np.maximum.at(longest, b[tied], shared)
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def previous_factors(values: list[int], shared: list[int]) -> list[int]:
    """Longest previous factors of suffixes that stand in suffix order.

    values: which text each suffix is from; shared: symbols it shares with the one before
    it (the first: none). The nearest suffixes of a smaller value on either side share the
    most of all with a smaller value: the least common prefix on the way there. Gives the
    larger of both, 0 where no smaller value shares a symbol.
    """
    n = len(values)
    out = [0] * n
    for places, step in ((range(n), 0), (range(n - 1, -1, -1), 1)):
        stack: list[tuple[int, int]] = []  # a value, and what its suffix shares with the one below it in the stack
        for i in places:
            value = values[i]
            most = shared[i + step] if stack else 0
            while stack and stack[-1][0] >= value:
                below = stack.pop()[1]
                if below < most:
                    most = below
            if stack:
                if most > out[i]:
                    out[i] = most
            else:
                most = 0
            stack.append((value, most))
    return out
