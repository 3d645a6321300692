"""Suffix orders by linear grouping, of many strings at once.

A suffix begins with its longest Lyndon prefix: the part before the next smaller suffix. Suffixes with equal
Lyndon prefixes form a group, and groups are in the order of these prefixes.

First phase: at the start a group is a symbol. Groups are processed in descending order. When a group's turn
comes it is final; each of its suffixes is then appended to the Lyndon prefix of the previous smaller suffix, which a
pointer finds by jumping over suffixes of processed groups. Suffixes that were pointed at move to new groups behind
the rest of their old one, those with more pointers behind those with fewer.

Second phase: in ascending order, each suffix of the result emits the suffixes whose Lyndon prefix ends before it, found
along the previous-smaller pointers, to the front of their groups. Nothing is renamed or sorted recursively.

The strings are worked on in step, the k-th group (or suffix) of all of them at the same time, in numpy arrays.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


def _first_of_runs(values: np.ndarray) -> np.ndarray:
    """True where a value differs from the one before."""
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return first


def _lyndon_groups(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each suffix's group, and the pointer to its previous smaller suffix."""
    n = len(symbols)
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    order = np.argsort(owner * (int(symbols.max()) + 1) + symbols, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    ordered = symbols[order]
    first = _first_of_runs(ordered)
    first[starts] = True
    begins = np.flatnonzero(first)
    group = np.empty(n + 1, np.int64)
    group[-1] = -1  # before the first string
    size = np.zeros(n, np.int64)
    size[begins] = np.diff(np.append(begins, n))
    group[order] = np.repeat(begins, size[begins])
    before = np.arange(-1, n - 1)
    touched = np.zeros(n, bool)
    active, upper = np.flatnonzero(ends - starts > 1), ends.copy()
    while active.size:
        top = upper[active]
        begin = group[order[top - 1]]
        upper[active] = begin
        sizes = top - begin
        active = active[begin > starts[active] + 1]  # a string's last symbol, its least, points at nothing
        if sizes.max() == 1:
            own, current = order[begin], begin
        else:
            own, current = order[_ranges(begin, sizes)], np.repeat(begin, sizes)
        # previous smaller suffixes; pointers of suffixes in the same group are still on their way and serve as well
        left, least = own, current
        while True:
            at = before[left]
            far = group[at] >= least
            if not far.any():
                break
            left, least = left[far], least[far]
            before[left] = before[at[far]]
        pointed = before[own]
        pointed = pointed[symbols[pointed] > 0]  # else another string's end
        if not pointed.size:
            continue
        pointed.sort()
        fresh = np.flatnonzero(_first_of_runs(pointed))
        moved, times = pointed[fresh], np.diff(np.append(fresh, len(pointed)))
        old = group[moved]
        by = np.lexsort((times, old))
        moved, times, old = moved[by], times[by], old[by]
        new = _first_of_runs(old)
        heads = np.flatnonzero(new)
        taken = np.diff(np.append(heads, len(old)))
        old_heads = old[heads]
        # the moved ones take the last places of their old group, its other suffixes the places that become free
        slots = _ranges(old_heads + size[old_heads] - taken, taken)
        now = place[moved]
        touched[now] = True
        stay = slots[~touched[slots]]
        touched[now] = False
        free = np.sort(now[now < np.repeat(old_heads + size[old_heads] - taken, taken)])
        order[free] = staying = order[stay]
        place[staying] = free
        order[slots] = moved
        place[moved] = slots
        new[1:] |= times[1:] != times[:-1]
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(new)))
        size[old_heads] -= taken
        size[slots[heads]] = counts
        group[moved] = np.repeat(slots[heads], counts)
    return group, before


def suffix_orders(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of each string, in order, in the string's own places.

    ``symbols`` holds the strings one after the other, longest first; the last symbol of each is 0, its least one.
    """
    n = len(symbols)
    group, before = _lyndon_groups(symbols, starts, ends)
    front = np.arange(n)
    out = np.empty(n, np.int64)
    placed = np.zeros(n, bool)
    out[starts], placed[ends - 1] = ends - 1, True
    lengths = ends - starts
    many = len(starts)
    for i in range(int(lengths[0])):
        while lengths[many - 1] <= i:
            many -= 1
        suffix = out[starts[:many] + i] - 1  # at a string's start the end of the string before, which is placed
        while True:
            suffix = suffix[~placed[suffix]]
            if not suffix.size:
                break
            own = group[suffix]
            out[front[own]] = suffix
            front[own] += 1
            placed[suffix] = True
            suffix = before[suffix]
    return out
