"""Suffix sorting by Lyndon-prefix groups, linear and without renaming.

Phase one sorts suffixes by their longest Lyndon prefix. Groups start as the first symbols
and are processed from the highest down. For each suffix of a group the previous-smaller
pointer finds the nearest suffix before it in a lower group; suffixes that receive as many
pointers from the group, out of one group of their own, move to a new group just above it.
Phase two emits each group's order: going up the suffix array, the suffix before each entry
and its chain of pointers take the next free places of their groups.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of all suffixes of ``text`` (integers), in ascending order."""
    size = len(text) + 1
    symbols = [*text, min(text, default=0) - 1]
    # A group is a range of places; it is named by its first place.
    places: dict[int, list[int]] = {}
    for at, symbol in enumerate(symbols):
        places.setdefault(symbol, []).append(at)
    group = [0] * size
    end, start_below, members = {}, {}, {}
    first = 0
    for symbol in sorted(places):
        own = places[symbol]
        for at in own:
            group[at] = first
        end[first] = first + len(own)
        start_below[first + len(own)] = first
        members[first] = own
        first += len(own)
    before = [-1] * size
    upper = size
    while upper > 0:
        lower = start_below[upper]
        hits: dict[int, int] = {}
        own = [at for at in members.pop(lower) if group[at] == lower]
        own.sort()
        for at in own:
            p = at - 1
            while p >= 0 and group[p] >= lower:
                p = before[p]
            before[at] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for p, n in hits.items():
            moves.setdefault((-n, group[p]), []).append(p)
        for _, old in sorted(moves):
            chosen = moves[_, old]
            top = end[old]
            new = top - len(chosen)
            if new == old:
                continue
            end[old], end[new] = new, top
            start_below[new], start_below[top] = old, new
            members[new] = chosen
            for p in chosen:
                group[p] = new
        upper = lower
    array = [-1] * size
    free = dict.fromkeys(end, 0)
    placed = bytearray(size)
    array[0], placed[size - 1] = size - 1, 1
    free[0] = 1
    for at in range(size):
        p = array[at] - 1
        while p >= 0 and not placed[p]:
            own = group[p]
            array[own + free[own]] = p
            free[own] += 1
            placed[p] = 1
            p = before[p]
    return array[1:]
