"""Suffix arrays by linear grouping.

First suffixes are grouped by their Lyndon prefixes. Groups are gone through from the largest down:
a suffix's previous smaller pointer leads to the nearest one before it whose group is still to come,
and those that are pointed at leave their group for new ones right above it, the more pointers the
higher. A suffix moves once for each group that points at it, so nothing is renamed or sorted again.
Then suffixes are emitted in ascending order: when one is placed, the one before it and those along
its pointers, until one that has a place, take the next places of their groups.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of a sequence of whole numbers in ascending order; a prefix sorts before what it begins."""
    n = len(text)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    members = [by_symbol[c] for c in sorted(by_symbol)]
    # groups as a chain: the next lower and the next higher of each
    lower, higher = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    open_ = bytearray(b"\1") * n  # whether its group is still to come
    pointer, jump = [-1] * n, list(range(-1, n - 1))
    g = len(members) - 1
    done: list[tuple[int, int]] = []
    while g >= 0:
        own = [i for i in members[g] if group[i] == g and open_[i]]
        members[g] = []
        if own:
            done.append((g, len(own)))
            for i in own:
                open_[i] = 0
            count: dict[int, int] = {}
            for i in own:
                j = jump[i]
                if j >= 0 and not open_[j]:
                    passed = [i]
                    while j >= 0 and not open_[j]:
                        passed.append(j)
                        j = jump[j]
                    for k in passed:
                        jump[k] = j
                pointer[i] = j
                if j >= 0:
                    count[j] = count.get(j, 0) + 1
            if count:
                levels: dict[int, list[int]] = {}
                for j, c in count.items():
                    levels.setdefault(c, []).append(j)
                for c in sorted(levels, reverse=True):
                    fresh: dict[int, int] = {}
                    for j in levels[c]:
                        old = group[j]
                        new = fresh.get(old)
                        if new is None:
                            new = fresh[old] = len(members)
                            members.append([])
                            up = higher[old]
                            lower.append(old)
                            higher.append(up)
                            higher[old] = new
                            if up >= 0:
                                lower[up] = new
                        members[new].append(j)
                        group[j] = new
        g = lower[g]
    place = [0] * len(members)
    at = 0
    for g, size in reversed(done):
        place[g] = at
        at += size
    out, placed = [0] * n, bytearray(n)
    for r in range(-1, n):
        j = (n if r < 0 else out[r]) - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[place[g]] = j
            place[g] += 1
            placed[j] = 1
            j = pointer[j]
    return out
