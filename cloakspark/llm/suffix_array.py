"""Suffix arrays by linear grouping.

Phase one sorts suffixes into groups by their longest Lyndon prefix. Groups are processed from the largest down. The
previous smaller suffix of each member of a group is found over pointers of members found before; it takes the
group's prefix into its own, so it moves to a new group right above its old one (those that take it several times
further up). Phase two walks the suffixes in order: the suffixes whose next smaller suffix is the one just met are
reached over the same pointers, and each takes the next free place of its group. Nothing is renamed or sorted anew.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes of `symbols` in lexicographic order, a shorter one before those it begins."""
    n = len(symbols)
    if n == 0:
        return []
    # group ids; members may be stale, `group` holds the truth. lower[g] is the next group down.
    by_symbol: dict[int, list[int]] = {}
    for i, s in enumerate(symbols):
        by_symbol.setdefault(s, []).append(i)
    members: list[list[int]] = []
    lower: list[int] = []
    group = [0] * n
    upper: list[int] = []
    for k, s in enumerate(sorted(by_symbol)):
        members.append(by_symbol[s])
        lower.append(k - 1)
        upper.append(k + 1)
        for i in by_symbol[s]:
            group[i] = k
    members.append([])  # an empty group on top, so that every group has one above
    lower.append(len(members) - 2)
    upper.append(-1)
    done = -1  # in `group`: the suffix is in a group above the one processed
    previous = [-1] * n
    order: list[list[int]] = []  # final groups, from the largest down
    g = len(members) - 2
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = []
        if own:
            if len(own) > 1:
                own.sort()
            order.append(own)
            if len(own) == 1:
                i = own[0]
                j = i - 1
                while j >= 0 and group[j] == done:
                    j = previous[j]
                previous[i] = j
                group[i] = done
                if j >= 0:
                    q = group[j]
                    new = len(members)
                    members.append([j])
                    above = upper[q]
                    lower.append(q)
                    upper.append(above)
                    upper[q] = new
                    lower[above] = new
                    group[j] = new
            else:
                times: dict[int, int] = {}
                for i in own:
                    j = i - 1
                    while j >= 0 and ((q := group[j]) == done or q == g):
                        j = previous[j]
                    previous[i] = j
                    if j >= 0:
                        times[j] = times.get(j, 0) + 1
                for i in own:
                    group[i] = done
                most = max(times.values(), default=0)
                for t in range(most, 0, -1):
                    moved: dict[int, list[int]] = {}
                    for j, k in times.items():
                        if k == t:
                            moved.setdefault(group[j], []).append(j)
                    for q, js in moved.items():
                        new = len(members)
                        members.append(js)
                        above = upper[q]
                        lower.append(q)
                        upper.append(above)
                        upper[q] = new
                        lower[above] = new
                        for j in js:
                            group[j] = new
        g = lower[g]
    return _placed(n, previous, order)


def _placed(n: int, previous: list[int], order: list[list[int]]) -> list[int]:
    """Phase two: the order within the groups, from the groups (largest first) and previous smaller suffixes."""
    free = [0] * n  # of each suffix, the number of its group; of each group, its next free place
    starts, at = [], 0
    for k in range(len(order) - 1, -1, -1):
        for i in order[k]:
            free[i] = len(starts)
        starts.append(at)
        at += len(order[k])
    out = [0] * n
    i = n  # the empty suffix comes first
    for r in range(-1, n):
        if r >= 0:
            i = out[r]
        stop = previous[i] if i < n else -1
        j = i - 1
        while j >= 0 and j != stop:
            k = free[j]
            out[starts[k]] = j
            starts[k] += 1
            j = previous[j]
    return out
