"""Suffix array by grouping suffixes under their Lyndon prefixes: linear, without recursion on renamed texts."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of all suffixes of `text` in ascending order; a suffix is smaller than its own continuations.

    First, groups of suffixes are taken in descending order. The previous smaller pointer of a member is the nearest
    suffix before it in a lower group. Suffixes that k members point at have k copies of the group's word after what is
    known of them; they leave their group for a new one right above it, the more copies the higher. At the end a group
    holds the suffixes with the same longest Lyndon prefix. Then groups are filled in ascending order: what a placed
    suffix is the next smaller one of, along the pointers, takes the first free places of its groups.
    """
    n = len(text) + 1  # with an end smaller than all
    text = [*text, -1]
    group = [0] * n
    members: list[list[int]] = []
    at = {}
    for c in sorted(set(text)):
        at[c] = len(members)
        members.append([])
    for i, c in enumerate(text):
        g = group[i] = at[c]
        members[g].append(i)
    lower = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    before = list(range(-1, n - 1))
    done = bytearray(n)
    g = len(members) - 1
    while g >= 0:
        here = members[g]
        if len(here) > 1:
            here = members[g] = [i for i in here if group[i] == g]
        elif here and group[here[0]] != g:
            here = members[g] = []
        for i in here:
            done[i] = 1
        many: dict[int, int] = {}
        for i in here:
            p = before[i]
            while p >= 0 and done[p]:
                p = before[p]
            before[i] = p
            if p >= 0:
                many[p] = many.get(p, 0) + 1
        if len(many) == 1:
            (p, _), = many.items()
            parts = [((1, group[p]), [p])]
        else:
            split: dict[tuple[int, int], list[int]] = {}
            for p, k in many.items():
                split.setdefault((k, group[p]), []).append(p)
            parts = sorted(split.items(), reverse=True)
        for (_, old), ps in parts:
            new = len(members)
            members.append(ps)
            up = above[old]
            above.append(up)
            lower.append(old)
            above[old] = new
            lower[up] = new
            for p in ps:
                group[p] = new
        g = lower[g]
    start, total = [0] * len(members), 0
    g = next(i for i, x in enumerate(lower) if x == -1)
    while g >= 0:
        start[g] = total
        total += len(members[g])
        g = above[g]
    order = [-1] * n
    order[0] = n - 1
    free = bytearray(b"\1") * n
    free[n - 1] = 0
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and free[j]:
            g = group[j]
            order[start[g]] = j
            start[g] += 1
            free[j] = 0
            j = before[j]
    return order[1:]
