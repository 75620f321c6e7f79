"""Linear-time suffix sorting by Lyndon groups, and the longest common prefixes of neighbours.

Suffixes are grouped by a growing prefix that ends as the suffix's longest Lyndon prefix. Groups are taken from the highest down. Each member
points to the nearest earlier suffix of a lower group; members whose prefixes follow each other directly share that pointer and count up.
The suffixes pointed to have their prefixes extended by the group's prefix, as many times as counted, so inside their own groups they move above the
others, more repetitions higher. At the end groups stand in final order, and one scan from the lowest suffix emits each group's members:
a suffix that ends where an emitted one begins is the next of its group, and its pointers lead to the others that end there.
No names are computed anew and nothing recurs.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Positions of the suffixes in order. The end of the text counts as lower than any symbol."""
    n = len(text)
    if n < 2:
        return list(range(n))
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n  # of a suffix in order
    group = [0] * n  # first place of a suffix's group
    size = [0] * n  # by first place
    start = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            start = k
        place[i] = k
        group[i] = start
        size[start] += 1
    before = [-1] * n  # nearest earlier suffix of a lower group
    chain = [0] * n  # directly repeated group prefixes up to here
    end = n
    while end > 0:
        g = group[order[end - 1]]
        members = order[g:end]
        if len(members) > 1:
            members.sort()
        counts: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] > g:
                p = before[p]
            if p >= 0 and group[p] == g:
                c, p = chain[p] + 1, before[p]
            else:
                c = 1
            chain[i] = c
            before[i] = p
            if p >= 0:
                counts[p] = c
        # the suffixes pointed to move to the tops of their groups, by rising number of repetitions
        if counts:
            most = max(counts.values())
            if most == 1:
                levels = [list(counts)]
            else:
                levels = [[] for _ in range(most)]
                for p, c in counts.items():
                    levels[most - c].append(p)
            for level in levels:
                touched: dict[int, int] = {}
                for p in level:
                    h = group[p]
                    top = h + size[h] - 1 - touched.get(h, 0)
                    touched[h] = touched.get(h, 0) + 1
                    at = place[p]
                    if at != top:
                        q = order[top]
                        order[at] = q
                        place[q] = at
                        order[top] = p
                        place[p] = top
                for h, moved in touched.items():
                    left = size[h] - moved
                    if left:
                        first = h + left
                        size[h] = left
                        size[first] = moved
                        for k in range(first, first + moved):
                            group[order[k]] = first
        end = g
    # emission
    out = [-1] * n
    done = [False] * n
    filled = [0] * n
    i = -1
    p = n - 1  # suffixes that end with the text come first in their groups
    while True:
        while p >= 0 and not done[p]:
            done[p] = True
            g = group[p]
            out[g + filled[g]] = p
            filled[g] += 1
            p = before[p]
        i += 1
        if i == n:
            return out
        p = out[i] - 1


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """For each place k > 0, how many symbols the suffixes at k - 1 and k share; 0 at place 0."""
    n = len(text)
    place = [0] * n
    for k, i in enumerate(order):
        place[i] = k
    out = [0] * n
    shared = 0
    for i in range(n):
        k = place[i]
        if not k:
            shared = 0
            continue
        j = order[k - 1]
        while i + shared < n and j + shared < n and text[i + shared] == text[j + shared]:
            shared += 1
        out[k] = shared
        if shared:
            shared -= 1
    return out
