"""Dominators and dominance frontiers of a graph given as successor lists (nodes 0 to n-1, entered at one root)."""

from __future__ import annotations


def postorder(root: int, after: list[list[int]]) -> list[int]:
    """The nodes that the root reaches, each after what follows from it (but for edges back)."""
    out, seen, work = [], {root}, [(root, 0)]
    while work:
        n, i = work.pop()
        if i < len(after[n]):
            work.append((n, i + 1))
            if (m := after[n][i]) not in seen:
                seen.add(m)
                work.append((m, 0))
        else:
            out.append(n)
    return out


def dominators(root: int, after: list[list[int]]) -> list[int]:
    """The immediate dominator of each node: the last other node on every way to it. The root has itself, nodes out of reach have -1."""
    order = postorder(root, after)
    place = {n: i for i, n in enumerate(order)}
    before: list[list[int]] = [[] for _ in after]
    for n in order:
        for m in after[n]:
            before[m].append(n)
    up = [-1] * len(after)
    up[root] = root
    changed = True
    while changed:
        changed = False
        for n in reversed(order[:-1]):
            new = -1
            for p in before[n]:
                if up[p] < 0:
                    continue
                if new < 0:
                    new = p
                    continue
                a, b = p, new
                while a != b:
                    while place[a] < place[b]:
                        a = up[a]
                    while place[b] < place[a]:
                        b = up[b]
                new = a
            if new != up[n]:
                up[n] = new
                changed = True
    return up


def frontiers(up: list[int], after: list[list[int]]) -> list[list[int]]:
    """Of each node the nodes where its dominance ends: a predecessor is dominated by it, they themselves are not."""
    out: list[dict[int, None]] = [{} for _ in after]
    for n, to in enumerate(after):
        if up[n] < 0:
            continue
        for m in to:
            at = n
            while at != up[m]:
                out[at][m] = None
                if at == up[at]:
                    break
                at = up[at]
            else:
                continue
    return [list(x) for x in out]


def chain(n: int, up: list[int]) -> list[int]:
    """The dominators of n, itself first."""
    out = []
    while n >= 0:
        out.append(n)
        if up[n] == n:
            break
        n = up[n]
    return out
