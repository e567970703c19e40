"""Heavy-path decomposition of many small forests at once, in numpy."""

from __future__ import annotations

import numpy as np

NONE = -1


def parents(group: np.ndarray, node: np.ndarray, parent: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Row number of each row's parent within its group, or -1; (group, node) is unique."""
    n = len(node)
    if not n:
        return np.empty(0, np.int64)
    _, g = np.unique(group, return_inverse=True)
    values, codes = np.unique(np.concatenate([node, np.where(has, parent, node)]), return_inverse=True)
    key = g * len(values) + codes[:n]
    order = np.argsort(key, kind="stable")
    want = g * len(values) + codes[n:]
    at = np.minimum(np.searchsorted(key[order], want), n - 1)
    found = has & (key[order][at] == want)
    return np.where(found, order[at], NONE)


def decompose(up: np.ndarray, rank: np.ndarray) -> dict[str, np.ndarray]:
    """Chains of a forest given by parent rows; ``rank`` breaks ties between children of one size.

    cyclic: the row lies on a cycle or below one (its other values are -1).
    size: rows in its subtree; head: row at the head of its chain; pos: place
    in the chain; root and depth, found by climbing from chain to chain; pre:
    number of the row in its tree, parents first, then the child on the chain,
    then the others by ``rank``, so the rows below one are the ``size`` - 1 next.
    """
    n = len(up)
    # Cycle separation by pointer doubling: n is the place above every root.
    jump = np.append(np.where(up == NONE, n, up), n)
    dist = np.append(np.ones(n, np.int64), 0)
    for _ in range(max(1, n.bit_length())):
        if (jump[:n] == n).all():
            break
        dist = dist + dist[jump]
        jump = jump[jump]
    cyclic = jump[:n] != n
    level = np.where(cyclic, NONE, dist[:n] - 1)

    size = np.ones(n, np.int64)
    order = np.argsort(level, kind="stable")
    order = order[level[order] >= 0]
    bounds = np.searchsorted(level[order], np.arange(level.max(initial=-1) + 2))
    levels = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    for rows in reversed(levels[1:]):
        np.add.at(size, up[rows], size[rows])

    heavy = np.zeros(n, bool)
    kids = order[up[order] != NONE]
    kids = kids[np.lexsort((rank[kids], -size[kids], up[kids]))]
    if len(kids):
        heavy[kids[np.append(True, up[kids][1:] != up[kids][:-1])]] = True
    head = np.arange(n)
    for rows in levels[1:]:
        down = rows[heavy[rows]]
        head[down] = head[up[down]]
    pos = level - level[head]

    root = head.copy()
    base = np.zeros(n, np.int64)
    while True:
        above = np.where(cyclic, NONE, up[root])
        more = above != NONE
        if not more.any():
            break
        base[more] += pos[above[more]] + 1
        root[more] = head[above[more]]
    depth = base + pos

    pre = np.zeros(n, np.int64)
    kids = kids[np.lexsort((rank[kids], ~heavy[kids], up[kids]))]
    before = np.append(0, np.cumsum(size[kids])[:-1])
    firsts = np.searchsorted(up[kids], up[kids])
    off = np.zeros(n, np.int64)
    off[kids] = 1 + before - before[firsts]
    for rows in levels[1:]:
        pre[rows] = pre[up[rows]] + off[rows]
    for x in (size, head, pos, root, depth, pre):
        x[cyclic] = NONE
    return {"cyclic": cyclic, "size": size, "head": head, "pos": pos, "root": root, "depth": depth, "pre": pre}
