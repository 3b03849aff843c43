"""Cover trees over blocks of vectors, searched for large inner products.

Vectors get one coordinate more, so that all have the same norm; the distance
between two of them then bounds how far their inner products with a query can
differ: |q.x - q.c| <= |q| * dist(x, c). A node covers its members within a
radius around a centre that is one of them; its children are a net of members
at a smaller radius.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

LEAF = 128  # members of a node that isn't split further
SHRINK = 1.5  # radius of a node over that of its children's net
SLACK = 1e-6  # relative allowance for rounding in distances


@dataclass
class Tree:
    """Node i has its centre at row centre[i], covers the rows
    order[lo[i]:hi[i]] within radius[i], and its children are the nodes
    child[i] to child[i] + kids[i]; a leaf has none."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    child: np.ndarray
    kids: np.ndarray


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    """Append the coordinate that brings every row to the same norm."""
    rest = np.sqrt(np.maximum(norm * norm - np.square(x).sum(axis=1), 0.0))
    return np.column_stack([x, rest])


def _net(x: np.ndarray, rows: np.ndarray, dist: np.ndarray, radius: float, most: int) -> list | None:
    """Members within ``radius`` of centres among them, one group each: the
    node's own centre, then always the member furthest from all before. None
    if it takes more than ``most`` centres."""
    groups, left, near = [], rows, dist
    centre = rows[np.argmin(dist)]
    away = near
    while True:
        inside = away <= radius
        groups.append((int(centre), left[inside], away[inside]))
        left, near = left[~inside], near[~inside]
        if not len(left):
            return groups
        if len(groups) >= most:
            return None
        centre = left[np.argmax(near)]
        away = np.sqrt(np.square(x[left] - x[centre]).sum(axis=1))
        near = np.minimum(near, away)


def build(x: np.ndarray) -> Tree:
    """A tree over the rows of ``x`` (augmented, at least one). A node whose
    net would hardly be smaller than itself stays a leaf."""
    rows = np.arange(len(x))
    dist = np.sqrt(np.square(x - x[0]).sum(axis=1))
    nodes: list[list] = [[0, rows, dist, 0, 0]]
    at = 0
    while at < len(nodes):
        _, rows, dist, _, _ = nodes[at]
        top = dist.max()
        if len(rows) > LEAF and top > 0:
            groups = _net(x, rows, dist, top / SHRINK, max(2, len(rows) // 16))
            if groups is not None and len(groups) > 1:
                nodes[at][3:] = [len(nodes), len(groups)]
                nodes += [[*g, 0, 0] for g in groups]
        at += 1
    # children follow their parents, so ranges can be laid out from the leaves
    order, lo, hi = [], np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    stack, total = [(0, False)], 0
    while stack:
        i, done = stack.pop()
        child, kids = nodes[i][3:]
        if not kids:
            lo[i] = total
            order.append(np.sort(nodes[i][1]))
            total += len(nodes[i][1])
            hi[i] = total
        elif done:
            lo[i], hi[i] = lo[child : child + kids].min(), hi[child : child + kids].max()
        else:
            stack.append((i, True))
            stack += [(c, False) for c in range(child, child + kids)]
    return Tree(
        np.concatenate(order),
        np.array([n[0] for n in nodes]),
        np.array([n[2].max() for n in nodes]),
        lo,
        hi,
        np.array([n[3] for n in nodes]),
        np.array([n[4] for n in nodes]),
    )


def descend(tree: Tree, x: np.ndarray, q: np.ndarray, open_for, visit) -> int:
    """Best-first descent of all queries ``q`` together.

    ``open_for(queries, least, most)`` says for which of the queries (indices
    into q) products between ``least`` and ``most`` may still matter;
    ``visit(queries, rows)`` takes the members of a leaf. The node with the
    largest bound of any open query comes first; queries leave a node as soon
    as their bounds are outside what they look for. Returns the number of
    (query, member) pairs in leaves that were visited.
    """
    size = np.sqrt(np.square(q).sum(axis=1))
    pairs = 0

    def bounds(node: int, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = q[who] @ x[tree.centre[node]]
        reach = size[who] * tree.radius[node] * (1 + SLACK) + SLACK * (1 + np.abs(middle))
        return middle - reach, middle + reach

    everyone = np.arange(len(q))
    low, high = bounds(0, everyone)
    heap = [(-high.max(initial=-np.inf), 0, everyone, low, high)]
    while heap:
        _, node, who, low, high = heapq.heappop(heap)
        still = open_for(who, low, high)
        if not still.any():
            continue
        who = who[still]
        if not tree.kids[node]:
            rows = tree.order[tree.lo[node] : tree.hi[node]]
            pairs += len(who) * len(rows)
            visit(who, rows)
            continue
        for c in range(tree.child[node], tree.child[node] + tree.kids[node]):
            low, high = bounds(c, who)
            heapq.heappush(heap, (-high.max(), c, who, low, high))
    return pairs
