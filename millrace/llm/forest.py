"""Many BK-trees over fingerprints of two words, built and searched at once.

Every tree holds the fingerprints of one shard. A child hangs on its parent by their Hamming
distance; a search at distance d from a node follows only the edges from d - radius to d + radius.
Fingerprints are numbered so that everything below a node has a higher number than the node; a
search stays below the number of the one that asks, so each pair is looked at once.
"""

from __future__ import annotations

import numpy as np

from millrace.llm.simhash import _roots

WIDTH = 128
# Members tried as the centre of a tree; that with most neighbours becomes the root.
_CENTRES = 8
# Pairs of a batch of searches before pruning.
_VISITS = 200_000


def _apart(prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of prints[:, a[i]] and prints[:, b[i]]."""
    low, high = prints
    return np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b])


def _build(prints: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of all nodes, ordered by parent and distance, and where those of parent p at
    distance d begin: at place p * (WIDTH + 1) + d. ``roots``: the root of every node."""
    n = len(roots)
    parent, label = np.full(n, -1), np.zeros(n, np.int64)
    above, rest = roots.copy(), np.flatnonzero(roots != np.arange(n))
    while len(rest):
        key = above[rest] * (WIDTH + 1) + _apart(prints, rest, above[rest])
        edges, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        heads = rest[first]
        parent[heads], label[heads] = edges // (WIDTH + 1), edges % (WIDTH + 1)
        above[rest] = heads[inverse]
        rest = np.delete(rest, first)
    below = np.flatnonzero(parent >= 0)
    place = parent[below] * (WIDTH + 1) + label[below]
    begins = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=n * (WIDTH + 1)))])
    return below[np.argsort(place, kind="stable")], begins


def groups(shard: np.ndarray, prints: np.ndarray, sizes: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, int]:
    """A member of its group for every fingerprint, the same for all of the group, and the number of
    nodes visited.

    ``shard``: ascending numbers; a group is what links of ``radius`` or fewer bits connect within a
    shard, between sizes of which the lesser is ``similarity`` of the greater or more. Those
    that link to the root, chosen for having many, are one group from the start and do not search;
    all others search among them and before themselves, so that no link between groups is lost.
    """
    n = len(shard)
    _, starts, tree, counts = np.unique(shard, return_index=True, return_inverse=True, return_counts=True)

    def near(a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
        return (distance <= radius) & (np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-9)

    everyone, draw = np.arange(n), np.random.default_rng(0)
    centre, most, around = starts.copy(), np.zeros(len(starts), np.int64), np.zeros(n, bool)
    for _ in range(_CENTRES):
        tried = starts + draw.integers(0, counts)
        linked = near(everyone, tried[tree], _apart(prints, everyone, tried[tree]))
        found = np.bincount(tree[linked], minlength=len(starts))
        better = found > most
        centre[better], most[better] = tried[better], found[better]
        around = np.where(better[tree], linked, around)
    rank = np.where(everyone == centre[tree], 0, np.where(around, 1, 2))
    order = np.lexsort((rank, tree))
    prints, sizes, rank = prints[:, order], sizes[order], rank[order]
    roots = starts[tree]
    children, begins = _build(prints, roots)

    label = np.where(rank == 2, everyone, roots)
    queries, visited = np.flatnonzero(rank == 2), 0
    batch = np.cumsum(queries - roots[queries]) // _VISITS
    for number in np.unique(batch):
        asked = queries[batch == number]
        at, pairs = roots[asked], []
        while len(asked):
            visited += len(asked)
            distance = _apart(prints, asked, at)
            linked = near(asked, at, distance)
            pairs.append((asked[linked], at[linked]))
            low = begins[at * (WIDTH + 1) + np.maximum(distance - radius, 0)]
            number_of = begins[at * (WIDTH + 1) + np.minimum(distance + radius, WIDTH) + 1] - low
            asked = np.repeat(asked, number_of)
            at = children[np.repeat(low - np.cumsum(number_of) + number_of, number_of) + np.arange(len(asked))]
            before = at < asked
            asked, at = asked[before], at[before]
        label = _roots(label, *(np.concatenate(ends) for ends in zip(*pairs)))
    result = np.empty(n, np.int64)
    result[order] = order[label]
    return result, visited
