"""BK-trees over 64-bit values, built and searched level by level for many trees at once."""

from __future__ import annotations

import numpy as np

WIDE = 65  # distances of 64-bit values are 0 to 64


class Forest:
    """One tree per group of equal ``tree`` numbers (ascending); a child hangs on the edge of its distance to the parent."""

    def __init__(self, values: np.ndarray, tree: np.ndarray) -> None:
        self.values = values
        first = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]])) if len(tree) else np.zeros(0, np.int64)
        self.root_of = dict(zip(tree[first].tolist(), first.tolist()))
        under = np.repeat(first, np.diff(np.concatenate([first, [len(tree)]])))
        waiting = np.setdiff1d(np.arange(len(values)), first, assume_unique=True)
        parent = under[waiting]
        edges, nodes = [], []
        while len(waiting):
            slot = parent * WIDE + np.bitwise_count(values[waiting] ^ values[parent]).astype(np.int64)
            taken, at, of = np.unique(slot, return_index=True, return_inverse=True)
            edges.append(taken)
            nodes.append(waiting[at])
            parent = waiting[at][of]
            rest = np.ones(len(waiting), bool)
            rest[at] = False
            waiting, parent = waiting[rest], parent[rest]
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        order = np.argsort(self.edges, kind="stable")
        self.edges, self.nodes = self.edges[order], np.concatenate(nodes)[order] if nodes else np.zeros(0, np.int64)

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int):
        """Yields (query numbers, node numbers) within ``radius``; only edges that can lead there are followed."""
        query, node = np.arange(len(queries)), roots
        while len(query):
            far = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            hit = far <= radius
            yield query[hit], node[hit]
            low = np.searchsorted(self.edges, node * WIDE + np.maximum(far - radius, 0), "left")
            high = np.searchsorted(self.edges, node * WIDE + np.minimum(far + radius, WIDE - 1), "right")
            times = high - low
            query = np.repeat(query, times)
            node = self.nodes[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merges the groups of linked positions; a label is the smallest position of its group."""
    while True:
        left, right = label[a], label[b]
        differ = left != right
        if not differ.any():
            return label
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(left, right)[differ], np.minimum(left, right)[differ])
        while (label[label] != label).any():
            label = label[label]
