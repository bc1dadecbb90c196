"""A small trie in plain Python that the dictionary is held against."""

from collections import deque

import numpy as np


class Model:
    def __init__(self, pairs, order="weight"):
        weights: dict[bytes, float] = {}
        for k, w in pairs:
            weights[k] = weights.get(k, 0.0) + float(np.float32(w))
        self.keys = weights
        prefixes = {k[:i] for k in weights for i in range(len(k) + 1)} | {b""}
        following: dict[bytes, set[int]] = {p: set() for p in prefixes}
        for p in prefixes:
            if p:
                following[p[:-1]].add(p[-1])
        self.nodes = {p for p in prefixes if p == b"" or p in weights or len(following[p]) > 1}
        children: dict[bytes, list[bytes]] = {p: [] for p in self.nodes}
        self.parent = {}
        for p in self.nodes - {b""}:
            up = next(p[:i] for i in range(len(p) - 1, -1, -1) if p[:i] in self.nodes)
            children[up].append(p)
            self.parent[p] = up
        below = {p: np.float32(sum(w for k, w in weights.items() if k.startswith(p))) for p in self.nodes}
        for c in children.values():
            c.sort(key=lambda p: (-below[p] if order == "weight" else 0, p))
        queue, breadth = deque([b""]), []
        while queue:
            p = queue.popleft()
            breadth.append(p)
            queue.extend(children[p])
        self.ids = {p: i for i, p in enumerate(x for x in breadth if x in weights)}
        self.preorder = []
        stack = [b""]
        while stack:
            p = stack.pop()
            if p in weights:
                self.preorder.append(p)
            stack += children[p][::-1]
