"""A prefix tree over ordered sets, and the sets in it that are similar to a probe.

Tokens are ordered by how many sets hold them, frequent ones first, so that similar sets share long paths. The tree is kept as branches:
a set's branch is the end of its sequence that the set before it doesn't have, and hangs from another branch at some depth.
A probe walks all branches of a level at once. The overlap with a shared path is counted once for all sets that end below it, and a
branch is left out with all that hangs from it if the tokens that remain can't bring the similarity any more.
"""

from __future__ import annotations

import numpy as np


class PrefixTree:
    """sizes: of the whole sets, which may also have tokens that no other set has and that aren't given; tokens: flat; counts: how many tokens of each set are given."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, sizes: np.ndarray, percent: int) -> None:
        n, self.percent = len(counts), percent
        known, inverse, often = np.unique(tokens, return_inverse=True, return_counts=True)
        rank = np.empty(len(known), np.int32)
        rank[np.lexsort((known, -often))] = np.arange(len(known), dtype=np.int32)
        ranks = rank[inverse]
        ranks = ranks[np.lexsort((ranks, np.repeat(np.arange(n), counts)))]
        cuts = np.append(0, np.cumsum(counts)).tolist()
        path = ranks.astype(">u4")
        keys = [path[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        #: Sets in the order of the tree, as places in the input.
        self.order = np.array(sorted(range(n), key=keys.__getitem__), np.int64)
        self.sets = [ranks[cuts[i] : cuts[i + 1]] for i in self.order.tolist()]
        self.sizes, self.marks = sizes[self.order].astype(np.int64), np.zeros(len(known), bool)
        self._branches(n)

    def _branches(self, n: int) -> None:
        attach, parent, until = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, n, np.int64)
        open_: list[int] = []  # the branches of the last set's path
        for i, own in enumerate(self.sets):
            depth = 0
            if i:
                last = self.sets[i - 1]
                m = min(len(last), len(own))
                other = last[:m] != own[:m]
                depth = int(other.argmax()) if other.any() else m
            while open_ and attach[open_[-1]] >= depth:
                until[open_.pop()] = i
            attach[i], parent[i] = depth, open_[-1] if open_ else -1
            open_.append(i)
        self.attach, self.parent, self.until = attach, parent, until
        lengths = np.fromiter(map(len, self.sets), np.int64, n)
        self.deepest, self.least, self.most = lengths.copy(), self.sizes.copy(), self.sizes.copy()
        for i in range(n - 1, -1, -1):
            if (p := parent[i]) >= 0:
                self.deepest[p], self.least[p], self.most[p] = max(self.deepest[p], self.deepest[i]), min(self.least[p], self.least[i]), max(self.most[p], self.most[i])
        self.length = lengths - attach
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.concatenate([s[d:] for s, d in zip(self.sets, attach.tolist())]) if n else np.zeros(0, np.int32)
        by_parent = np.argsort(parent, kind="stable")
        held = np.bincount(parent + 1, minlength=n + 1)
        ends = np.cumsum(held)
        self.children, self.child_from, self.child_count = by_parent, (ends - held)[1:], held[1:]
        self.roots = by_parent[: held[0]]
        self.base, self.hits = np.zeros(n, np.int64), np.zeros(len(self.flat), np.int64)

    def similar(self, x: int, wanted: np.ndarray) -> np.ndarray:
        """Which of the `wanted` sets are at least `percent` similar to set x, both as places in the tree's order."""
        own, size, t = self.sets[x], self.sizes[x], self.percent
        before = np.append(0, np.cumsum(wanted))
        useful = before[self.until] > before[:-1]  # a wanted set ends on the branch or below it
        useful &= (100 * self.most >= t * size) & (t * self.least <= 100 * size)
        self.marks[own] = True
        found, at = [], self.roots[useful[self.roots]]
        while len(at):
            depth, up = self.attach[at], self.parent[at]
            last = np.where(up >= 0, self.start[up] + depth - self.attach[up] - 1, 0)  # of the shared path
            shared = np.where(up >= 0, self.base[up] + (self.hits[last] if len(self.hits) else 0), 0)
            passed = np.where(up >= 0, np.searchsorted(own, self.flat[last], "right") if len(self.flat) else 0, 0)
            most = shared + np.minimum(len(own) - passed, self.deepest[at] - depth)
            may = (100 + t) * most >= t * (size + self.least[at])
            at, shared = at[may], shared[may]
            if not len(at):
                break
            n, start = self.length[at], self.start[at]
            ends = np.cumsum(n)
            place = np.arange(int(ends[-1])) + np.repeat(start - (ends - n), n)
            total = np.append(0, np.cumsum(self.marks[self.flat[place]]))
            self.hits[place] = total[1:] - np.repeat(total[ends - n], n)
            self.base[at] = shared
            both = shared + total[ends] - total[ends - n]
            close = wanted[at] & (100 * both >= t * (size + self.sizes[at] - both))
            found.append(at[close])
            few = self.child_count[at]
            ends = np.cumsum(few)
            below = self.children[np.arange(int(ends[-1])) + np.repeat(self.child_from[at] - (ends - few), few)]
            at = below[useful[below]]
        self.marks[own] = False
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def spanning_links(tokens: np.ndarray, counts: np.ndarray, sizes: np.ndarray, group: np.ndarray, probes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of which one is a probe, as places in the input, that connect whatever is connected.

    Sets of one `group` are connected already: they are never compared, nor those that links found so far connect.
    """
    tree = PrefixTree(tokens, counts, sizes, percent)
    _, group = np.unique(group[tree.order], return_inverse=True)
    probe, place, out = probes[tree.order], np.arange(len(group)), []
    for x in np.flatnonzero(probe).tolist():
        wanted = (group != group[x]) & ((place > x) | ~probe)
        if not wanted.any():
            continue
        for y in tree.similar(x, wanted).tolist():
            if group[x] != group[y]:
                out.append((int(tree.order[x]), int(tree.order[y])))
                group[group == group[y]] = group[x]
    return out
