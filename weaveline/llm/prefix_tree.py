"""Prefix-tree similarity join of a block of sets.

Sets are ascending arrays under one global order (rare n-grams first). They are stored in a
path-compressed trie; a set that is looked up walks the trie once, carrying the overlap so far,
which all sets below a node share. A subtree is left as soon as the n-grams missed on either
side exceed what the remaining lengths allow, or when all its sets are known to be in the
component of the set that is looked up.

Jaccard >= 0.8 means: the symmetric difference is at most a ninth of the sum of both sizes.
"""

from __future__ import annotations

import numpy as np

STEP = 48


def prefix_length(n: int) -> int:
    """So many first n-grams must meet those of any partner (threshold 0.8)."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


class Groups:
    """Union-find; the root is the smallest index."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


class Node:
    __slots__ = ("segment", "kids", "ends", "low", "high", "alone", "one")

    def __init__(self, segment, size, alone, one):
        self.segment, self.kids, self.ends, self.low, self.high, self.alone, self.one = segment, {}, [], size, size, alone, one


class Trie:
    """Sets are given by the n-grams that others hold too, and the number `alone` of those that none does."""

    def __init__(self, groups: Groups):
        self.root, self.groups = Node(np.zeros(0, np.int64), 0, 0, -2), groups

    def insert(self, item: int, x: np.ndarray, alone: int) -> None:
        size, at, node, find = len(x) + alone, 0, self.root, self.groups.find
        while True:
            if node is not self.root:
                node.low, node.high, node.alone = min(node.low, size), max(node.high, size), min(node.alone, alone)
                if node.one >= 0 and find(node.one) != find(item):
                    node.one = -2
            if at == len(x):
                node.ends.append((item, size))
                return
            kid = node.kids.get(int(x[at]))
            if kid is None:
                node.kids[int(x[at])] = new = Node(x[at:], size, alone, item)
                new.ends.append((item, size))
                return
            n = min(len(kid.segment), len(x) - at)
            differ = np.flatnonzero(kid.segment[:n] != x[at : at + n])
            same = int(differ[0]) if len(differ) else n
            if same < len(kid.segment):  # split the path
                upper = Node(kid.segment[:same], kid.low, kid.alone, kid.one)
                upper.high = kid.high
                kid.segment = kid.segment[same:]
                upper.kids[int(kid.segment[0])] = kid
                node.kids[int(x[at])] = kid = upper
            at += same
            node = kid

    def join(self, item: int, x: np.ndarray, alone: int, first: set[int]) -> None:
        """Join item with every stored set that is similar to x and not yet in its component.

        first: first n-grams of the stored sets that share an n-gram of their prefix with x.
        """
        size, groups, kids = len(x) + alone, self.groups, self.root.kids
        stack = [(kids[f], 0, 0) for f in first if f in kids]
        while stack:
            node, depth, shared = stack.pop()
            if 5 * node.high < 4 * size or 4 * node.low > 5 * size:
                continue
            if node.one >= 0 and groups.find(node.one) == groups.find(item):
                continue
            allowed = (size + min(node.high, size * 5 // 4)) // 9 - alone - node.alone
            for lo in range(0, len(node.segment), STEP):
                part = node.segment[lo : lo + STEP]
                place = np.searchsorted(x, part)
                shared += int(np.count_nonzero(x[np.minimum(place, len(x) - 1)] == part))
                depth += len(part)
                passed = int(place[-1])  # n-grams of x before the last of the segment
                if (depth - shared) + max(0, passed - shared) > allowed:
                    break
            else:
                for other, n in node.ends:
                    if 9 * (size + n - 2 * shared) <= size + n:
                        groups.join(item, other)
                stack.extend((kid, depth, shared) for kid in node.kids.values())


def _starts(token: np.ndarray) -> np.ndarray:
    """Where runs of equal tokens begin."""
    new = np.ones(len(token), bool)
    np.not_equal(token[1:], token[:-1], out=new[1:])
    return np.flatnonzero(new)


def _held(token: np.ndarray) -> np.ndarray:
    """For each of ascending tokens how often it occurs."""
    many = np.diff(_starts(token), append=len(token)).astype(np.int32)
    return np.repeat(many, many)


def join_block(sets: list[np.ndarray], known: list[int] | None = None) -> list[int]:
    """For each set the smallest index in its component of Jaccard >= 0.8 links.

    known: for each set the first index that is known to share its component. Within the block
    n-grams are ordered by the number of sets that hold them, rarest first. A set with as many
    n-grams of its own as its prefix is long has no partner here and leaves at once, which may
    leave others without one.
    """
    n = len(sets)
    groups = Groups(n)
    for i, j in enumerate(known or []):
        groups.join(i, j)
    sizes = np.array([len(s) for s in sets], np.int64)
    prefix = np.array([prefix_length(int(k)) for k in sizes], np.int64)
    token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    del sets
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    del order
    while True:
        held = _held(token)
        common = held > 1
        token, owner, held = token[common], owner[common], held[common]
        shared = np.bincount(owner, minlength=n)
        stays = (sizes - shared < prefix)[owner]
        if stays.all():
            break
        token, owner = token[stays], owner[stays]
    del common, stays
    if not len(token):
        return [groups.find(i) for i in range(n)]
    start = _starts(token)
    many = np.diff(start, append=len(token))
    place = np.empty(len(start), np.int32)
    place[np.lexsort((token[start], held[start]))] = np.arange(len(start))
    del token, held
    rank = np.repeat(place, many)
    order = np.lexsort((rank, owner))
    rank, owner = rank[order].astype(np.int64), owner[order]
    del order
    items = np.unique(owner)
    cut = np.append(np.searchsorted(owner, items), len(owner))
    lists = [rank[a:b] for a, b in zip(cut[:-1], cut[1:])]
    alone = [int(sizes[i]) - len(x) for i, x in zip(items, lists)]
    heads = [x[: max(0, int(prefix[i]) - a)] for i, x, a in zip(items, lists, alone)]
    head = np.concatenate(heads)
    who = np.repeat(np.arange(len(items)), [len(h) for h in heads])
    order = np.argsort(head, kind="stable")
    head, who = head[order], who[order]
    trie, lead = Trie(groups), np.array([int(x[0]) for x in lists])
    for k, (i, x) in enumerate(zip(items.tolist(), lists)):
        lo, hi = np.searchsorted(head, heads[k], "left"), np.searchsorted(head, heads[k], "right")
        met = [who[a:b] for a, b in zip(lo, hi) if b - a > 1]
        if met:
            met = np.unique(np.concatenate(met))
            trie.join(i, x, alone[k], set(lead[met[met < k]].tolist()))
        trie.insert(i, x, alone[k])
    return [groups.find(i) for i in range(n)]
