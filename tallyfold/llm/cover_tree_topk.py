"""Exact top-k by integer inner product: a dual-tree search of two cover trees.

The rows are dealt into blocks and the queries into groups; each one's cover tree is built
once and written. Both trees are descended together. A pair of nodes is pruned when the
best inner product that their covering radii allow is below the worst kth score in the
query node, so equal scores survive and ties go to the smaller id exactly. Blocks come in
two waves: what a first part of them gives bounds every query's kth score in the others.

A node's children have centres picked farthest first until all its rows lie within half
its radius of one, or there are as many children as leaves fit into the node; rows go to
their nearest centre, and radii are those of the rows that a node has. So there are levels
on data of any dimension, though only where radii are small beside the distances of
clusters do bounds prune: DualTree.pairs tells how many pairs were compared.

Null ids, and vectors that are null or hold null or non-finite components, take no
part. Of repeated ids the least vector stays; shorter vectors count as continued
with zeros. Components are floor(1024 * x) and must lie within +-2^31, their inner
products within a long. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .vector_blocks import QUERY_BLOCK, best, dump, packed, search, usable

BLOCK, LEAF, QUERY_LEAF = 4096, 64, 8


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Nodes in breadth-first order over a permutation of the rows; a node's rows are lo to hi of it."""
    perm = np.arange(len(x))
    lo, hi, radius, kid, centre = [0], [len(x)], [], [], []
    at = 0
    while at < len(lo):
        a, b = lo[at], hi[at]
        rows = x[perm[a:b]]
        middle = rows[((rows - rows.mean(axis=0)) ** 2).sum(axis=1).argmin()] if b > a else np.zeros(x.shape[1])
        d = ((rows - middle) ** 2).sum(axis=1)
        radius.append(float(np.sqrt(d.max(initial=0))))
        centre.append(middle)
        kid.append((0, 0))
        if b - a > leaf and radius[at] > 0:
            near, owner, k = d, np.zeros(b - a, np.int64), 1
            while k < 2 * -(-(b - a) // leaf) and near.max() > (radius[at] / 2) ** 2:
                to = ((rows - rows[near.argmax()]) ** 2).sum(axis=1)
                owner[to < near] = k
                near = np.minimum(near, to)
                k += 1
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(k + 1))
            sizes = [(int(p), int(q)) for p, q in zip(ends[:-1], ends[1:], strict=True) if q > p]
            if len(sizes) > 1:
                perm[a:b] = perm[a:b][order]
                kid[at] = (len(lo), len(lo) + len(sizes))
                lo += [a + p for p, _ in sizes]
                hi += [a + q for _, q in sizes]
        at += 1
    return {"perm": perm, "lo": np.array(lo), "hi": np.array(hi), "radius": np.array(radius), "kid": np.array(kid).reshape(-1, 2), "centre": np.array(centre)}


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows."""
    if max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * a.shape[1] < 2**52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class DualTree:
    """A search of queries' k best rows; pairs counts the pairs of a query and a row whose product was computed."""

    def __init__(self, ask: dict, tree: dict, k: int) -> None:
        self.qt, self.rt, self.k, self.pairs = ask, tree, k, 0
        self.qx, self.rx = _padded(ask["x"], tree["x"].astype(np.float64))
        self.qc, self.rc = _padded(ask["centre"], tree["centre"])
        self.q_norm, self.r_norm = (np.sqrt((c**2).sum(axis=1)) for c in (self.qc, self.rc))
        n = len(ask["ids"])
        self.kth = ask["kth"].copy() if "kth" in ask else np.full(n, -np.inf)
        self.tops = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(n)]

    def bound(self, q, r) -> np.ndarray:
        """No row below r scores more with a query below q; q or r is an array."""
        s = (self.qc[q] * self.rc[r]).sum(axis=-1) + self.qt["radius"][q] * self.r_norm[r] + self.rt["radius"][r] * (self.q_norm[q] + self.qt["radius"][q])
        return s * (1 + 1e-9) * (s > 0) + s * (1 - 1e-9) * (s <= 0) + 1

    def compare(self, q: int, r: int) -> None:
        queries, rows = self.qt["perm"][self.qt["lo"][q] : self.qt["hi"][q]], self.rt["perm"][self.rt["lo"][r] : self.rt["hi"][r]]
        scores, rid = _product(self.qx[queries], self.rx[rows]), self.rt["ids"][rows]
        self.pairs += scores.size
        good = (scores >= self.kth[queries][:, None]) & (rid != self.qt["ids"][queries][:, None])
        for i in np.flatnonzero(good.any(axis=1)):
            j, own = queries[i], good[i]
            ids, new = np.concatenate([self.tops[j][0], rid[own]]), np.concatenate([self.tops[j][1], scores[i][own]])
            if len(new) > 8 * self.k:
                far = np.partition(new, len(new) - self.k)[len(new) - self.k]
                ids, new = ids[new >= far], new[new >= far]
            keep = best(ids, new, self.k)
            self.tops[j] = ids[keep], new[keep]
            if len(keep) == self.k:
                self.kth[j] = max(self.kth[j], new[keep[-1]])

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, row ids and scores of the best rows, those below a known kth score left out."""
        stack, q_perm, q_radius = [(0, 0, np.inf)], self.qt["perm"], self.qt["radius"]
        while stack:
            q, r, most = stack.pop()
            if most < self.kth[q_perm[self.qt["lo"][q] : self.qt["hi"][q]]].min(initial=np.inf):
                continue
            (qa, qb), (ra, rb) = self.qt["kid"][q], self.rt["kid"][r]
            if qa == qb and ra == rb:
                self.compare(q, r)
            elif ra == rb or (qa < qb and q_radius[q] > self.rt["radius"][r]):
                kids = np.arange(qa, qb)
                b = self.bound(kids, r)
                stack += [(int(kids[i]), r, b[i]) for i in np.argsort(b)]
            else:
                kids = np.arange(ra, rb)
                b = self.bound(q, kids)
                stack += [(q, int(kids[i]), b[i]) for i in np.argsort(b)]
        lens = [len(t[0]) for t in self.tops]
        return np.repeat(self.qt["ids"], lens), np.concatenate([t[0] for t in self.tops]), np.concatenate([t[1] for t in self.tops])


def _padded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def exact_topk(vectors: DataFrame, queries: str, k: int = 10, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows for each row that meets the condition queries."""
    v, index, asked = _trees(vectors, queries, block)
    return search(index, asked, k, lambda ask, tree: DualTree(ask, tree, k).run(), "long")


def _trees(vectors: DataFrame, queries: str, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The usable vectors, the rows' trees by block, and the queries' trees by group."""
    v = usable(vectors, zero=True).withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * 1024).cast("double")))

    def make(leaf: int):
        return lambda ids, x: dump(ids=ids, x=x.astype(np.int32) if np.abs(x).max(initial=0) < 2**31 else x, **cover_tree(x, leaf))

    return v, materialize(packed(v, block, make(LEAF))), materialize(packed(v.where(queries), QUERY_BLOCK, make(QUERY_LEAF)))

