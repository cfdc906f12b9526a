"""Approximate nearest neighbours by inner product: a pruned directed graph per shard.

Every row is indexed. Rows are dealt into shards; within a shard, equal vectors are one
point that lists its ids, and points are added in growing batches: a greedy search from the most central point proposes neighbours,
relaxed distance pruning keeps diverse edges (a candidate goes if a kept neighbour is
nearer to it, by the factor alpha, than the point is), and edges are made both ways.
A query runs a beam search in every shard; a point found stands for its smallest ids,
more than are asked for. Inner products become distances by one more
coordinate that brings all rows of a shard to equal length. Scores are computed on the
original vectors in double precision.

Null ids and vectors that are null, zero, or hold null or non-finite components take no
part. Of repeated ids the least vector stays; shorter vectors count as continued with
zeros. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .cover_tree_topk import _padded
from .scratch import materialize
from .vector_blocks import QUERY_BLOCK, best, dump, packed, search, usable

SHARD, DEGREE, BEAM, ALPHA, WIDTH = 4096, 32, 72, 1.2, 4


def _lifted(x: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(axis=1)
    return np.hstack([x, np.sqrt(np.maximum(sq.max(initial=0) - sq, 0))[:, None]]).astype(np.float32)


def beam_search(graph: np.ndarray, x: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q: ids and squared distances of the beam, nearest first (-1, inf: none).

    All queries step together; each expands its WIDTH nearest unexpanded nodes a step.
    """
    n, m = len(q), len(x)
    ids, dist = np.full((n, beam), -1, np.int64), np.full((n, beam), np.inf, np.float32)
    done, seen = np.zeros((n, beam), bool), np.zeros((n, m + 1), bool)
    ids[:, 0], dist[:, 0] = start, ((x[start] - q) ** 2).sum(axis=1)
    seen[:, start] = True
    seen[:, m] = True
    live = np.arange(n)
    while len(live):
        open_ = ~done[live] & (ids[live] >= 0)
        some = open_.any(axis=1)
        live, open_ = live[some], open_[some]
        if not len(live):
            break
        order = np.argsort(~open_, axis=1, kind="stable")[:, :WIDTH]
        take = np.take_along_axis(open_, order, axis=1)
        rows = np.repeat(live[:, None], order.shape[1], axis=1)
        done[rows[take], order[take]] = True
        nodes = np.where(take, ids[rows, order], m)
        near = graph[nodes].reshape(len(live), -1)
        flat = np.repeat(live[:, None], near.shape[1], axis=1)
        near = np.where(seen[flat, near], m, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = m
        seen[flat, near] = True
        fresh = near < m
        r, c = np.nonzero(fresh)
        d = np.full(near.shape, np.inf, np.float32)
        diff = x[near[r, c]] - q[live[r]]
        d[r, c] = np.einsum("ij,ij->i", diff, diff)
        all_d = np.concatenate([dist[live], d], axis=1)
        top = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        all_i = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
        all_o = np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1)
        dist[live], ids[live], done[live] = (np.take_along_axis(a, top, axis=1) for a in (all_d, all_i, all_o))
    return ids, dist


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point up to degree diverse neighbours out of its row of cand (-1: none); len(x) fills up."""
    m = len(x)
    cand = np.where((cand == points[:, None]) | (cand < 0) | (cand >= m), m, cand)
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = m
    v = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])[cand]
    d = ((v - x[points][:, None, :]) ** 2).sum(axis=2)
    d[cand == m] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, axis=1), np.take_along_axis(d, order, axis=1)
    v = np.take_along_axis(v, order[:, :, None], axis=1) - x[points][:, None, :]  # from the point: distances of near copies keep their digits
    sq = (v * v).sum(axis=2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive, out = np.isfinite(d), np.full((len(points), degree), m, np.int64)
    rows = np.arange(len(points))
    for t in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        out[some, t] = cand[rows, first][some]
        alive &= ~((alpha * alpha) * between[rows, first] <= d)
        alive[rows, first] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Graph (row len(x) stands for none) and start point over the rows of x."""
    m = len(x)
    graph = np.full((m + 1, degree), m, np.int64)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(42).permutation(m)
    order = np.concatenate([[start], order[order != start]])
    at = 1
    while at < m:
        batch = order[at : at + min(max(at, 1), 192)]
        ids, _ = beam_search(graph, x, start, x[batch], beam)
        graph[batch] = robust_prune(x, batch, ids, degree, alpha)
        to, via = graph[batch].ravel(), np.repeat(batch, degree)
        to, via = to[to < m], via[to < m]
        by = np.argsort(to, kind="stable")
        to, via = to[by], via[by]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        for part in range(0, len(nodes), 256):
            p, f, c = nodes[part : part + 256], first[part : part + 256], count[part : part + 256]
            cols = np.arange(c.max())
            add = np.where(cols < c[:, None], via[np.minimum(f[:, None] + cols, len(via) - 1)], m)
            both = np.sort(np.concatenate([graph[p], add], axis=1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = m
            full = (both < m).sum(axis=1) > degree
            both.sort(axis=1)
            graph[p[~full]] = both[~full, :degree]
            if full.any():
                graph[p[full]] = robust_prune(x, p[full], both[full], degree, alpha)
        at += len(batch)
    return graph.astype(np.int32), start


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers from lo to below hi, range after range."""
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def distinct_graph(ids: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Graph over the points of a shard, and what they stand for.

    Point p stands for the different vectors kinds[p] to kinds[p + 1] of x, which are more
    than one only if they are equal in single precision; vector i has the ids first[i] to
    first[i + 1], ascending.
    """
    x, of = np.unique(x + 0.0, axis=0, return_inverse=True)  # -0 is 0
    points, at = np.unique(_lifted(x), axis=0, return_inverse=True)
    at, of = at.ravel(), of.ravel()
    by = np.argsort(at, kind="stable")
    place = np.empty_like(by)
    place[by] = np.arange(len(by))
    of = place[of]
    order = np.lexsort((ids, of))
    graph, start = build(points)
    return {"ids": ids[order], "first": np.searchsorted(of[order], np.arange(len(x) + 1)), "x": x[by], "kinds": np.searchsorted(at[by], np.arange(len(points) + 1)), "graph": graph, "start": np.array([start])}


def approximate_neighbours(vectors: DataFrame, queries: str, k: int = 20, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row that meets the condition queries."""
    v = usable(vectors, zero=False)

    def make(ids: np.ndarray, x: np.ndarray) -> bytes:
        return dump(**distinct_graph(ids, x))

    index = materialize(packed(v, shard, make))
    width = max(beam, 2 * k)

    def find(ask: dict, part: dict):
        qx, rx = _padded(ask["x"], part["x"])
        space, ids, first, kinds = _lifted(rx)[part["kinds"][:-1]], part["ids"], part["first"], part["kinds"]
        q, i, s = [], [], []
        for lo in range(0, len(qx), 256):
            some = qx[lo : lo + 256]
            near, _ = beam_search(part["graph"], space, int(part["start"][0]), np.hstack([some, np.zeros((len(some), 1))]).astype(np.float32), width)
            for j, row in enumerate(near):
                row = row[row >= 0]
                kind = _ranges(kinds[row], kinds[row + 1])
                score = (rx[kind] * some[j]).sum(axis=1)
                to = np.minimum(first[kind + 1], first[kind] + k + 1)  # one more, as the query's own may be among them
                row, score = _ranges(first[kind], to), np.repeat(score, to - first[kind])
                other = ids[row] != ask["ids"][lo + j]
                row, score = row[other], score[other]
                top = best(ids[row], score, k)
                q.append(np.full(len(top), ask["ids"][lo + j])), i.append(ids[row[top]]), s.append(score[top])
        return np.concatenate(q), np.concatenate(i), np.concatenate(s)

    asked = materialize(packed(v.where(queries), QUERY_BLOCK, lambda ids, x: dump(ids=ids, x=x)))
    return search(index, asked, k, find, "double")
