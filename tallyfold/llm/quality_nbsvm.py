"""Document quality by naive Bayes support vectors over n-grams.

A document's features are the distinct byte n-grams of its whole text and its n-grams of
one repeated word (hashed to a fixed number of columns, present or absent), scaled by the log-count ratio of the two
classes and to unit length; the linear hinge-loss model is fitted by dual coordinate
descent, and its margin becomes a probability by a logistic curve fitted on a held-back
part of the training rows and moved to the classes' shares of all labels.

The model is fitted on at most max_train labelled documents, taken by a hash of doc_id;
every document is scored. Labels, language, source and doc_id are no inputs of a score.
Null and empty texts have no features and get the score of the bias alone. Of repeated
labels the lowest counts; null labels do not. Without labels of both classes every score
is the share of label 1 (0.5 without any label). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import text_blocks, words

BITS, ORDERS, MAX_TRAIN, THRESHOLD = 18, (2, 3, 4), 4000, 0.3
#: Longest n-gram of one repeated word.
REPEATS = 16
COST, ROUNDS, SHRINK = 0.1, 12, 1.0


def _codes(buf: np.ndarray) -> list[np.ndarray]:
    """A column number for each byte n-gram, by order."""
    b = buf.astype(np.uint64)
    out = []
    for n in ORDERS:
        if len(b) < n:
            continue
        code = np.full(len(b) - n + 1, n, np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + b[k : len(b) - n + 1 + k]
        code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        out.append(code.astype(np.int64))
    return out


def _repeats(h: np.ndarray) -> np.ndarray:
    """A column number for each n up to REPEATS such that some word stands n times in a row."""
    same = h[1:] == h[:-1]
    if not same.any():
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(~np.concatenate([[False], same, [False]]))
    longest = min(int(np.diff(ends).max()), REPEATS)
    n = np.arange(2, longest + 1, dtype=np.uint64)
    return ((n * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct column numbers of each text, in linear time."""
    last = np.zeros(1 << BITS, np.int64)
    for _, _, buf, offs in text_blocks(column):
        h, at = words(buf, offs)
        for a, b, i, j in zip(offs[:-1], offs[1:], at[:-1], at[1:], strict=True):
            code = np.concatenate([*_codes(buf[a:b]), _repeats(h[i:j])])
            place = np.arange(len(code))
            last[code] = place
            yield code[last[code] == place]


class NbSvm:
    def __init__(self, weight: np.ndarray, ratio: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.weight, self.ratio, self.bias, self.slope, self.shift = weight, ratio, bias, slope, shift
        self.square = ratio * ratio

    def margin(self, cols: np.ndarray) -> float:
        norm = np.sqrt(self.square[cols].sum())
        return self.bias + (float(self.weight[cols].sum() / norm) if norm > 0 else 0.0)

    def score(self, cols: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(cols) + self.shift, -60, 60))))


class _Scaled:
    """Rows (columns, values): indicators by log-count ratio, to unit length, made when asked for."""

    def __init__(self, cols: list[np.ndarray], ratio: np.ndarray) -> None:
        self.cols, self.ratio = cols, ratio

    def __len__(self) -> int:
        return len(self.cols)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        v = self.ratio[self.cols[i]]
        norm = np.sqrt(v @ v)
        return self.cols[i], v / norm if norm > 0 else v

    def __iter__(self):
        return (self[i] for i in range(len(self)))


def dual_coordinate_descent(rows, y: np.ndarray, size: int, cost: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + sum of cost * hinge loss; rows: a sequence of (columns, values)."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(42)
    diagonal = np.array([float(v @ v) + 1 for _, v in rows])
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            c, v = rows[i]
            g = y[i] * (float(w[c] @ v) + bias) - 1
            new = min(max(alpha[i] - g / diagonal[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[c] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3 * cost.max():
            break
    return w, bias


def fit(cols: list[np.ndarray], labels: np.ndarray, odds: float = 1.0) -> NbSvm:
    """odds: of label 1 to 0 in the corpus, where the rows here are a stratified sample."""
    size = 1 << BITS
    y = np.where(labels == 1, 1.0, -1.0)
    if len(set(y)) < 2:
        share = 0.5 if not len(y) else float(y[0] > 0)
        shift = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return NbSvm(np.zeros(size), np.zeros(size), 0.0, 0.0, shift)
    count = {s: np.ones(size) for s in (1.0, -1.0)}
    for c, s in zip(cols, y, strict=True):
        count[s][c] += 1
    ratio = np.log(count[1.0] / (SHRINK * (y > 0).sum() + 1)) - np.log(count[-1.0] / (SHRINK * (y < 0).sum() + 1))
    rows = _Scaled(cols, ratio)
    back = np.arange(len(y)) % 5 == 4  # held back for the curve
    cost = COST * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    fold = np.flatnonzero(~back)
    w, bias = dual_coordinate_descent(_Scaled([cols[i] for i in fold], ratio), y[fold], size, cost[fold])
    m = np.array([bias + w[c] @ v for c, v in _Scaled([cols[i] for i in np.flatnonzero(back)], ratio)])
    slope, shift = logistic(m, (y[back] > 0).astype(float))
    shift += float(np.log(odds * (y < 0).sum() / (y > 0).sum()))
    w, bias = dual_coordinate_descent(rows, y, size, cost)
    return NbSvm(w * ratio, ratio, bias, slope, shift)


def logistic(m: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of 1 given the margin, by Newton's steps on smoothed targets."""
    if not len(m) or t.min() == t.max():
        return 2.0, 0.0
    up, down = t.sum(), len(t) - t.sum()
    goal = np.where(t > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - goal) * m).sum() + 1e-3 * a, (p - goal).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * m * m).sum() + 1e-3, (q * m).sum()], [(q * m).sum(), q.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 0.1)), float(b)


def _bytes_of(ids) -> pa.Array:
    return pa.array(ids, pa.binary())


def _training(batches):
    for batch in batches:
        cols = [c.astype("<i4").tobytes() for c in features(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _bytes_of(cols)], names=["doc_id", "quality", "cols"])


def train(docs: DataFrame, labels: DataFrame, use: str = "true", max_train: int = MAX_TRAIN) -> NbSvm:
    """Fit on up to max_train labelled documents that meet the condition use, half of each class if there are as many."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(use).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    share = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    picks = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train // 2) for q in (0, 1)]
    chosen = F.broadcast(picks[0].unionByName(picks[1]))  # at most max_train rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("doc_id", "text", "quality")
    got = rows.mapInArrow(_training, "doc_id long, quality int, cols binary").dropDuplicates(["doc_id"]).collect()
    got.sort(key=lambda r: (hash((r[0], 42)) & 0xFFFF, r[0]))
    return fit([np.frombuffer(r[2], "<i4") for r in got], np.array([r[1] for r in got]), share.get(1, 1) / share.get(0, 1))


def score(docs: DataFrame, model: NbSvm, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.ratio.astype(np.float32), model.bias, model.slope, model.shift))  # 2 MB, whatever the corpus

    def run(batches):
        m = NbSvm(*shared.value)
        for batch in batches:
            s = np.array([m.score(c) for c in features(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: NbSvm, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.ratio.astype(np.float32), model.bias, model.slope, model.shift))

    def run(batches):
        m = NbSvm(*shared.value)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).cast(pa.string())
            yield batch.filter(pa.array([m.score(c) >= threshold for c in features(text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
