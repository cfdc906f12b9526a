"""Packing of tokenised documents into sequences of at most CAPACITY tokens.

Documents are encoded once; only their pieces' lengths and checksums are kept. All
documents of a length are alike to the packer, so it works on the histogram of lengths
(at most CAPACITY rows, whatever the corpus): first Martello-Toth dominance reduction
fixes sets that provably dominate every alternative for a document, all equal sets at
once; then what remains is best-fitted, longest first, again whole runs of equal
documents into runs of equal sequences. The plan has a few rows per length and is
broadcast; documents find their places by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_prefix import block_encoder
from .scratch import materialize, small_batches

CAPACITY, END = 4096, 1


def _pieces(path: str, capacity: int, end: int):
    def run(batches):
        blocks, last = block_encoder(path), np.array([end], "<u4")
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for i, ids in zip(batch.column(0).to_pylist(), blocks.texts(batch.column(1)), strict=True):
                ids = np.concatenate([ids, last]).astype("<u4")
                for k in range(0, len(ids), capacity):
                    part = ids[k : k + capacity]
                    doc.append(i), piece.append(k // capacity), start.append(k), length.append(len(part)), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents' ids and a closing end id, cut only where longer than capacity."""
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return d.mapInArrow(_pieces(path, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Lengths:
    """How many pieces of each length remain, and how many were placed."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.left)
        self.placed: dict[int, int] = defaultdict(int)

    def take(self, size: int, n: int) -> int:
        rank = self.placed[size]
        self.placed[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect_left(self.sizes, size))
        return rank

    def largest(self, most: int, without: dict[int, int]) -> int | None:
        """The largest length up to most, when the pieces in without are away."""
        k = bisect_left(self.sizes, most + 1) - 1
        while k >= 0 and self.left[self.sizes[k]] <= without.get(self.sizes[k], 0):
            k -= 1
        return self.sizes[k] if k >= 0 else None

    def smallest(self, n: int, without: int) -> list[int]:
        """Up to n shortest pieces, with one piece of length without away."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n, self.left[s] - (s == without))
            if len(out) >= n:
                break
        return out[:n]


def dominating(lengths: _Lengths, w: int, capacity: int) -> list[int] | None:
    """Pieces that with one of length w dominate every other set for it, if the rules prove so."""
    room = capacity - w
    few = lengths.smallest(3, w)
    if not few or few[0] > room:
        return []
    one = lengths.largest(room, {w: 1})
    if one == room or len(few) < 2 or few[0] + few[1] > room:
        return [one]
    if len(few) == 3 and sum(few) <= room:
        return None
    # at most two others fit: compare with the best pairs
    second, most = None, 0
    for b in lengths.sizes[: bisect_left(lengths.sizes, room // 2 + 1)]:
        a = lengths.largest(room - b, {w: 1} if b != w else {w: 2})
        if lengths.left[b] - (b == w) < 1 or a is None or a < b or (a == b and lengths.left[b] - (b == w) < 2):
            continue
        second, most = b, max(most, a + b)
    if one >= most:
        return [one]
    away = {w: 1}
    away[one] = away.get(one, 0) + 1
    mate = lengths.largest(room - one, away)
    return [one, mate] if mate is not None and second is not None and mate >= second else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (length, rank, pieces, sequence, per, sequences, offset).

    Pieces rank.. of that length go into sequences sequence.., per in each, from offset on.
    """
    lengths, out, seq = _Lengths(counts), [], 0
    for w in sorted(lengths.left, reverse=True):
        while lengths.left.get(w):
            group = dominating(lengths, w, capacity)
            if group is None:
                break
            need: dict[int, int] = defaultdict(int)
            for s in [w, *group]:
                need[s] += 1
            m = min(lengths.left[s] // k for s, k in need.items())
            at = 0
            for s, k in need.items():
                out.append((s, lengths.take(s, m * k), m * k, seq, k, m, at))
                at += s * k
            seq += m
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs of sequences
    rooms: list[int] = []

    def put(room: int, first: int, m: int) -> None:
        if room and m:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append((first, m))

    for w in sorted(lengths.left, reverse=True):
        while n := lengths.left.get(w, 0):
            k = bisect_left(rooms, w)
            if k == len(rooms):
                room, first, m = capacity, seq, -(-n // (capacity // w))
                seq += m
            else:
                room = rooms[k]
                first, m = open_[room].pop()
                if not open_[room]:
                    rooms.pop(k)
            fit = room // w
            full = min(m, n // fit)
            if full:
                out.append((w, lengths.take(w, full * fit), full * fit, first, fit, full, capacity - room))
                put(room - fit * w, first, full)
                put(room, first + full, m - full)
            else:
                out.append((w, lengths.take(w, n), n, first, n, 1, capacity - room))
                put(room - n * w, first, 1)
                put(room, first + 1, m - 1)
    return out




def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut with sequence_id and offset; cut has doc_id, piece, length and may have more."""
    spark = cut.sparkSession
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    rows = plan(counts, capacity)
    schema = "__len long, __rank long, __pieces long, __seq long, __per long, __n long, __at long"
    slots = F.broadcast(spark.createDataFrame(rows, schema))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = dealt.groupBy("length", "__salt").count().withColumn("__before", F.sum("count").over(Window.partitionBy("length").orderBy("__salt")) - F.col("count"))
    place = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("__r", F.row_number().over(place)).join(before.drop("count"), ["length", "__salt"]).withColumn("__r", F.col("__before") + F.col("__r") - 1)
    put = ranked.join(slots, (F.col("length") == F.col("__len")) & (F.col("__r") >= F.col("__rank")) & (F.col("__r") < F.col("__rank") + F.col("__pieces")))
    k = F.col("__r") - F.col("__rank")
    return put.select(*cut.columns, (F.col("__seq") + F.floor(k / F.col("__per"))).cast("long").alias("sequence_id"), (F.col("__at") + (k % F.col("__per")) * F.col("length")).alias("offset"))


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Null and empty texts are a single end id; repeated rows are packed each. An empty
    table gives no rows.
    """
    with small_batches(docs.sparkSession):
        cut = materialize(pieces(docs, path, capacity))
    return pack(cut, capacity)
