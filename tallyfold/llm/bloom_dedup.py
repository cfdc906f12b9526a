"""Exact deduplication by two passes of a Bloom filter, in DataFrame operations only.

Texts are equal when they are identical; null counts as empty. They are named by their
SHA-256. In the first pass every row sets HASHES slots of a filter; rows per slot are
counted, with partial counts in the tasks, so that slot numbers travel and no rows. The
filter of the second pass has the slots that two or more rows have set. Rows with a slot
outside it are unique and pass straight through; the others, all repeated rows and a few
more, are shuffled and compared by their whole hashes.

A filter has BITS bits a row and is broadcast, so it has at most MOST bits. Beyond that many
rows, digests are dealt to segments by their hash, in folders of the written table, and each
segment has its two passes. Groups with more than 1/128 of the shuffled rows are broadcast.

Of equal texts the row with the largest doc_id stays. Rows without doc_id come after all
others, and of rows that are equal in doc_id and text any one stays. An empty table gives no
rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hot_keys import join_groups
from .scratch import drop, materialize

HASHES, BITS, MOST = 2, 16, 1 << 28


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _slot(k: int, bits: int) -> Column:
    """A slot of a digest, from 1 on, as the functions of bitmaps count."""
    return F.pmod(F.xxhash64(F.lit(k), "digest"), F.lit(bits)) + 1


def _filter(slots: DataFrame) -> DataFrame:
    """Bitmaps of the column slot, in pieces of 4 KB."""
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("map"))


def _tested(rows: DataFrame, maps: DataFrame, bits: int) -> DataFrame:
    """rows with again: whether all their slots are in the filter."""
    hit = []
    for k in range(HASHES):
        own = F.broadcast(maps.select(F.col("piece").alias(f"piece{k}"), F.col("map").alias(f"map{k}")))
        rows = rows.join(own, F.bitmap_bucket_number(_slot(k, bits)) == F.col(f"piece{k}"), "left")
        at = F.bitmap_bit_position(_slot(k, bits))
        byte = F.conv(F.hex(F.substr(f"map{k}", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit.append(F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
    return rows.withColumn("again", reduce(Column.__and__, hit)).drop(*(f"{c}{k}" for k in range(HASHES) for c in ("piece", "map")))


def _bits(rows: int, most: int) -> int:
    return min(most, 1 << max(15, (BITS * rows).bit_length()))


def _repeats(part: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """part's rows that pass straight through, and those to shuffle, which are written."""
    bits = _bits(part.count(), most)
    slots = part.select(F.explode(F.array_distinct(F.array(*(_slot(k, bits) for k in range(HASHES))))).alias("slot"))
    twice = materialize(_filter(slots.groupBy("slot").count().where("count > 1")))
    tested = _tested(part, twice, bits)
    return tested.where("not again").drop("again"), materialize(tested.where("again").drop("again"))


def _segments(docs: DataFrame, most: int) -> list[DataFrame]:
    """(doc_id, digest, row) of every row, written in segments that one filter can hold."""
    named = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    count = max(1, -(-docs.count() * BITS // most))
    if count == 1:
        return [materialize(named)]
    dealt = materialize(named.withColumn("segment", F.pmod(F.xxhash64(F.lit(HASHES), "digest"), F.lit(count)).cast("int")), ["segment"])
    return [dealt.where(F.col("segment") == s).drop("segment") for s in range(count)]


def _groups(rows: DataFrame) -> DataFrame:
    """Each digest's number of rows, and the row that stays."""
    last = F.max(F.struct(F.col("doc_id").alias("doc_id"), F.col("row").alias("row")))
    return rows.groupBy("digest").agg(F.count("*").alias("group_size"), last.alias("keep"))


def copies(docs: DataFrame, most: int = MOST) -> DataFrame:
    """A row per row of docs: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256."""
    out = None
    for part in _segments(docs, most):
        alone, again = _repeats(part, most)
        groups = materialize(_groups(again))
        met = join_groups(again, groups, "digest", "group_size", again.count())
        own = F.struct(F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
        both = alone.select("*", F.lit(1).cast("long").alias("group_size"), own.alias("keep"))
        both = both.unionByName(met)
        out = both if out is None else out.unionByName(both)
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, most: int = MOST) -> DataFrame:
    """docs, all columns, with one row of each text.

    The repeated digests of copies() make the filter here, so it takes one read of docs, and
    only rows that share a text travel. Of rows equal in text and doc_id one stays.
    """
    repeated = None
    for part in _segments(docs, most):
        groups = _groups(_repeats(part, most)[1]).where("group_size > 1").select("digest")
        repeated = groups if repeated is None else repeated.unionByName(groups)
    repeated = materialize(repeated)
    bits = _bits(repeated.count(), most)
    maps = materialize(_filter(repeated.select(F.explode(F.array(*(_slot(k, bits) for k in range(HASHES)))).alias("slot"))))
    rows = _tested(docs.select(digest(F.col("text")).alias("digest"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")), maps, bits)
    drop(repeated)
    order = F.struct(F.col("whole.doc_id").isNotNull(), F.col("whole.doc_id"))
    one = rows.where("again").groupBy("digest").agg(F.max_by("whole", order).alias("whole"))
    return rows.where("not again").select("whole.*").unionByName(one.select("whole.*"))
