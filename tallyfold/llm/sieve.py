"""A bitmap of bounded size that keeps most unwanted rows out of a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bits of a sieve, 32 MB; it lets more rows pass beyond that, never fewer.
SIEVE = 1 << 28


def _mapped(rows: DataFrame, wanted: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows with __in, whether their bit is set in a broadcast bitmap of wanted's hashes, of at most SIEVE bits."""
    bits = min(SIEVE, 1 << max(15, (16 * wanted.count()).bit_length()))
    slot = lambda: F.pmod(F.xxhash64(*keys), F.lit(bits))
    maps = wanted.select(slot().alias("s")).groupBy(F.bitmap_bucket_number("s").alias("__b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__map"))
    met = rows.withColumn("__at", F.bitmap_bit_position(slot())).join(F.broadcast(maps), F.bitmap_bucket_number(slot()) == F.col("__b"), how)
    byte = F.conv(F.hex(F.substr("__map", F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.select(*rows.columns, F.coalesce(F.getbit(byte, (F.col("__at") % 8).cast("int")) == 1, F.lit(False)).alias("__in"))


def sifted(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """rows without most of those whose keys are not among wanted's.

    What passes still has to be joined, and by an inner join: a semi join would be pushed
    below the sieve.
    """
    return _mapped(rows, wanted, keys, "inner").where("__in").drop("__in")


def parted(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows in two parts: those whose keys may be among wanted's, and those whose keys are not."""
    mapped = _mapped(rows, wanted, keys, "left")
    return mapped.where("__in").drop("__in"), mapped.where("not __in").drop("__in")
