"""Spelling variants: words that differ by one edit, found in a reduced alphabet.

Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF; only A-Z are lower-cased) of at least
`letters` code points and `least` occurrences. Letters are hashed to SYMBOLS symbols, the
code point's remainder. Each word's reduced form gets its full one-edit neighbourhood: itself
and every form with one symbol replaced, inserted or deleted, as 64-bit polynomial hashes
worked out in numpy for all words of a length at once. Two words at one edit have reduced
forms at one edit or none, so joining the neighbourhoods with the reduced vocabulary finds
every near pair once from each side; the words themselves are then compared by Levenshtein
distance. A bitmap of the reduced vocabulary, of at most MOST bits, keeps neighbours that no
word has out of the shuffle; a full bitmap lets more through, never fewer.

A word of n letters has about 2 * SYMBOLS * n neighbours, so a run of a million letters is
some 17 million hashes in a task; words are taken in blocks of at most CELLS hashes.

A word's form is its near word of most occurrences (ties: smallest by code points) if that
has `times` its own; chains of forms end at the root. Occurrences grow along a chain, so it
has no circle and a length of at most the logarithm of the largest count.

Null texts have no words; a null doc_id counts as empty in a slip's hash; repeated rows
count each time. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialize
from .words import mix

SYMBOLS, MOST, CELLS = 8, 1 << 28, 1 << 21
RUN = r"[A-Za-zÀ-ÿ]"
_BASE = np.uint64(0x9E3779B97F4A7C15)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def slipped(run: Column, doc_id: Column) -> Column:
    """run without one code point where 31 divides the CRC of `<doc_id>:<run>`."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, letters: int = 7, least: int = 2) -> DataFrame:
    """word, n: the words and their occurrences in all texts, slips included."""
    low = F.translate("text", UPPER, UPPER.lower())
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(f"{RUN}{{{letters},}}"), F.lit(0))).alias("run"))
    words = runs.select(slipped(F.col("run"), F.col("doc_id")).alias("word")).where(F.length("word") >= letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _by_length(words: pa.Array, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the words, their symbols from 1 on as a matrix) for blocks of words of one length."""
    codes = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words.to_pylist()]
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        step = max(1, CELLS // int(2 * symbols * n + n + 2))
        for lo in range(0, len(own), step):
            at = own[lo : lo + step]
            yield at, np.stack([codes[k] for k in at]).astype(np.uint64) % np.uint64(symbols) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 2, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _prefixes(m: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Hashes of each row's prefixes, from none to all of it, as sums with falling powers of the whole length."""
    n = m.shape[1]
    out = np.zeros((len(m), n + 1), np.uint64)
    np.cumsum(m * power[n - 1 :: -1][:n], axis=1, dtype=np.uint64, out=out[:, 1:])
    return out


def reduced(m: np.ndarray) -> np.ndarray:
    return mix(_prefixes(m, _powers(m.shape[1]))[:, -1])


def neighbourhood(m: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct forms at one edit or none of each row of symbols."""
    n = m.shape[1]
    power = _powers(n)
    head = _prefixes(m, power)
    tail = head[:, -1:] - head  # sums of suffixes, with their own powers
    front = (head * power[1:2], head, head[:, :-1])  # heads before an insertion have one power more
    place = power[n - 1 :: -1][:n]
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    forms = [head[:, -1:], front[2] * inverse + tail[:, 1:]]
    for s in range(1, symbols + 1):
        forms.append(head[:, :-1] + np.uint64(s) * place + tail[:, 1:])
        forms.append(front[0] + np.uint64(s) * power[n::-1][: n + 1] + tail)
    keys = np.sort(np.concatenate(forms, axis=1), axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(new)[0], mix(keys[new])


def _keyed(words: DataFrame, symbols: int) -> DataFrame:
    """words with key, the hash of their reduced form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = np.zeros(b.num_rows, np.uint64)
            for at, m in _by_length(b.column("word"), symbols):
                key[at] = reduced(m)
            yield pa.record_batch([*b.columns, pa.array(key.view(np.int64))], names=["word", "n", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key long")


def _bitmap(keyed: DataFrame, bits: int) -> np.ndarray:
    """A bit for each key, at most MOST in all."""
    slot = F.pmod("key", F.lit(bits)) + 1
    pieces = keyed.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pieces.collect():
        at = (r.b - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r.map, np.uint8)
    return out


def _neighbours(keyed: DataFrame, symbols: int, most: int) -> DataFrame:
    """(key, word) of the neighbours that some word may have."""
    bits = min(most, 1 << max(15, (32 * keyed.count()).bit_length()))
    sent = keyed.sparkSession.sparkContext.broadcast(_bitmap(keyed, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for b in batches:
            words = b.column("word")
            for at, m in _by_length(words, symbols):
                row, key = neighbourhood(m, symbols)
                slot = (key.view(np.int64) % bits).astype(np.int64)
                some = (held[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                yield pa.record_batch([pa.array(key[some].view(np.int64)), words.take(pa.array(at[row[some]]))], names=["key", "word"])

    return keyed.mapInArrow(run, "key long, word string")


def near_words(words: DataFrame, symbols: int = SYMBOLS, most: int = MOST) -> DataFrame:
    """(word, near, near_n): every ordered pair of words (word, n) that differ by exactly one edit."""
    keyed = materialize(_keyed(words, symbols))
    other = keyed.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = _neighbours(keyed, symbols, most).join(other, "key")
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: ends of chains, by doubling."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialize(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        drop(now)
        now = new.select("word", "root")
        now.scratch_path = new.scratch_path
        if new.where("moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = 10, symbols: int = SYMBOLS, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words (word, n)."""
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words, symbols, most).groupBy("word").agg(F.count("*").alias("n_near"), first.alias("first"))
    out = words.select("word", "n").join(near, "word", "left").withColumn("big", -F.col("first.less") >= times * F.col("n"))
    out = materialize(out.select("word", F.when(F.col("big"), F.col("first.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("big"), -F.col("first.less")).alias("form_n")))
    ends = _roots(out.where("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, letters: int = 7, least: int = 2, times: int = 10) -> DataFrame:
    return variants(materialize(vocabulary(docs, letters, least)), times)
