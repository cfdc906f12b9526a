"""Where a language's sources differ in their words: all pairs of sources, and each source's words.

A term is a run of letters A-Z, a-z and code points from U+0080 on, A-Z lower-cased. Each
lang keeps the V terms in at least `least` of its documents. A (lang, source) group, and the
lang as a whole, give a kept term of c occurrences, of N over all kept terms,
p = 1 + floor(10^9 (c + 5) / (N + 5 V)), in decimals, so exactly.

Pairs: the sum of |p - q| over all kept terms, for every two sources of a lang. Terms are
dealt to blocks of about BLOCK and sources to tiles of about TILE, and a task adds up one
block of two tiles in numpy, absent terms included: each block also gets a row for every
source, with the p of no occurrences.

Terms: the `top` terms of a group with the largest p - q > 0, q the lang's. As p - q grows
with the group's count and falls with the lang's, a term that k others dominate (no smaller
group count, no larger lang count, earlier in UTF-8) has k terms before it. Partitions of
about PART terms of a group keep their skyband, the terms dominated by fewer than `top`
others; these are merged to the skyband of the group, and what is left is ranked exactly.

Null text, lang and source count as ''. Every row counts as a document, repeated rows too. A
group without terms still has its pairs, of value 0 where its lang keeps no term. An empty
table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hot_keys import join_groups
from .scratch import materialize
from .sieve import sifted

BLOCK, TILE, PART, CHUNK = 512, 256, 1 << 14, 512
#: Entries of a task's counts at which they are passed on.
HELD = 1 << 19
#: Bytes of terms, lower-cased, or blanks.
_TERM = bytes(k if 97 <= k <= 122 or k >= 128 else k + 32 if 65 <= k <= 90 else 32 for k in range(256))


def share(count: str, total: str, terms: str) -> Column:
    """p of count occurrences; a group of a lang without kept terms has no use for it."""
    return F.expr(f"1 + (1000000000 * cast({count} + 5 as decimal(26,0))) div cast(greatest({total} + 5 * {terms}, 1) as decimal(26,0))")


def _group() -> Column:
    return F.struct("lang", "source")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the terms of a task's rows, by lang and source."""
    held, size = defaultdict(lambda: (Counter(), Counter())), 0

    def passed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (c, df) in held.items():
            columns = [pa.repeat(lang, len(c)), pa.repeat(source, len(c)), pa.array(c.keys(), pa.binary()).cast(pa.string())]
            yield pa.record_batch([*columns, pa.array(c.values(), pa.int64()), pa.array(map(df.__getitem__, c), pa.int64())], names=["lang", "source", "term", "c", "df"])
        held.clear()

    for b in batches:
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            terms = text.translate(_TERM).split()
            c, df = held[lang, source]
            size -= len(c)
            c.update(terms)
            df.update(set(terms))
            size += len(c)
            if size >= HELD:
                yield from passed()
                size = 0
    yield from passed()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, c (occurrences), df (documents), summed from the tasks' partial counts."""
    each = docs.select("lang", "source", "text").mapInArrow(_counts, "lang string, source string, term string, c long, df long")
    return each.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("df").alias("df"))


def _counted(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Kept terms' counts by group (g, term, c, all: the lang's), and every group's n, size (terms of its own), v, nl, peers."""
    d = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = materialize(term_counts(d))
    kept = materialize(counts.groupBy("lang", "term").agg(F.sum("c").alias("all"), F.sum("df").alias("df")).where(F.col("df") >= least).drop("df"))
    own = materialize(sifted(counts, kept, ["lang", "term"]).join(kept, ["lang", "term"]).select(_group().alias("g"), "term", "c", "all"))
    groups = d.select(_group().alias("g")).distinct().join(own.groupBy("g").agg(F.sum("c").alias("n"), F.count("*").alias("size")), "g", "left")
    groups = materialize(groups.select("g", F.col("g.lang").alias("lang"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("size", F.lit(0)).alias("size")))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("nl"), F.count("*").alias("peers"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    return own, materialize(join_groups(groups, langs, "lang", "peers", groups.count()))


def _tiles() -> Column:
    """The pairs of tiles, lower first, that a source's rows go to."""
    own, count = F.pmod(F.xxhash64("g.source"), F.col("tiles")).cast("int"), F.col("tiles").cast("int")
    return F.explode(F.transform(F.sequence(F.lit(0), count - 1), lambda t: F.struct(F.least(own, t).alias("i"), F.greatest(own, t).alias("j"), own.alias("own"))))


def _distances(table: pa.Table) -> pa.Table:
    """Sums of |p - q| of one block of terms, for the pairs of sources of two tiles.

    Terms that none of these sources has are not among the rows; the first block adds the
    share of all terms, and each block takes off that of its own.
    """
    i, j, block, v = (table[c][0].as_py() for c in ("i", "j", "block", "v"))
    zero = table.filter(pc.is_null(table["term"]))
    zero = zero.take(pc.sort_indices(zero, [("source", "ascending")]))
    names, tile = zero["source"].combine_chunks(), zero["own"].to_numpy()
    rows = table.filter(pc.is_valid(table["term"]))
    terms = rows["term"].combine_chunks().dictionary_encode()
    none = zero["p"].to_numpy()
    absent = (v if block == 0 else 0) - len(terms.dictionary)
    p = np.repeat(none[:, None], len(terms.dictionary), axis=1)
    p[pc.index_in(rows["source"], names).to_numpy(), terms.indices.to_numpy(False)] = rows["p"].to_numpy()
    a, b, values = [], [], []
    for k in range(len(p)):
        to = np.flatnonzero(tile == j) if i != j else np.arange(k + 1, len(p))
        if (i == j or tile[k] == i) and len(to):
            a.append(np.full(len(to), k))
            b.append(to)
            values.append(np.abs(p[to] - p[k]).sum(axis=1) + absent * np.abs(none[to] - none[k]))
    a, b, values = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, values))
    lang = pa.repeat(table["lang"][0], len(a))
    return pa.table({"lang": lang, "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "value": pa.array(values, pa.int64())})


def pairs(own: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of each source and each other one of its lang."""
    blocks, tiles = F.ceil(F.greatest("v", F.lit(1)) / BLOCK).alias("blocks"), F.ceil(F.col("peers") / TILE).alias("tiles")
    sizes = groups.select("g", "n", "v", "size", blocks, tiles)
    met = join_groups(own, sizes, "g", "size", own.count())
    some = met.select("g", "v", "tiles", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "term", share("c", "n", "v").alias("p"))
    none = sizes.select("g", "v", "tiles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), share("0", "n", "v").alias("p"))
    rows = some.unionByName(none).select("g", "v", "block", "term", "p", _tiles().alias("t"))
    rows = rows.select("g.lang", "g.source", "v", "block", "term", "p", "t.i", "t.j", "t.own")
    sums = rows.groupBy("lang", "block", "i", "j").applyInArrow(_distances, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sums = materialize(sums)
    return sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))


def skyband(more: np.ndarray, less: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Places of the points that fewer than k others dominate: no smaller more, no larger less, smaller place.

    Points are taken by falling more, so that dominators come first, and in chunks; dominators
    that are not kept need no count, as what dominates them dominates the point, too.
    """
    order = np.lexsort((place, less, -more))
    kept = np.zeros(0, np.int64)
    for lo in range(0, len(order), CHUNK):
        new = order[lo : lo + CHUNK]
        n = ((less[kept][:, None] <= less[new]) & (place[kept][:, None] < place[new])).sum(axis=0)
        new, n = new[n < k], n[n < k]
        n += np.triu((less[new][:, None] <= less[new]) & (place[new][:, None] < place[new]), 1).sum(axis=0)
        kept = np.concatenate([kept, new[n < k]])
    return kept


def _shrunk(table: pa.Table, k: int) -> pa.Table:
    """The rows of each group's skyband."""
    table = table.take(pc.sort_indices(table, [("lang", "ascending"), ("source", "ascending"), ("term", "ascending")]))
    lang, source = (table[c].combine_chunks().dictionary_encode().indices.to_numpy(False) for c in ("lang", "source"))
    edges = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (source[1:] != source[:-1]), True]) if len(lang) else [0]
    c, whole = table["c"].to_numpy(), table["all"].to_numpy()
    kept = [lo + np.sort(skyband(c[lo:hi], whole[lo:hi], np.arange(hi - lo), k)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return table.take(pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))


def _skybands(rows: DataFrame, k: int) -> DataFrame:
    """rows of the skybands of each partition's groups; a partition holds those and PART new rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = [], 0
        for b in batches:
            held.append(b)
            fresh += b.num_rows
            if fresh >= PART:
                held, fresh = _shrunk(pa.Table.from_batches(held), k).to_batches(), 0
        if held:
            yield from _shrunk(pa.Table.from_batches(held), k).to_batches()

    return rows.mapInArrow(run, rows.schema)


def distinctive_terms(own: DataFrame, groups: DataFrame, top: int = 50) -> DataFrame:
    """lang, source, item, value, rank of each group's terms of the largest p - q, from 1 to top."""
    met = join_groups(own, groups.select("g", "n", "size", "v", "nl"), "g", "size", own.count())
    met = met.withColumn("value", share("c", "n", "v") - share("`all`", "nl", "v")).where("value > 0")
    salt = F.pmod(F.xxhash64("term"), F.ceil(F.col("size") / PART)).alias("salt")
    rows = met.select("g.lang", "g.source", "term", "c", "all", "value", salt).repartition("lang", "source", "salt").drop("salt")
    merged = _skybands(_skybands(rows, top).repartition("lang", "source"), top)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return merged.select("lang", "source", F.col("term").alias("item"), "value", F.row_number().over(w).alias("rank")).where(F.col("rank") <= top)


def divergence_audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    own, groups = _counted(docs, least)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    both = pairs(own, groups).withColumn("rank", F.row_number().over(w)).withColumn("part", F.lit("pair"))
    both = both.unionByName(distinctive_terms(own, groups, top).withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", "rank")
