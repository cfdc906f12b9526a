"""MinHash near-duplicates by an inverted join of signature coordinates.

Texts with the same shingle set form a class, and only one row per class goes on.
Each class is posted under its K (coordinate, value) pairs. Two classes that agree
in at least MATCH coordinates must meet in one of the K - MATCH + 1 rarest
coordinates of each (the prefix); the long postings are skipped while candidates
are found, and looked up only to count a candidate's collisions. Pairs at or above
MATCH are confirmed on full shingle sets.

A posting never yields all its pairs. Its members are first tried against a leader, the
one whose coordinates are the most shared, which among edited copies is the least edited.
Components of confirmed links are then merged, and members outside the leader's component
are led anew by the most shared of them, against all members of other components. What is
left after ROUNDS leaders is paired with every member of another component, unless the
shingles that either has alone among all texts in question rule a link out, or fewer than
LONG_MATCH of LONG more coordinates agree. So a large group of copies costs a few links
each, and components that touch are found. Coordinates are compared by an int each, their
number and the rest of their value's hash.

What signatures lose is the method's only loss: a pair at the threshold of 0.75 agrees in
fewer than 34 of 64 coordinates with probability 4e-05, in fewer than 254 of 384 with
4e-05; both are below 1e-6 at 0.8.

Null and empty texts have an empty set and are linked with nothing. Repeated rows
are copies of each other. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, mains
from .hot_keys import hot_counts, join_groups
from .scratch import drop, materialize
from .sieve import sifted
from .words import U64, mix, seeds, shingle_sets, text_blocks, words

K, MATCH, ROUNDS = 64, 34, 2
#: Coordinates, and those that must agree, of the longer signatures that only what leaders leave over is tried with.
LONG, LONG_MATCH = 384, 254
_XOR, _MUL, _PLACE = seeds(K + LONG, 100), seeds(K + LONG, 1300) | U64(1), seeds(K + LONG, 2900)


def _least(sets: np.ndarray, starts: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Of each set, which begin at starts, the least value under each of the functions lo to hi."""
    out = np.zeros((len(starts), hi - lo), np.uint64)
    for k in range(lo, hi):
        v = (sets ^ _XOR[k]) * _MUL[k]
        out[:, k - lo] = np.minimum.reduceat(v ^ (v >> U64(31)), starts)
    return out


def _names(sets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit name of each set; the sets begin at starts."""
    return tuple(np.add.reduceat(mix(sets ^ U64(salt)), starts) for salt in (7, 77))


def _signatures(batches):
    """doc_id, size, a 128-bit name of the set, and its signature: hashes of K coordinates with their least values."""
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, buf, offs in text_blocks(batch.column(1)):
            sets, at = shingle_sets(*words(buf, offs))
            full = np.flatnonzero(np.diff(at))
            n = hi - lo
            sig = np.zeros((n, K), np.uint64)
            name = np.zeros((n, 2), np.uint64)
            if len(full):
                starts = at[:-1][full]
                sig[full] = _least(sets, starts, 0, K)
                name[full, 0], name[full, 1] = _names(sets, starts)
            rows = mix(sig ^ _PLACE[:K])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, n).cast(pa.int64()), pa.array(np.diff(at)), pa.array(name[:, 0].copy().view(np.int64)), pa.array(name[:, 1].copy().view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * K), pa.array(rows.ravel().view(np.int64)))],
                names=["doc_id", "n", "c1", "c2", "sig"],
            )


def _named(batches):
    """doc_id, text and the name of its set, of every text with words."""
    for batch in batches:
        for lo, hi, buf, offs in text_blocks(batch.column(1)):
            sets, at = shingle_sets(*words(buf, offs))
            full = np.flatnonzero(np.diff(at))
            if len(full):
                rows = batch.slice(lo, hi - lo).take(pa.array(full))
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), rows.column(1), *(pa.array(c.view(np.int64)) for c in _names(sets, at[:-1][full]))], names=["doc_id", "text", "c1", "c2"])


def _sets(batches):
    for batch in batches:
        for lo, hi, buf, offs in text_blocks(batch.column(1)):
            sets, at = shingle_sets(*words(buf, offs))
            raw = [sets[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(raw, pa.large_binary()).cast(pa.binary())], names=["id", "words"])


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            left, right, ok = batch.column(2), batch.column(3), []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(np.flatnonzero(ok))
            if len(keep):
                yield pa.RecordBatch.from_arrays([batch.column(k).take(keep) for k in (0, 1)], names=["a", "b"])

    return run


def _colliding(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of class ids that agree in MATCH coordinates or more."""
    s = sigs.select("id", "sig")
    both = pairs.join(s.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(s.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
    return materialize(both.where(F.size(F.array_intersect("x", "y")) >= MATCH).select("a", "b"))


def _linked(near: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of class ids that are near in full."""
    wanted = near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct()
    sets = materialize(sifted(docs, wanted, ["doc_id"]).select("doc_id", "text").mapInArrow(_sets, "id long, words binary"))
    full = near.join(sets.withColumnRenamed("id", "a"), "a").withColumnRenamed("words", "x").join(sets.withColumnRenamed("id", "b"), "b").select("a", "b", "x", F.col("words").alias("y"))
    out = materialize(full.mapInArrow(_confirm(percent), "a long, b long"))
    drop(sets)
    return out


def _posted(sigs: DataFrame) -> DataFrame:
    """v, id, pop: the postings in each class's prefix, and how shared its coordinates are."""
    each, counted = sigs.select("id", F.explode("sig").alias("v")), Window.partitionBy("v")
    hot = hot_counts(each, "v", "len", K * sigs.count())
    if hot is None:
        each = each.withColumn("len", F.count("*").over(counted))
    else:
        cold = each.join(F.broadcast(hot.select("v")), "v", "left_anti").select("id", "v").withColumn("len", F.count("*").over(counted))
        each = cold.unionByName(each.join(F.broadcast(hot), "v"))
    each = each.where("len > 1")
    w, skip = Window.partitionBy("id"), MATCH - 1  # a class's unshared coordinates come first in its prefix
    ranked = each.withColumn("m", F.count("*").over(w)).withColumn("pop", F.sum("len").over(w)).where(f"m > {skip}").withColumn("r", F.row_number().over(w.orderBy("len", "v")))
    return ranked.where(f"r <= m - {skip}").select("v", "id", "pop")


def _rank() -> Column:
    """What makes a posting's leader: its coordinates are the most shared; ties to the least id."""
    return F.struct("pop", (-F.col("id")).alias("neg"), "comp")


def _led(p: DataFrame, known: bool, total: int) -> DataFrame:
    """Pairs (a, b) of each posting's leader, or of the leader of those outside its component, with members of other components."""
    lead = p.groupBy("v").agg(F.max(_rank()).alias("lead"), F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    if known:
        met = join_groups(p, lead.select("v", "lead", "n"), "v", "n", total)
        lead = met.where("comp <> lead.comp").groupBy("v").agg(F.max(_rank()).alias("lead"), F.first("n").alias("n"))
    return join_groups(p, lead.select("v", "lead", "n"), "v", "n", total).where("comp <> lead.comp").select((-F.col("lead.neg")).alias("a"), F.col("id").alias("b"))


def _words_of(batches):
    """Of each text with words: its set and a longer signature."""
    for batch in _sets(batches):
        words_ = [np.frombuffer(w.as_buffer(), np.int64) for w in batch.column(1)]
        full = [i for i, w in enumerate(words_) if len(w)]
        lens = np.array([len(words_[i]) for i in full], np.int32)
        at = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
        flat = np.concatenate([words_[i] for i in full]) if full else np.zeros(0, np.int64)
        sig = mix(_least(flat.view(np.uint64), at[:-1], K, K + LONG)) >> U64(41) if full else np.zeros((0, LONG), np.uint64)
        sig = (sig | np.arange(LONG, dtype=np.uint64) << U64(23)).astype(np.uint32).view(np.int32)
        ends = pa.array(np.arange(len(full) + 1, dtype=np.int32) * LONG)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full, pa.int64())), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.ListArray.from_arrays(ends, pa.array(sig.ravel()))], names=["id", "words", "long"])


def _rest(p: DataFrame, sigs: DataFrame, docs: DataFrame, percent: int, total: int) -> DataFrame:
    """Pairs (a, b) of members outside their posting's main component with members of other components.

    own counts the shingles that a text has alone among all texts in such postings. Two
    sets share no more than what either has not alone, which bounds their similarity.
    """
    main = mains(p, "v").select("v", "main", "n")
    p = materialize(join_groups(p, main, "v", "n", total).select("v", "id", "comp", (F.col("comp") != F.col("main")).alias("out")))
    ids = p.select("id").distinct()
    sets = materialize(sifted(docs, ids.withColumnRenamed("id", "doc_id"), ["doc_id"]).select("doc_id", "text").mapInArrow(_words_of, "id long, words array<long>, long array<int>").join(ids, "id", "left_semi"))
    each = sets.select("id", F.explode("words").alias("s"))
    own = each.groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other").groupBy("id").agg(F.count("*").alias("own"))
    sized = materialize(ids.join(sigs, "id").join(sets.groupBy("id").agg(F.min("long").alias("long")), "id").join(own, "id", "left").select("id", "long", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("most")))
    met = p.groupBy("id").agg(F.collect_list("v").alias("vs"))  # a class's prefix: K - MATCH + 1 postings at most
    q = p.join(sized, "id").join(met, "id")
    mine = q.where("out").select("v", F.col("id").alias("i"), F.col("comp").alias("c"), F.col("vs").alias("us"), F.col("long").alias("l"), F.col("n").alias("m"), F.col("most").alias("most_i"))
    both = F.least("most", "most_i")
    once = (F.array_min(F.array_intersect("vs", "us")) == F.col("v")) & (~F.col("out") | (F.col("i") < F.col("id")))
    fits = (F.col("comp") != F.col("c")) & (100 * both >= percent * (F.col("n") + F.col("m") - both)) & once & (F.size(F.array_intersect("l", "long")) >= LONG_MATCH)
    pairs = materialize(q.join(mine, "v").where(fits).select(F.col("i").alias("a"), F.col("id").alias("b")))
    drop(p), drop(sets), drop(sized)
    return pairs


def _renamed(classes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """classes and docs with an id that names one text, and whether any doc_id names several.

    Where it does, its classes go by half of their sets' names, a hash of 64 bits, and their texts are added to docs.
    """
    clash = materialize(classes.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1 and doc_id is not null"))
    if clash.isEmpty():
        return classes.withColumn("id", F.col("doc_id")), docs, False
    split = join_groups(classes, clash, "doc_id", "texts", classes.count()).drop("texts").withColumn("id", F.col("c1"))
    texts = sifted(docs, clash.select("doc_id"), ["doc_id"]).mapInArrow(_named, "doc_id long, text string, c1 long, c2 long")
    again = materialize(texts.join(split, ["doc_id", "c1", "c2"]).select(F.col("id").alias("doc_id"), "text"))
    whole = classes.join(clash, "doc_id", "left_anti").select(*classes.columns).withColumn("id", F.col("doc_id"))
    return materialize(whole.unionByName(split)), docs.unionByName(again), True


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Two documents are linked if 100 * intersection >= percent * union of their 5-word
    shingle sets; component_id is the smallest doc_id reachable. Of several texts with one
    doc_id, each is a document of its own, and no link between them. Rows without doc_id are linked through other rows' ids, and those
    that have no other company get no component and a null kept.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = materialize(d.mapInArrow(_signatures, "doc_id long, n long, c1 long, c2 long, sig array<long>"))
    classes, d, several = _renamed(materialize(rows.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("doc_id"))), d)
    first = rows.join(classes, ["doc_id", "c1", "c2", "n"])
    sigs = materialize(first.groupBy("id").agg(F.min("sig").alias("sig"), F.max("n").alias("n")))
    posts = materialize(_posted(sigs))
    total = posts.count()
    links, comp, tried = None, None, None
    for turn in range(ROUNDS + 1):
        p = posts.withColumn("comp", F.col("id")) if comp is None else posts.join(comp.withColumnRenamed("node", "id"), "id", "left").select("v", "id", "pop", F.coalesce("component", "id").alias("comp"))
        pairs = _led(p, turn > 0, total) if turn < ROUNDS else _rest(p, sigs, d, percent, total)
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs)
        if pairs.isEmpty():
            continue
        new = _linked(_colliding(pairs, sigs) if turn < ROUNDS else pairs, d, percent)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        comp = connected_components(links)
    drop(posts), drop(sigs)
    if comp is None:
        comp = classes.limit(0).select(F.col("id").alias("node"), F.col("id").alias("component"))
    named = classes.join(comp.withColumnRenamed("node", "id"), "id", "left").select("c1", "c2", "n", "doc_id", F.coalesce("component", "id").alias("comp"))
    if several:  # the least id of a component may not be a doc_id
        named = materialize(named)
        least = named.groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("classes"))
        named = join_groups(named, least, "comp", "classes", named.count()).withColumn("comp", F.col("least"))
    named = named.select("c1", "c2", "n", "comp")
    out = rows.select("doc_id", "n", "c1", "c2").join(named, ["c1", "c2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
