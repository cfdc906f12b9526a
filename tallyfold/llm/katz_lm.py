"""Language-model scores by Katz backoff with Good-Turing discounts.

Tokens are a text's words and one end. Of training texts all words and all pairs (word
after word; the first after a start mark) are counted. Pairs counted min_count times or
more are kept, discounted by Good-Turing (counts up to DISCOUNTED, from the counts of
counts of all pairs); what they leave of a context's mass goes to the words not kept after
it, in proportion to their unigram probability, by a backoff weight that makes each
context's probabilities sum to one exactly. Unigrams: (c + 0.5) / (N + 0.5 (V + 1)), the
unknown word being one more class. Where discounting leaves a context no mass, its counts
are taken over one more than its total.

A token's probability is looked up recursively: the kept pair's, or else the context's
weight times the word's. In logarithms that is, for every token, the word's and the
context's parts, and for kept pairs one correction. The tables (words with count and
weight, kept pairs with correction) are written partitioned by hash; texts send each
partition the words and pairs that belong to it as packed arrays and get sums back per
text, some slices of the partitions after others, each with its own pass over the texts. Words and pairs with more than 1/HOT of all tokens, which are at most HOT, are
broadcast and answered in place, so that no partition gets a frequent one.

Null texts count as empty: one end. Repeated rows are texts of their own. Without
training texts N and V are 0 and every token has probability 1. Rows whose doc_id is
null are in no fold: they are scored, not learned from. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialize, small_batches
from .words import U64, mix, text_blocks, words

MIN_COUNT, DISCOUNTED, HOT = 1, 5, 65536
#: Tokens that one partition of the tables sees.
TOKENS = 2_000_000
#: Counting, joining and scoring take the tables in so many slices, each with a pass over what it reads, as whole shuffles would fill the disk.
COUNT_SLICES, JOIN_SLICES, SCORE_SLICES = 2, 4, 4
#: Bytes that are cut into words at a time, and tokens whose counts or requests are sent together.
BLOCK, TOGETHER = 1 << 20, 1_000_000
END, BOS = (mix(np.array([k], np.uint64))[0] for k in (0xE0D, 0xB05))


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: tokens, the context of each, and where each text's tokens begin."""
    h, at = words(buf, offs)
    tok = np.insert(h, at[1:], END)
    at = at + np.arange(len(at))
    ctx = np.empty_like(tok)
    ctx[1:] = tok[:-1]
    ctx[at[:-1]] = BOS
    return tok, ctx, at


def _blocks(batches, column: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Tokens, contexts, numbers of tokens and doc_ids (where there is such a column) of runs of texts of about BLOCK bytes."""
    for batch in batches:
        for lo, hi, buf, offs in text_blocks(batch.column(column), BLOCK):
            tok, ctx, at = _tokens(buf, offs)
            yield tok, ctx, np.diff(at), batch.column(0).slice(lo, hi - lo).cast(pa.int64()) if column else None


def _runs(parts: Iterator[tuple]) -> Iterator[tuple]:
    """Tuples of arrays, the first their number of tokens, put together in runs of about TOGETHER tokens."""
    held, size = [], 0
    for n, *part in parts:
        held.append(part)
        size += n
        if size >= TOGETHER:
            together = [np.concatenate(x) for x in zip(*held, strict=True)]
            held, size = [], 0
            yield together
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


_P1, _P2, _P3, _P4, _P5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _hashed(v: np.ndarray, seed) -> np.ndarray:
    h = (seed + _P5 + U64(8)) ^ (_turned(v * _P2, 31) * _P1)
    h = _turned(h, 27) * _P1 + _P4
    h = (h ^ (h >> U64(33))) * _P2
    h = (h ^ (h >> U64(29))) * _P3
    return h ^ (h >> U64(32))


def _pair(ctx: np.ndarray, tok: np.ndarray) -> np.ndarray:
    """What xxhash64(ctx, tok) gives in Spark."""
    return _hashed(tok, _hashed(ctx, U64(42)))


def _slices(buckets: int, n: int) -> list[tuple[int, int]]:
    """Up to n ranges of buckets, the first from 0."""
    ends = [buckets * k // n for k in range(n + 1)]
    return [(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True) if a < b]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.uint32)


def _parts(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _within(h: np.ndarray, buckets: int, first: int, end: int) -> np.ndarray:
    bucket = _bucket(h, buckets)
    return (bucket >= first) & (bucket < end)


def _counted(buckets: int, first: int, end: int):
    """Words and pairs of each run of texts with their counts, by bucket, of the buckets from first to below end.

    What other buckets count goes block by block, before a run is put together.
    """

    def own(batches) -> Iterator[tuple]:
        for tok, ctx, _, _ in _blocks(batches, 0):
            mask = _within(_pair(ctx, tok), buckets, first, end)
            yield len(tok), tok[_within(tok, buckets, first, end)], ctx[mask], tok[mask]

    def run(batches):
        for word, ctx, tok in _runs(own(batches)):
            rows: dict[int, list] = {b: [b, b"", b"", b"", b"", b""] for b in range(first, end)}
            w, n = np.unique(word, return_counts=True)
            order, cut = _parts(_bucket(w, buckets), buckets)
            for b in range(first, end):
                o = order[cut[b] : cut[b + 1]]
                rows[b][1:3] = w[o].tobytes(), n[o].astype(np.uint32).tobytes()
            p, place, n = np.unique(_pair(ctx, tok), return_index=True, return_counts=True)
            order, cut = _parts(_bucket(p, buckets), buckets)
            for b in range(first, end):
                o = order[cut[b] : cut[b + 1]]
                rows[b][3:6] = ctx[place[o]].tobytes(), tok[place[o]].tobytes(), n[o].astype(np.uint32).tobytes()
            cols = list(zip(*(r for r in rows.values() if r[1] or r[3]), strict=True))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "w", "wn", "ctx", "tok", "pn"])

    return run


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, a place of each, and their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], order[start], np.add.reduceat(n, start) if len(keys) else n


def _summed(min_count: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        join = lambda c, t: np.frombuffer(b"".join(pdf[c]), t)
        w, _, n = _added(join("w", np.uint64), join("wn", np.uint32).astype(np.int64))
        ctx, tok = join("ctx", np.uint64), join("tok", np.uint64)
        p, at, m = _added(_pair(ctx, tok), join("pn", np.uint32).astype(np.int64))
        kept = m >= min_count
        some = np.bincount(np.minimum(m, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]
        a, b, n = [w.view(np.int64), ctx[at[kept]].view(np.int64), np.arange(1, DISCOUNTED + 2)], tok[at[kept]].view(np.int64), [n, m[kept], some]
        sizes = [len(x) for x in a]
        del w, ctx, tok, p, at, m, kept  # so that the rows are held once
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate([np.zeros(sizes[0], np.int64), b, np.zeros(sizes[2], np.int64)]), "n": np.concatenate(n), "kind": np.repeat(np.arange(3, dtype=np.int32), sizes)}, copy=False)

    return run


def discounts(counts_of_counts: dict[int, int]) -> dict[int, float]:
    """Katz's factor for counts up to DISCOUNTED; 1 where the counts of counts do not allow one."""
    n = counts_of_counts
    out = {}
    first = n.get(1, 0)
    top = (DISCOUNTED + 1) * n.get(DISCOUNTED + 1, 0) / first if first else 1.0
    for r in range(1, DISCOUNTED + 1):
        d = 1.0
        if n.get(r, 0) and n.get(r + 1, 0) and top < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top)
        out[r] = d if 0 < d <= 1 else 1.0
    return out


class KatzModel:
    """words: h, c, alpha; pairs: h, n, delta (both written tables); n, v: tokens and different words."""

    def __init__(self, words_: DataFrame, pairs: DataFrame, n: int, v: int, buckets: int) -> None:
        self.words, self.pairs, self.n, self.v, self.buckets = words_, pairs, n, v, buckets


def train(docs: DataFrame, buckets: int, min_count: int = MIN_COUNT) -> KatzModel:
    """Count all of docs (text) and derive the model's tables."""
    spark = docs.sparkSession
    text, shape = docs.select(F.col("text").cast("string")), "bucket int, w binary, wn binary, ctx binary, tok binary, pn binary"
    counts = []
    for first, end in _slices(buckets, COUNT_SLICES):
        got = text.mapInArrow(_counted(buckets, first, end), shape).groupBy("bucket").applyInPandas(_summed(min_count), "a long, b long, n long, kind int")
        with small_batches(spark):
            counts.append(materialize(got.withColumn("slice", F.pmod("a", F.lit(JOIN_SLICES)).cast("int")), ["kind", "slice"]))
    every = reduce(DataFrame.unionByName, counts)
    uni = every.where("kind = 0").select(F.col("a").alias("h"), F.col("n").alias("c"))
    total, v = uni.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    d = discounts({r[0]: r[1] for r in every.where("kind = 2").groupBy("a").agg(F.sum("n")).collect()})
    ends = uni.where(F.col("h") == int(END.view(np.int64))).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]  # one end and one start a text
    start = spark.createDataFrame([(int(BOS.view(np.int64)), ends)], "a long, cc long")
    norm = total + 0.5 * (v + 1)
    factor = F.lit(1.0)
    for r, x in d.items():
        factor = F.when(F.col("n") == r, x).otherwise(factor)
    dn, p1 = factor * F.col("n"), (F.col("cw") + 0.5) / norm
    of_ctx = uni.select(F.col("h").alias("a"), F.col("c").alias("cc")).union(start)
    bucket = lambda h: F.expr(f"cast(shiftrightunsigned(shiftrightunsigned({h}, 32) * {buckets}L, 32) as int)")
    over = F.when(F.col("dn") > F.col("cc") - 1e-9 * F.col("cc"), F.col("cc") + 1).otherwise(F.col("cc"))
    weights, pairs_ = [], []
    for k in range(JOIN_SLICES):  # a context's pairs are in one slice; a slice's counts go once it is joined
        kept = every.where(f"kind = 1 and slice = {k}").select("a", "b", "n")
        pairs = materialize(kept.join(uni.select(F.col("h").alias("b"), F.col("c").alias("cw")), "b").select("a", "b", "n", "cw"))
        sums = pairs.groupBy("a").agg(F.sum(dn).alias("dn"), F.sum(p1).alias("p1")).join(of_ctx, "a")
        weights.append(materialize(sums.select("a", over.alias("over"), F.log10((1 - F.col("dn") / over) / (1 - F.col("p1"))).alias("alpha"))))
        for c in counts:
            drop(c, f"kind=1/slice={k}")
        delta = F.log10(dn / F.col("over")) - F.log10(p1) - F.col("alpha")
        pairs_.append(materialize(pairs.join(weights[-1], "a").select(F.xxhash64("a", "b").alias("h"), "n", delta.alias("delta")).select(bucket("h").alias("bucket"), "h", "n", "delta")))
        drop(pairs)
    weight = reduce(DataFrame.unionByName, weights).select(F.col("a").alias("h"), "alpha")
    words_ = uni.unionByName(spark.createDataFrame([(int(BOS.view(np.int64)), 0)], "h long, c long")).join(weight, "h", "left")
    words_ = materialize(words_.select(bucket("h").alias("bucket"), "h", "c", F.coalesce("alpha", F.lit(0.0)).alias("alpha")))
    for t in [*counts, *weights]:
        drop(t)
    return KatzModel(words_, reduce(DataFrame.unionByName, pairs_), total, v, buckets)


def _found(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the ascending table, and where."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def _by_text(of: np.ndarray) -> bytes:
    """Ascending numbers of texts as different numbers, then how often each stands."""
    text, n = np.unique(of, return_counts=True)
    return np.concatenate([text, n]).astype(np.uint32).tobytes()


def _texts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(raw, np.uint32).reshape(2, -1)


def _asked(buckets: int, first: int, end: int, hot):
    """Rows for each bucket from first to below end that a block of texts asks (words and pairs by text); from 0 on, one of the block's own sums, too."""

    def own(batches) -> Iterator[tuple]:
        hw, hw_p, hw_a, hp, hp_d, bos = hot.value
        for tok, ctx, size, ids in _blocks(batches, 1):
            n = len(size)
            text = np.repeat(np.arange(n), size)
            sums = np.zeros((n, 3))  # model, base, known
            is_hot, k = _found(tok, hw)
            sums[:, 1] = np.bincount(text[is_hot], hw_p[k[is_hot]], n)
            sums[:, 0] = sums[:, 1] + np.bincount(text[is_hot], hw_a[k[is_hot]], n) + bos
            sums[:, 2] = np.bincount(text[is_hot], minlength=n)
            pair = _pair(ctx, tok)
            pair_hot, k = _found(pair, hp)
            sums[:, 0] += np.bincount(text[pair_hot], hp_d[k[pair_hot]], n)
            asked = []
            for key, mask in ((tok, ~is_hot), (pair, ~pair_hot)):
                mask &= _within(key, buckets, first, end)
                asked += [key[mask], np.bincount(text[mask], minlength=n)]
            yield len(tok), *asked, size, sums, np.asarray(ids.fill_null(0)), np.asarray(ids.is_null().cast(pa.uint8()))

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for word, words_of, pair, pairs_of, size, sums, ids, null in _runs(own(batches)):
            rows: dict[int, list] = {}
            for key, n, col in ((word, words_of, 3), (pair, pairs_of, 5)):
                order, cut = _parts(_bucket(key, buckets), buckets)
                key, of = key[order], np.repeat(np.arange(len(n), dtype=np.uint32), n)[order]
                for b in (first + np.flatnonzero(np.diff(cut[first : end + 1]))).tolist():
                    part = slice(cut[b], cut[b + 1])
                    rows.setdefault(b, [block, b, 1, b"", b"", b"", b""])[col : col + 2] = key[part].tobytes(), _by_text(of[part])
            own_row = [block, int(np.bitwise_and(block, 0x7FFFFFFF) % buckets), 0, ids.tobytes(), null.tobytes(), size.astype(np.int64).tobytes(), sums.tobytes()]
            some = [*rows.values(), *([] if first else [own_row])]
            cols = list(zip(*some, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[3:])], names=["block", "bucket", "own", "x1", "x2", "x3", "x4"])
            block += 1

    return run


def _answered(norm: float):
    """Each request's sums per text; a block's own row goes through."""
    unknown = math.log10(0.5 / norm)

    def run(ask: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        def table(kind: int, *columns: str) -> list[np.ndarray]:
            own = np.flatnonzero(model.kind.to_numpy() == kind)
            h = model.h.to_numpy(np.int64)[own].view(np.uint64)
            o = np.argsort(h, kind="stable")
            return [h[o], *(model[x].to_numpy(np.float64)[own[o]] for x in columns)]

        (w, c, alpha), (p, delta) = table(0, "c", "v"), table(1, "v")
        logp = np.log10((c + 0.5) / norm) if len(c) else c
        out = []
        for r in ask.itertuples(index=False):
            if not r.own:
                continue
            (wt, wn), (pt, pn) = _texts(r.x2), _texts(r.x4)
            text = np.union1d(wt, pt)
            sums, n = np.zeros((len(text), 3)), len(text)
            of = np.repeat(np.searchsorted(text, wt), wn)
            hit, k = _found(np.frombuffer(r.x1, np.uint64), w)
            sums[:, 1] = np.bincount(of, np.where(hit, logp[k] if len(w) else 0.0, unknown), n)
            sums[:, 0] = sums[:, 1] + (np.bincount(of[hit], alpha[k[hit]], n) if len(w) else 0)
            sums[:, 2] = np.bincount(of[hit], (c[k[hit]] > 0).astype(float), n) if len(w) else 0
            of = np.repeat(np.searchsorted(text, pt), pn)
            hit, k = _found(np.frombuffer(r.x3, np.uint64), p)
            if len(p):
                sums[:, 0] += np.bincount(of[hit], delta[k[hit]], n)
            out.append((r.block, r.bucket, 1, text.astype(np.uint32).tobytes(), b"", b"", sums.tobytes()))
        got = pd.DataFrame(out, columns=["block", "bucket", "own", "x1", "x2", "x3", "x4"])
        return pd.concat([got, ask[ask.own == 0]], ignore_index=True) if len(ask) else got

    return run


def _gathered(pdf: pd.DataFrame) -> pd.DataFrame:
    own = pdf[pdf.own == 0].iloc[0]
    total = np.frombuffer(own.x4, np.float64).reshape(-1, 3).copy()
    for r in pdf[pdf.own == 1].sort_values("bucket").itertuples(index=False):
        total[np.frombuffer(r.x1, np.uint32)] += np.frombuffer(r.x4, np.float64).reshape(-1, 3)
    ids = pd.Series(np.frombuffer(own.x1, np.int64)).astype("Int64").mask(np.frombuffer(own.x2, np.uint8) == 1)
    return pd.DataFrame({"doc_id": ids, "n_tokens": np.frombuffer(own.x3, np.int64), "n_known": total[:, 2].astype(np.int64), "base_score": total[:, 1], "score": total[:, 0]})


def score(docs: DataFrame, model: KatzModel) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    norm = model.n + 0.5 * (model.v + 1)
    most = model.n / HOT
    hw = sorted((np.uint64(r[0] & (2**64 - 1)), r[1], r[2]) for r in model.words.where(F.col("c") > most).select("h", "c", "alpha").collect())  # HOT rows at most
    hp = sorted((np.uint64(r[0] & (2**64 - 1)), r[1]) for r in model.pairs.where(F.col("n") > most).select("h", "delta").collect())  # HOT rows at most
    bos = model.words.where(F.col("h") == int(BOS.view(np.int64))).select("alpha").first()[0]
    col = lambda rows, k, t: np.array([r[k] for r in rows], t)
    hot = spark.sparkContext.broadcast((col(hw, 0, np.uint64), np.log10((col(hw, 1, float) + 0.5) / norm), col(hw, 2, float), col(hp, 0, np.uint64), col(hp, 1, float), bos))
    schema = "block long, bucket int, own int, x1 binary, x2 binary, x3 binary, x4 binary"
    rows = model.words.select("bucket", F.lit(0).alias("kind"), "h", "c", F.col("alpha").alias("v")).unionByName(model.pairs.select("bucket", F.lit(1).alias("kind"), "h", F.col("n").alias("c"), F.col("delta").alias("v")))
    got = []
    for first, end in _slices(model.buckets, SCORE_SLICES):
        ask = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_asked(model.buckets, first, end, hot), schema)
        part = rows.where((F.col("bucket") >= first) & (F.col("bucket") < end))
        with small_batches(spark):
            got.append(materialize(ask.groupBy("bucket").cogroup(part.groupBy("bucket")).applyInPandas(_answered(norm), schema)))
    return reduce(DataFrame.unionByName, got).groupBy("block").applyInPandas(_gathered, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def buckets_for(docs: DataFrame, tokens: int = TOKENS) -> int:
    """So many partitions that each sees about that many tokens."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(size / 6 / tokens))


def learn_and_score(docs: DataFrame, learn: str) -> DataFrame:
    """score() of all docs by a model of those that meet the condition learn, with train_tokens.

    All counted pairs are kept, those counted once discounted like the others.
    """
    buckets = buckets_for(docs)
    model = train(docs.where(learn), buckets)
    return score(docs, model).withColumn("train_tokens", F.lit(model.n).cast("long"))
