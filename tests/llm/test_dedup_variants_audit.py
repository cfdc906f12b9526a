"""Exact dedup, spelling variants and the divergence audit against brute force, with odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import bloom_dedup, divergence_audit, spelling_variants

DOC = "doc_id long, text string, lang string, source string, digest int, `row` string, g map<string,int>"
ODD = [None, "", "", " ", "one", "x" * 40_000, "Ünï çödé ½ 日本語", "the cat sat on the mat"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, l, s, 1, "r", {"a": 1}) for i, t, l, s in rows], DOC)


@pytest.fixture(scope="module")
def copies(spark):
    random.seed(1)
    texts = ODD + [f"text {k % 90}" for k in range(300)] + ["hot"] * 200
    rows = [(i, t, None, "s") for i, t in enumerate(texts)]
    return table(spark, [*rows, rows[5], rows[5], (None, "hot", None, None), (None, "lone", None, None), (None, "lone", None, None)])


@pytest.mark.parametrize("most", [1 << 28, 1 << 12])
def test_copies(copies, most):
    rows = copies.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    got = bloom_dedup.copies(copies, most).collect()
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((i, h) for h, ids in by_hash.items() for i in ids)
    kept = Counter()
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(by_hash)


@pytest.mark.parametrize("most", [1 << 28, 1 << 12])
def test_deduplicate(copies, most):
    got = bloom_dedup.deduplicate(copies, most)
    assert got.columns == copies.columns
    want = {}
    for r in copies.collect():
        t = r.text or ""
        want[t] = max(want.get(t, -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in got.collect()) == sorted(want.items())


def test_only_repeated_rows_shuffle(spark):
    part = spark.range(2000).select(F.col("id").alias("doc_id"), bloom_dedup.digest(F.when(F.col("id") < 100, F.lit("same")).otherwise(F.col("id").cast("string"))).alias("digest"), F.col("id").alias("row"))
    alone, again = bloom_dedup._repeats(part, bloom_dedup.MOST)
    assert again.where("doc_id < 100").count() == 100 and again.count() < 300 and alone.count() + again.count() == 2000


def test_empty_tables(spark):
    none = table(spark, [])
    assert bloom_dedup.copies(none).count() == bloom_dedup.deduplicate(none).count() == spelling_variants.spelling_variants(none).count() == divergence_audit.divergence_audit(none).count() == 0


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows, letters=7, least=2, times=10):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= letters:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= least}
    ties = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(ties[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(ties[w]), n.get(form[w])))
    return out


def words_with_slips():
    random.seed(4)
    base = ["".join(random.choices("etaoinshré", k=random.randrange(7, 12))) for _ in range(40)]
    rows = []
    for i in range(400):
        text = []
        for _ in range(20):
            w = random.choice(base[:6] if random.random() < 0.8 else base)
            if random.random() < 0.15:
                k = random.randrange(len(w))
                w = random.choice([w[:k] + w[k + 1 :], w[:k] + random.choice("zxé") + w[k + 1 :], w[:k] + random.choice("zxÉ") + w[k:]])
            text.append(w.upper() if random.random() < 0.1 else w)
        rows.append((i, " ".join(text)))
    rows += [(i, t) for i, t in enumerate(ODD)] + [(None, "nothing nothing nothing"), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("least", [1, 2])
def test_variants(spark, least):
    rows = words_with_slips()
    docs = table(spark, [(i, t, None, None) for i, t in rows])
    got = {tuple(r) for r in spelling_variants.spelling_variants(docs, least=least).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute_variants(rows, least=least)


@pytest.mark.parametrize("symbols, most", [(2, 1 << 28), (8, 1 << 15), (1, 1 << 15)])
def test_near_words_in_any_alphabet_and_a_full_bitmap(spark, symbols, most):
    random.seed(9)
    words = sorted({"".join(random.choices("abc", k=random.randrange(1, 6))) for _ in range(150)} | {"a" * 30_000, "a" * 29_999, "é" * 7, "é" * 6 + "e"})
    got = [(r.word, r.near) for r in spelling_variants.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), symbols, most).collect()]
    short = [w for w in words if len(w) < 100]
    want = {(a, b) for a in short for b in short if near(a, b)} | {("a" * 30_000, "a" * 29_999), ("a" * 29_999, "a" * 30_000)}
    assert len(got) == len(set(got)) and set(got) == want


def test_neighbourhoods_hold_every_reduced_form():
    m = np.array([[1, 2, 1, 1], [2, 2, 2, 2]], np.uint64)
    row, key = spelling_variants.neighbourhood(m, 2)
    for r in range(2):
        w = m[r].tolist()
        forms = {tuple(w)} | {(*w[:i], *w[i + 1 :]) for i in range(4)} | {(*w[:i], s, *w[i + d :]) for d in (0, 1) for s in (1, 2) for i in range(5 - d)}
        assert sorted(key[row == r].tolist()) == sorted(int(spelling_variants.reduced(np.array([f], np.uint64))[0]) for f in forms)


def test_a_long_chain_of_forms_ends_at_its_root(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb", "abbbbbb", "bbbbbbb"]
    words = spark.createDataFrame([(w, 10 ** (k + 1)) for k, w in enumerate(chain)], "word string, n long")
    assert {(r.word, r.form, r.root) for r in spelling_variants.variants(words).collect()} == {(w, f, "bbbbbbb") for w, f in zip(chain, [*chain[1:], None], strict=True)}


def brute_audit(rows, least, top):
    docs = [(l or "", s or "", Counter("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or ""))) for _, t, l, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = sorted(w for w, n in Counter(w for d in own for w in d[2]).items() if n >= least)

        def p_of(group):
            c = {w: sum(d[2][w] for d in group) for w in kept}
            total = sum(c.values()) + 5 * len(kept)
            return c, {w: 1 + 10**9 * (c[w] + 5) // total for w in kept}

        whole = p_of(own)[1]
        each = {s: p_of([d for d in own if d[1] == s]) for s in {d[1] for d in own}}
        for s, (c, p) in each.items():
            pair = sorted((-sum(abs(p[w] - q[w]) for w in kept), o) for o, (_, q) in each.items() if o != s)
            term = sorted((whole[w] - p[w], w.encode()) for w in kept if c[w] and p[w] > whole[w])[:top]
            out += [(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(pair, 1)] + [(lang, s, "term", w.decode(), -v, k) for k, (v, w) in enumerate(term, 1)]
    return sorted(out)


@pytest.mark.parametrize("top, tile, block, held", [(50, 256, 512, 1 << 19), (4, 2, 8, 10)])
def test_audit(spark, monkeypatch, top, tile, block, held):
    for name, value in (("TILE", tile), ("BLOCK", block), ("HELD", held), ("PART", 1 << 14 if top == 50 else 16)):
        monkeypatch.setattr(divergence_audit, name, value)
    random.seed(6)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["Ünï", "été", "日本", "ABC"]
    rows = []
    for i in range(500):
        own = random.choices(vocabulary, k=random.randrange(25), weights=[1 + (k * i % 7) for k in range(len(vocabulary))])
        rows.append((i, " ".join(own), random.choice(["en", "en", "de", None]), f"s{min(i % 11, random.randrange(11))}"))
    rows += [(i, t, "en", None) for i, t in enumerate(ODD)] + [(1, None, "xx", "a"), (2, "few terms", "xx", "b"), (3, "", "en", "empty"), rows[0], rows[0]]
    got = sorted(tuple(r) for r in divergence_audit.divergence_audit(table(spark, rows), 30, top).collect())
    assert got == brute_audit(rows, 30, top)


@pytest.mark.parametrize("n, k, values", [(0, 3, 5), (700, 1, 4), (1500, 5, 1000), (300, 400, 3)])
def test_skyband(n, k, values):
    rng = np.random.default_rng(n)
    more, less, place = rng.integers(0, values, n), rng.integers(0, values, n), rng.permutation(n)
    worse = [((more >= more[i]) & (less <= less[i]) & (place < place[i])).sum() for i in range(n)]
    assert sorted(divergence_audit.skyband(more, less, place, k)) == [i for i in range(n) if worse[i] < k]
