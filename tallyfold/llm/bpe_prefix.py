"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is one token that ends the prefix's encoding. It is
the token that matches a suffix of the prefix and that is compatible with the last
token of what stands before it: encoding the two tokens' joint text gives the two
back. Suffix matches come from a suffix automaton of the vocabulary, read once along
the word; compatibility from undoing the two tokens' merges, newest first. Following
the stored tokens back from the whole word emits its ids. Time is linear in a word's
length; no merge queue is kept.

Texts are normalised and cut into words as the vocabulary file says (NFC, white space,
lower case, its split pattern, byte alphabet, word ends); the strings of its special
tokens are recognised in raw text. Null texts count as empty; an empty text has no ids.

Texts come in blocks of bytes. Their words are found, told apart by hashes and checked byte
by byte in numpy; words that a worker does not remember are encoded together, one prefix
length after the other, and of words in ascending order a shared prefix is worked out once.
Chunks (between white space) with letters beyond Latin-1, apostrophes, special tokens'
brackets or control characters take the library's rules one by one. What a worker
remembers is bounded in entries and in their length.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .words import hashes, text_blocks

#: Words that a worker remembers, and the longest of them in bytes.
MEMORY, LONGEST = 200_000, 32
#: Bytes of text whose words are looked up together.
BLOCK = 1 << 20
#: White space as the normaliser's regular expressions know it.
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def byte_alphabet() -> list[str]:
    """A printable character for each byte; unprintable bytes get those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class SuffixAutomaton:
    """Of several strings of small ints; finds all of them that end at each place of a text."""

    def __init__(self, strings: list[tuple[int, ...]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.whole: dict[int, int] = {}
        ends = []
        for s in strings:
            last = 0
            for c in s:
                last = self._extend(last, c)
            ends.append(last)
        for k, s in enumerate(strings):  # the state in which a string is longest
            state = ends[k]
            while self.link[state] >= 0 and self.length[self.link[state]] >= len(s):
                state = self.link[state]
            self.whole[state] = k
        n = len(self.link)
        self.up = [-1] * n  # the nearest state along links, itself included, that is a whole string
        for state in sorted(range(n), key=self.length.__getitem__):
            if state:
                self.up[state] = state if state in self.whole else self.up[self.link[state]]

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, c)
        new = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        new = len(self.link)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new


class WordBpe:
    """The vocabulary file's encoder."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        letters = byte_alphabet()
        names = [*letters, *(x + self.suffix for x in letters)]
        own = {name: k for k, name in enumerate(names)}  # units first, then tokens by merge
        strings: list[tuple[int, ...]] = [(k,) for k in range(512)]
        self.left, self.right, self.pair = [-1] * 512, [-1] * 512, {}
        for a, b in merges:
            x, y = own[a], own[b]
            own[a + b] = self.pair[x << 20 | y] = len(strings)
            strings.append(strings[x] + strings[y])
            self.left.append(x), self.right.append(y)
            names.append(a + b)
        self.names, self.ids = names, [vocab[x] for x in names]
        self.size = [len(s) for s in strings]
        self.auto = SuffixAutomaton(strings)
        self.fits: dict[int, bool] = {}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"], regex.V0)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.library = Tokenizer.from_file(path)
        self.byte = {x: k for k, x in enumerate(letters)}
        self.text_of = {i: n for n, i in vocab.items()} | {i: n for n, i in self.special.items()}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of a's text followed by b's is a, b.

        The parts that touch at the seam are taken apart, the newest merge first. A
        merge across the seam breaks the pair if it would have come before the merge
        that used up either part; of one merge's places the left one comes first.
        """
        pair, left, right = self.pair, self.left, self.right
        used_a = used_b = len(left) + 1
        while True:
            m = pair.get(a << 20 | b)
            if m is not None and m < used_a and m <= used_b:
                return False
            if a > b and a >= 512:
                used_a, a = a, right[a]
            elif b >= 512:
                used_b, b = b, left[b]
            elif a >= 512:
                used_a, a = a, right[a]
            else:
                return True

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Own numbers of the tokens of each word; words in ascending order share most of the work."""
        auto, size, fits = self.auto, self.size, self.fits
        nexts, link, up, whole, length = auto.next, auto.link, auto.up, auto.whole, auto.length
        last, states, before, out = [-1], [(0, 0)], b"", []  # of the prefixes of the word before, without its end
        for word in words:
            end, same = len(word) - 1, 0
            most = min(end, len(before) - 1)
            while same < most and word[same] == before[same]:
                same += 1
            del last[same + 1 :], states[same + 1 :]
            state, match = states[same]
            for i in range(same, end + 1):
                c = word[i] if i < end else word[i] + 256
                while c not in nexts[state] and state:
                    state = link[state]
                    match = length[state]
                state = nexts[state].get(c, 0)
                match = match + 1 if state else 0
                at = up[state]
                if at >= 0 and size[whole[at]] > match:  # a longer string of this state
                    at = up[link[at]]
                ends = -1
                while at >= 0:
                    t = whole[at]
                    start = i + 1 - size[t]
                    if not start:
                        ends = t
                        break
                    p = last[start]
                    if p >= 0:
                        key = p << 20 | t
                        ok = fits.get(key)
                        if ok is None:
                            if len(fits) > MEMORY:
                                fits.clear()
                            ok = fits[key] = self.compatible(p, t)
                        if ok:
                            ends = t
                            break
                    at = up[link[at]]
                last.append(ends)
                states.append((state, match))
            tokens, i = [], end + 1
            while i:
                tokens.append(last[i])
                i -= size[last[i]]
            out.append(tokens[::-1])
            del last[end + 1 :], states[end + 1 :]
            before = word
        return out

    def ids_of(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, in the order given."""
        order = sorted(range(len(words)), key=words.__getitem__)
        ids, out = self.ids, [[]] * len(words)
        for k, tokens in zip(order, self.encode_words([words[k] for k in order]), strict=True):
            out[k] = [ids[t] for t in tokens]
        return out

    def _words(self, text: str) -> list[bytes]:
        """Normalised words; of letters beyond Latin the library's own Unicode tables decide."""
        if max(text, default="") > "\u024f":
            cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.byte.__getitem__, w)) for w, _ in cut]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return [w.encode() for w in self.word.findall(_SPACE.sub(" ", text).lower())]

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a text without spaces; texts can be cut at spaces without changing any id."""
        if self.cut and "<" in chunk:
            parts = self.cut.split(chunk)
            return [i for k, p in enumerate(parts) for i in ([self.special[p]] if k % 2 else self._plain_ids(p))]
        return self._plain_ids(chunk)

    def _plain_ids(self, text: str) -> list[int]:
        return [i for ids in self.ids_of(self._words(text)) for i in ids]

    def encode(self, text: str | None) -> list[int]:
        return [i for c in chunks(text) for i in self.chunk_ids(c)]

    def decode(self, ids: list[int]) -> str:
        """Tokens' texts joined by one space: the file names no decoder."""
        return " ".join(self.text_of[i] for i in ids)


def chunks(text: str | None) -> list[str]:
    return (text or "").replace("\n", " ").split(" ")


class Lookup:
    """Non-negative int64 keys to values, -1 where there is none: a table with open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):  # of several keys for a free slot the first gets it
            free, first = np.unique(slot[todo], return_index=True)
            first = first[self.keys[free] < 0]
            at = todo[first]
            self.keys[slot[at]], self.values[slot[at]] = keys[at], values[at]
            todo = np.delete(todo, first)
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        got, out = self.keys[slot], self.values[slot]
        todo = np.flatnonzero((got != keys) & (got >= 0))
        out[got != keys] = -1
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            got = self.keys[slot[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        return out


class PrefixTable:
    """The automaton and the merges as arrays; encodes many words at once."""

    def __init__(self, bpe: WordBpe) -> None:
        auto, ints = bpe.auto, lambda x: np.array(x, np.int32)
        self.step = Lookup(np.array([s << 9 | c for s, d in enumerate(auto.next) for c in d], np.int64), ints([t for d in auto.next for t in d.values()]))
        self.link, self.length, self.up = ints(auto.link), ints(auto.length), ints(auto.up)
        self.whole = np.full(len(self.link), -1, np.int32)
        self.whole[list(auto.whole)] = list(auto.whole.values())
        self.size, self.left, self.right, self.ids = ints(bpe.size), ints(bpe.left), ints(bpe.right), np.array(bpe.ids, np.uint32)
        self.pair = Lookup(np.array(list(bpe.pair), np.int64), ints(list(bpe.pair.values())))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """WordBpe.compatible for each pair."""
        a, b, out, todo = a.copy(), b.copy(), np.ones(len(a), bool), np.arange(len(a))
        used_a = np.full(len(a), len(self.left) + 1, np.int32)
        used_b = used_a.copy()
        while len(todo):
            m = self.pair[a.astype(np.int64) << 20 | b]
            across = (m >= 0) & (m < used_a) & (m <= used_b)
            out[todo[across]] = False
            go = ~across & ((a >= 512) | (b >= 512))
            todo, a, b, used_a, used_b = todo[go], a[go], b[go], used_a[go], used_b[go]
            of_a = (a >= 512) & ((a > b) | (b < 512))
            used_a, used_b = np.where(of_a, a, used_a), np.where(of_a, used_b, b)
            a, b = np.where(of_a, self.right[a], a), np.where(of_a, b, self.left[b])
        return out

    def encode(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words flat[start : start + size], one after the other, and how many each has."""
        if not len(size):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        width = int(size.max())
        inside = np.arange(width) < size[:, None]
        w = np.where(inside, flat[np.minimum(start[:, None] + np.arange(width), len(flat) - 1)], 0).astype(np.uint8)
        order = np.argsort(w.view(f"S{width}").ravel(), kind="stable")
        unit, n = w[order].astype(np.int64), size[order]
        rows = np.arange(len(n))
        unit[rows, n - 1] += 256
        shared = np.zeros(len(n), np.int64)
        shared[1:] = (unit[1:] != unit[:-1]).argmax(axis=1)
        last = np.full((len(n), width + 1), -1, np.int32)
        state, match = np.zeros(len(n), np.int32), np.zeros(len(n), np.int32)
        for d in range(width):
            alive, own = n > d, (n > d) & (shared <= d)
            some = np.flatnonzero(own)
            state[some], match[some], last[some, d + 1] = self._longer(state[some], match[some], unit[some, d], last, some, d + 1)
            like = np.flatnonzero(alive & ~own)
            of = np.maximum.accumulate(np.where(own, rows, 0))[like]
            state[like], match[like], last[like, d + 1] = state[of], match[of], last[of, d + 1]
        out, count, at = np.zeros((len(n), width), np.uint32), np.zeros(len(n), np.int64), n.copy()
        todo = rows
        while len(todo):
            t = last[todo, at[todo]]
            count[todo] += 1
            out[todo, width - count[todo]] = self.ids[t]
            at[todo] -= self.size[t]
            todo = todo[at[todo] > 0]
        back = np.empty(len(n), np.int64)
        back[order] = rows
        out, count = out[back], count[back]
        return out[np.arange(width) >= width - count[:, None]], count

    def _longer(self, state: np.ndarray, match: np.ndarray, unit: np.ndarray, last: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States, matched lengths and last tokens of prefixes of that size, one unit longer than before."""
        s, m = state.copy(), match.copy()
        todo = np.arange(len(s))
        while len(todo):
            to = self.step[s[todo].astype(np.int64) << 9 | unit[todo]]
            hit = to >= 0
            s[todo[hit]], m[todo[hit]] = to[hit], m[todo[hit]] + 1
            todo = todo[~hit]
            s[todo] = self.link[s[todo]]  # every unit is a token, so the root has a step for each
            m[todo] = self.length[s[todo]]
        at, found = self.up[s], np.full(len(s), -1, np.int32)
        over = (at >= 0) & (self.size[self.whole[at]] > m)  # a longer string of this state
        at[over] = self.up[self.link[at[over]]]
        todo = np.flatnonzero(at >= 0)
        while len(todo):
            t = self.whole[at[todo]]
            before = size - self.size[t]
            p = last[rows[todo], before]
            fits = before == 0
            test = np.flatnonzero(p >= 0)
            fits[test] = self.compatible(p[test], t[test])
            found[todo[fits]] = t[fits]
            todo = todo[~fits]
            at[todo] = self.up[self.link[at[todo]]]
            todo = todo[at[todo] >= 0]
        return s, m, found


_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = np.isin(np.arange(256), [*range(97, 123), 0xC3, *range(0x80, 0xC0)])
_DIGIT = np.isin(np.arange(256), range(48, 58))
_KIND = np.where(_SPACES, 0, np.where(_LETTER, 1, np.where(_DIGIT, 2, 3))).astype(np.uint8)
#: Bytes whose chunks are cut by the library's rules: controls, ' and <, first bytes of letters beyond U+00FF and of signs from U+0080 on.
_ODD = np.isin(np.arange(256), [*range(9), *range(14, 32), 39, 60, 127, *range(0xC0, 0xC3), *range(0xC4, 256)])
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, starts and ends of units, whether each is odd, and where each text's begin.

    A unit is a word, or a whole chunk, in its own case, where the chunk is odd.
    """
    n = len(buf)
    low, odd = _SMALL[buf], _ODD[buf]
    latin = np.zeros(n, bool)
    latin[1:] = buf[:-1] == 0xC3
    low[latin & (buf < 0x9F) & (buf != 0x97)] += 32
    odd |= latin & ((buf == 0x97) | (buf == 0xB7))
    kind = _KIND[low]
    inside, edge = kind > 0, np.zeros(n + 1, bool)
    edge[offs] = True
    fresh, final = edge[:-1].copy(), edge[1:].copy()
    fresh[1:] |= ~inside[:-1]
    final[:-1] |= ~inside[1:]
    chunk, upto = np.flatnonzero(inside & fresh), np.flatnonzero(inside & final) + 1
    sums = np.concatenate([[0], np.cumsum(odd)])
    bad = sums[upto] > sums[chunk]
    turns = np.zeros(n + 1, np.int8)
    turns[chunk[bad]] += 1
    turns[upto[bad]] -= 1
    whole = np.cumsum(turns[:-1], dtype=np.int8) > 0
    start = kind == 2
    start[1:] |= kind[1:] != kind[:-1]
    start &= inside & ~whole
    start[chunk] = True
    end = inside & final
    end[:-1] |= start[1:] & inside[:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return np.where(whole, buf, low), s, e, whole[s], np.searchsorted(s, offs)


def _bytes_at(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of runs of bytes, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum(), dtype=np.int64)


def _gathered(flat: np.ndarray, size: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Of runs of flat, with these sizes, those numbered by of."""
    start = np.cumsum(size) - size
    return flat[_bytes_at(start[of], size[of])]


class BlockEncoder:
    """Ids of texts by blocks; remembers units by hash, bytes and ids."""

    def __init__(self, bpe: WordBpe) -> None:
        self.bpe, self.table = bpe, PrefixTable(bpe)
        self._forget()

    def _forget(self) -> None:
        self.h, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.raw, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64)
        self.ids, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _new(self, flat: np.ndarray, size: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different units, and how many each has."""
        start, n, parts = np.cumsum(size) - size, np.zeros(len(size), np.int64), []
        plain = ~odd & (size <= LONGEST)
        ids, n[plain] = self.table.encode(flat, start[plain], size[plain])
        parts.append(ids)
        rest = np.flatnonzero(~plain)
        raw = [flat[start[k] : start[k] + size[k]].tobytes() for k in rest]
        for k, r in zip(rest, raw, strict=True):
            got = np.array(self.bpe.chunk_ids(r.decode()) if odd[k] else self.bpe.ids_of([r])[0], np.uint32)
            n[k] = len(got)
            parts.append(got)
        order = np.argsort(np.concatenate([np.flatnonzero(plain), rest]), kind="stable")
        sizes = np.concatenate([n[plain], n[rest]])
        return _gathered(np.concatenate(parts), sizes, order), n

    def _values(self, h: np.ndarray, flat: np.ndarray, size: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different units with ascending hashes, and how many each has."""
        at = np.minimum(np.searchsorted(self.h, h), max(len(self.h) - 1, 0))
        held = self.h[at] == h if len(self.h) else np.zeros(len(h), bool)
        known = held & (self.size[at] == size) if len(self.h) else held
        old_start, start = np.cumsum(self.size) - self.size, np.cumsum(size) - size
        k = np.flatnonzero(known)
        same = self.raw[_bytes_at(old_start[at[k]], size[k])] == flat[_bytes_at(start[k], size[k])]
        if not same.all():
            known[np.repeat(k, size[k])[~same]] = False
            k = np.flatnonzero(known)
        new = np.flatnonzero(~known)
        new_flat = _gathered(flat, size, new)
        new_ids, new_n = self._new(new_flat, size[new], odd[new])
        old_ids, old_n = _gathered(self.ids, self.n, at[k]), self.n[at[k]]
        n = np.zeros(len(h), np.int64)
        n[k], n[new] = old_n, new_n
        order = np.argsort(np.concatenate([k, new]), kind="stable")
        ids = _gathered(np.concatenate([old_ids, new_ids]), np.concatenate([old_n, new_n]), order)
        short = size <= LONGEST
        if len(self.h) + len(new) > MEMORY:  # what this block has stays
            self.h, self.raw, self.size, self.ids, self.n = h[short], _gathered(flat, size, np.flatnonzero(short)), size[short], _gathered(ids, n, np.flatnonzero(short)), n[short]
        elif len(new):
            more = new[short[new] & ~held[new]]
            both = np.argsort(np.concatenate([self.h, h[more]]), kind="stable")
            self.raw = _gathered(np.concatenate([self.raw, _gathered(flat, size, more)]), np.concatenate([self.size, size[more]]), both)
            self.ids = _gathered(np.concatenate([self.ids, _gathered(ids, n, more)]), np.concatenate([self.n, n[more]]), both)
            self.h, self.size, self.n = np.concatenate([self.h, h[more]])[both], np.concatenate([self.size, size[more]])[both], np.concatenate([self.n, n[more]])[both]
        return ids, n

    def _block(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, and where each text's begin."""
        body, start, end, odd, at = units(buf, offs)
        size = end - start
        h, first, of = np.unique(hashes(body, start, end), return_index=True, return_inverse=True)
        if not (np.array_equal(size, size[first][of]) and (body[_bytes_at(start, size)] == body[_bytes_at(start[first][of], size)]).all()):
            raise ValueError("two different words of a block have one 64-bit hash")
        ids, n = self._values(h, body[_bytes_at(start[first], size[first])], size[first], odd[first])
        upto = np.concatenate([[0], np.cumsum(n[of])])
        return _gathered(ids, n, of), upto[at]

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for lo, hi, buf, offs in text_blocks(column, BLOCK):
            if hi - lo > 1 or len(buf) <= 4 * BLOCK:
                ids, at = self._block(buf, offs)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    yield ids[a:b]
            else:  # a very long text, cut at white space
                yield np.concatenate([self._block(part, np.array([0, len(part)]))[0] for part in cut_at_space(buf, BLOCK)])


def cut_at_space(buf: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Parts of about size bytes that end before white space, or later where none is near."""
    space = np.flatnonzero((buf == 32) | ((buf >= 9) & (buf <= 13)))
    lo = 0
    while lo < len(buf):
        k = np.searchsorted(space, lo + size)
        hi = int(space[k]) if k < len(space) else len(buf)
        yield buf[lo:hi]
        lo = hi


_loaded: dict[str, WordBpe] = {}
_blocks: dict[str, BlockEncoder] = {}


def encoder(path: str) -> WordBpe:
    """One per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def block_encoder(path: str) -> BlockEncoder:
    """One per Python worker and file."""
    if path not in _blocks:
        _blocks[path] = BlockEncoder(encoder(path))
    return _blocks[path]


def _digests(path: str):
    def run(batches):
        blocks = block_encoder(path)
        number = [str(i) for i in range(max(blocks.bpe.text_of) + 1)]
        text = [blocks.bpe.text_of.get(i, "") for i in range(len(number))]
        for batch in batches:
            n, a, b = [], [], []
            for ids in blocks.texts(batch.column(1)):
                ids = ids.tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join([number[i] for i in ids]).encode()).hexdigest())
                b.append(hashlib.sha256(" ".join([text[i] for i in ids]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) as doc_id, ids."""

    def run(batches):
        blocks = block_encoder(path)
        for batch in batches:
            ids = [x.astype(np.int32) for x in blocks.texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """ids (doc_id, ids) as doc_id, text; null ids give an empty text."""

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            text = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(text, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode without keeping either."""
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
