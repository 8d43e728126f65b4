"""Pre-tokenisation by numpy, and encoding that merges each distinct pre-token once.

Texts whose code points all lie below LIMIT (Latin letters, digits, ASCII and Latin-1
signs, whose character classes are the same in every Unicode version in use) are split
by array operations; any other text goes to the library whole. Both give the ids of the
library.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re

import numpy as np
import regex

LIMIT = 0x250
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Entries of a worker's pre-token cache before it starts anew.
CACHE = 600_000


@functools.cache
def _classes() -> np.ndarray:
    lut = np.zeros(LIMIT, np.uint8)
    for i in range(LIMIT):
        c = chr(i)
        lut[i] = LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else SPACE if regex.match(r"\s", c) else OTHER
    return lut


_tables: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64; a worker keeps the longest tables only."""
    if not _tables or len(_tables[0]) < n:
        base = 0x9E3779B97F4A7C15 | 1
        made = []
        for x in (base, pow(base, -1, 1 << 64)):
            t = np.full(max(1 << 16, -(-n // 65536) * 65536), x, np.uint64)
            t[0] = 1
            made.append(np.cumprod(t, dtype=np.uint64, out=t))
        _tables[:] = made
    return _tables[0][:n], _tables[1][:n]


@functools.cache
def symbol_codes() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, 0x10000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the spans of an array of small integers."""
    up, down = powers(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbol_codes()[symbols] * up[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def split_byte_level(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of public_tokenizers.PATTERN; first: where each text begins (none is empty)."""
    n = len(cp)
    cls = _classes()[cp]
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(cls[1:], cls[:-1], out=begin[1:])
    begin[first] = True
    text_first = np.zeros(n + 1, bool)
    text_first[first] = True
    text_first[n] = True
    space = cls == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~text_first[1:n])
    begin[last] = True
    begin[last[cp[last] == 32] + 1] = False
    _contractions(cp, cls, begin, text_first, True)
    return np.flatnonzero(begin)


def _contractions(cp, cls, begin, text_first, spaced) -> None:
    n = len(cp)
    at = np.flatnonzero(cp == 39)
    if not len(at):
        return
    lead = text_first[at]
    before = at - 1
    ok = lead | ((cls[before] != OTHER) & (~np.bool_(spaced) | (cp[before] != 32)))
    at = at[ok]
    one = at[(at + 1 < n) & ~text_first[np.minimum(at + 1, n)]]
    c1 = cp[one + 1]
    two = np.isin(c1, [ord(c) for c in "stmd"])
    short = one[two]
    rest = one[~two]
    rest = rest[(rest + 2 < n) & ~text_first[np.minimum(rest + 2, n)]]
    pair = cp[rest + 1].astype(np.int64) * 0x10000 + cp[rest + 2]
    long = rest[np.isin(pair, [ord(a) * 0x10000 + ord(b) for a, b in ("re", "ve", "ll")])]
    for hit, size in ((short, 2), (long, 3)):
        begin[hit] = True
        begin[hit + 1] = False
        end = hit + size
        begin[end[end < n]] = True


def split_words(cp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of the word vocabulary (white space dropped, digits alone)."""
    n = len(cp)
    cls = _classes()[cp]
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(cls[1:], cls[:-1], out=begin[1:])
    begin |= cls == NUMBER
    begin[first] = True
    text_first = np.zeros(n + 1, bool)
    text_first[first] = True
    text_first[n] = True
    _contractions(cp, cls, begin, text_first, False)
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    keep = cls[starts] != SPACE
    return starts[keep], ends[keep]


@functools.cache
def rank_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def json_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_beyond = re.compile("[^\\x00-\u024f]").search


class Encoder:
    """ids of many texts at once: `ids(texts)` gives one uint32 array for all and the offset of each text."""

    def __init__(self, split, whole, pieces, special: str = "", lower: bool = False):
        """whole(text): the library's ids of any text; pieces(list of distinct pre-tokens): their ids."""
        self.split, self.whole, self.pieces, self.special, self.lower = split, whole, pieces, special, lower
        self._forget()

    def _forget(self) -> None:
        """An empty cache: hashes of pre-tokens, where the ids of each begin and how many, all these ids, and a hash table of numbers of hashes."""
        self.known, self.base, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.table = np.empty(0, np.uint32)
        self.bits, self.entries = 16, np.full(1 << 16, -1, np.int32)

    def _place(self, first: int) -> None:
        """Put the known hashes from the first on into the table, by open addressing."""
        at = (self.known[first:] >> np.uint64(64 - self.bits)).astype(np.int64)
        entry = np.arange(first, len(self.known), dtype=np.int32)
        while len(at):
            free = np.flatnonzero(self.entries[at] < 0)
            self.entries[at[free]] = entry[free]  # of several for one place, one stays
            left = self.entries[at] != entry
            at, entry = (at[left] + 1) & ((1 << self.bits) - 1), entry[left]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the hashes among the known ones, or -1."""
        if not len(self.known):
            return np.full(len(hashes), -1, np.int32)
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.entries[at]
        far = np.flatnonzero((self.known.take(out, mode="clip") != hashes) & (out >= 0))
        while len(far):
            at[far] = x = (at[far] + 1) & ((1 << self.bits) - 1)
            out[far] = entry = self.entries[x]
            far = far[(self.known.take(entry, mode="clip") != hashes[far]) & (entry >= 0)]
        return out

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        lists = self.pieces(words)
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        base = len(self.table) + np.cumsum(count) - count
        self.table = np.concatenate((self.table, np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(count.sum()))))
        self.known, self.base, self.count = np.concatenate((self.known, hashes)), np.concatenate((self.base, base)), np.concatenate((self.count, count))
        first = len(self.known) - len(hashes)
        if 2 * len(self.known) > 1 << self.bits:
            self.bits, first = (2 * len(self.known)).bit_length(), 0
            self.entries = np.full(1 << self.bits, -1, np.int32)
        self._place(first)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        fast, slow = [], {}
        for i, t in enumerate(texts):
            if not t:
                continue
            if (self.special and self.special in t) or not (t.isascii() or not _beyond(t)) or (self.lower and "İ" in t):
                slow[i] = np.asarray(self.whole(t), np.uint32)
            else:
                fast.append(i)
        counts = np.zeros(len(texts), np.int64)
        flat = np.empty(0, np.uint32)
        if fast:
            chosen = [texts[i].lower() if self.lower else texts[i] for i in fast]
            flat, n = self._fast(chosen)
            counts[fast] = n
        if not slow:
            return flat, np.concatenate(([0], np.cumsum(counts)))
        parts, at = [], np.concatenate(([0], np.cumsum(counts)))
        for i in range(len(texts)):
            parts.append(slow[i] if i in slow else flat[at[i] : at[i + 1]])
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def _fast(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        size = np.array([len(t) for t in texts], np.int64)
        first = np.concatenate(([0], np.cumsum(size)))[:-1]
        got = self.split(cp, first)
        starts, ends = got if isinstance(got, tuple) else (got, np.append(got[1:], len(cp)))
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        hashes = span_hashes(cp, starts, ends)
        entry = self._find(hashes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            distinct, index, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            if len(self.known) + len(distinct) > CACHE:
                self._forget()
                new = np.arange(len(hashes))
                distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            entry[new] = len(self.known) + inverse
            index = new[index]
            self._learn(distinct, [joined[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist())])
        count = self.count[entry]
        ends_at = np.cumsum(count)
        total = int(ends_at[-1])
        pick = np.arange(total)
        pick += np.repeat(self.base[entry] - (ends_at - count), count)
        before = np.concatenate(([0], ends_at))[np.searchsorted(starts, np.append(first, len(cp)))]
        return self.table[pick], np.diff(before)


@functools.cache
def rank_encoder(path: str, pattern: str) -> Encoder:
    """Of a tiktoken rank file, as encode_ordinary would."""
    e = rank_encoding(path, pattern)
    return Encoder(split_byte_level, e.encode_ordinary, lambda ws: [e._encode_single_piece(w.encode()) for w in ws])


def _shown_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(shown))}


@functools.cache
def byte_json_encoder(path: str) -> Encoder:
    """Of a byte-level JSON vocabulary without normaliser, as tokenizers would.

    The vocabulary's ids are its merge ranks, so the distinct pre-tokens are merged by
    tiktoken with the ranks read from the same file.
    """
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    t = json_tokenizer(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = _shown_bytes()
    special = {x["content"] for x in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
    core = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Encoder(split_byte_level, lambda x: t.encode(x, add_special_tokens=False).ids, lambda ws: [core._encode_single_piece(w.encode()) for w in ws], special="<|")


@functools.cache
def word_json_encoder(path: str) -> Encoder:
    """Of the lower-casing word vocabulary, as tokenizers would.

    A distinct pre-token of common bytes is merged by tiktoken: its bytes are renumbered so
    that a byte at a word's end is another symbol than inside, as the vocabulary has it;
    the vocabulary's ids are its merge ranks. Others go to the library.
    """
    import json

    import tiktoken

    t = json_tokenizer(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of, end = _shown_bytes(), spec["model"]["end_of_word_suffix"]
    common = [*range(33, 65), *range(91, 127), 0xC2, 0xC3, *range(0xA0, 0xC0)]
    inner, final = bytearray(256), bytearray(256)
    for i, b in enumerate(common):
        inner[b], final[b] = i, 128 + i
    ranks = {}
    for w, i in spec["model"]["vocab"].items():
        last = w.endswith(end)
        raw = bytes(byte_of[c] for c in w.removesuffix(end))
        if all(b in common for b in raw):
            ranks[raw[: len(raw) - last].translate(inner) + raw[len(raw) - last :].translate(final)] = i
    ranks |= {bytes([b]): -1 - b & 0xFFFFFFFF for b in range(256) if bytes([b]) not in ranks}  # never asked for
    core = tiktoken.Encoding(path, pat_str="", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
    rare = np.ones(256, bool)
    rare[common] = False
    final_of, merged = np.frombuffer(bytes(final), np.uint8), core._core_bpe.encode_single_piece

    def pieces(words: list[str]) -> list[list[int]]:
        joined = "\n".join(words).encode()  # no pre-token holds white space
        raw = np.frombuffer(joined + b"\n", np.uint8)
        ends = np.flatnonzero(raw == 10)
        starts = np.append(0, ends[:-1] + 1)
        symbols = np.frombuffer(joined.translate(inner) + b"\n", np.uint8).copy()
        symbols[ends - 1] = final_of[raw[ends - 1]]
        held = np.concatenate(([0], np.cumsum(rare[raw])))
        odd = np.flatnonzero(held[ends] > held[starts]).tolist()
        data, skip = symbols.tobytes(), set(odd)
        out: list = [None if i in skip else merged(data[a:b]) for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist()))]
        for i, e in zip(odd, t.encode_batch_fast([words[i] for i in odd], add_special_tokens=False) if odd else []):
            out[i] = e.ids
        return out

    return Encoder(split_words, lambda x: t.encode(x, add_special_tokens=False).ids, pieces, special="<|", lower=True)
