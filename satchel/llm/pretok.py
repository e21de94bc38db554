"""Byte-level BPE encoding of many texts at once.

The text is cut into pre-tokens with array operations on code points (the pattern that the public rank files name), each
distinct pre-token is encoded once by the given encoder, and a bounded hash table in each worker keeps what it returned.
A pre-token is looked up by a 64-bit hash, and what is found counts only if all its characters are the same.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from satchel.llm.common import STEP_BYTES, ranges, steps

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
TOP = 0x110000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Entries of a worker's table; it starts anew when it is half full.
SLOTS = 1 << 21
#: Characters of pre-tokens that a worker keeps before it starts anew.
KEPT = 1 << 25
#: Bytes of text that are encoded at a time; the arrays for them need some 60 times as much memory.
RUN_BYTES = 1 << 18
#: Cuts that never divide a pre-token: before a lone blank between two other characters, and after a letter or digit before a
#: character that is none of these, nor a blank or an apostrophe.
SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r]\S)|(?<=[^\W_])(?=[^\w\s']|_)")



@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point, and a random 64-bit number for it."""
    import regex

    kinds = np.zeros(TOP, np.uint8)
    codes = np.arange(TOP, dtype="<u4")
    whole = np.delete(codes, slice(0xD800, 0xE000)).tobytes().decode("utf-32-le")  # a list of all characters would take 80 MB
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, whole):
            a, b = (x + (0x800 if x >= 0xD800 else 0) for x in (m.start(), m.end() - 1))
            kinds[a : b + 1] = kind
    return kinds, np.random.default_rng(20).integers(1, 1 << 63, TOP, np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i up to n."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        size = max(n, 1 << 16)
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, b, np.uint64))]) for b in (BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def cut(cps: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The starts of the pre-tokens of texts that begin at firsts."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = tables()[0][cps]
    first = np.zeros(n + 3, bool)
    first[firsts[firsts < n]] = True
    first[n:] = True
    b = np.ones(n + 3, bool)
    np.not_equal(kind[1:], kind[:-1], out=b[1:n])
    b[:n] |= first[:n]
    space = kind == SPACE
    # a run of white space before other characters gives up its last one
    ends = np.flatnonzero(b[1:n] & ~first[1:n] & space[:-1] & ~space[1:]) + 1
    b[ends - 1] = True
    b[ends[cps[ends - 1] == 32]] = False
    quote = np.flatnonzero((cps == 39) & b[:n])
    if len(quote):
        wide = np.concatenate([cps, np.zeros(3, cps.dtype)])
        one, two = wide[quote + 1], wide[quote + 2]
        near = ~first[quote + 1]
        short = near & np.isin(one, [115, 116, 109, 100])
        long = near & ~first[quote + 2] & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        for at, width in ((quote[short], 2), (quote[long], 3)):
            b[at + 1] = False
            if width == 3:
                b[at + 2] = False
            b[at + width] = True
    return np.flatnonzero(b[:n])


def hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of code points. It is quick, but there are patterns that collide: whoever needs certainty compares
    the characters."""
    up, down = powers(len(cps) + 1)
    sums = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(tables()[1][cps] * up[: len(cps)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h = (h + (ends - starts).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h[h == 0] = 1
    return h


class Encoder:
    """Texts to ids. pieces: encodes a list of distinct pre-tokens."""

    def __init__(self, pieces: Callable[[list[str]], list[list[int]]], slots: int = SLOTS):
        self.pieces, self.slots = pieces, slots
        self.clear()

    def clear(self) -> None:
        # as long as they are meant to get: pages of zeros that nothing is written to take no memory, while growing would take both copies
        half = self.slots // 2
        self.keys, self.where = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.off, self.num, self.n = np.zeros(half, np.int32), np.zeros(half, np.int32), 0
        self.flat, self.used = np.zeros(8 * half, np.int32), 0
        # the pre-tokens themselves, as code points
        self.chars, self.first, self.size, self.held = np.zeros(KEPT, np.uint32), np.zeros(half, np.int64), np.zeros(half, np.int64), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where each hash is kept, -1 if it isn't."""
        mask = np.uint64(self.slots - 1)
        at = (h & mask).astype(np.int64)
        got = self.keys[at]
        out = np.where(got == h, self.where[at], -1)
        left = np.flatnonzero((got != h) & (got != 0))
        while len(left):
            at[left] = (at[left] + 1) & int(mask)
            got = self.keys[at[left]]
            hit = got == h[left]
            out[left[hit]] = self.where[at[left[hit]]]
            left = left[~hit & (got != 0)]
        return out

    def keep(self, text: str, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> int:
        """Encode pre-tokens of text and keep them, not yet to be found by a hash; returns the number of the first."""
        ids = self.pieces([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        k, num, size = len(ids), np.fromiter(map(len, ids), np.int32, len(ids)), ends - starts
        flat = np.fromiter((x for y in ids for x in y), np.int32, int(num.sum()))
        n, total = self.n, int(size.sum())
        while n + k > len(self.off):
            self.off, self.num, self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.off, self.num, self.first, self.size))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.held + total > len(self.chars):
            self.chars = np.concatenate([self.chars, np.zeros_like(self.chars)])
        self.off[n : n + k] = self.used + np.cumsum(num) - num
        self.num[n : n + k] = num
        self.first[n : n + k] = self.held + np.cumsum(size) - size
        self.size[n : n + k] = size
        self.flat[self.used : self.used + len(flat)] = flat
        self.chars[self.held : self.held + total] = cps[ranges(starts, size)]
        self.n, self.used, self.held = n + k, self.used + len(flat), self.held + total
        return n

    def index(self, h: np.ndarray, where: int) -> None:
        """New, distinct hashes, of what is kept from where on."""
        at, left = (h & np.uint64(self.slots - 1)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = self.keys[at[left]] == 0
            self.keys[at[left[free]]] = h[left[free]]
            mine = free & (self.keys[at[left]] == h[left])
            self.where[at[left[mine]]] = where + left[mine]
            left = left[~mine]
            at[left] = (at[left] + 1) & (self.slots - 1)

    def others(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which pre-tokens (they make up cps) aren't those kept at the numbers found."""
        size = ends - starts
        bad = self.size[at] != size
        if bad.any():
            ok = np.flatnonzero(~bad)
            mine, kept = ranges(starts[ok], size[ok]), ranges(self.first[at[ok]], size[ok])
            differs = np.flatnonzero(cps[mine] != self.chars[kept])
            bad[ok[np.searchsorted(np.cumsum(size[ok]), differs, "right")]] = True
        else:
            differs = np.flatnonzero(cps != self.chars[ranges(self.first[at], size)])
            bad[np.searchsorted(ends, differs, "right")] = True
        return np.flatnonzero(bad)

    def step(self, text: str, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that follow one another in text, with chars characters each, and how many of them each has."""
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        firsts = np.cumsum(chars) - chars
        starts = cut(cps, firsts[chars > 0])
        ends = np.append(starts[1:], len(cps))[: len(starts)]
        h = hashes(cps, starts, ends)
        at = self.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            if self.n + len(new) > self.slots // 2 or self.held > KEPT:
                self.clear()
                new = np.arange(len(h))
            fresh, i = np.unique(h[new], return_index=True)
            i = new[i]
            self.index(fresh, self.keep(text, cps, starts[i], ends[i]))
            at[new] = self.find(h[new])
        bad = self.others(cps, starts, ends, at)
        if len(bad):  # another pre-token has their hash
            at[bad] = self.keep(text, cps, starts[bad], ends[bad]) + np.arange(len(bad))
        num = self.num[at].astype(np.int64)
        ids = self.flat[ranges(self.off[at].astype(np.int64), num)]
        total = np.zeros(len(num) + 1, np.int64)
        np.cumsum(num, out=total[1:])
        by = np.append(firsts, len(cps))
        counts = np.diff(total[np.searchsorted(starts, by)])
        return ids, counts

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, and the texts' counts. Nulls have none. A text over STEP_BYTES is cut where that is safe."""
        flat, counts = [], np.zeros(len(arr), np.int64)
        at = 0
        batch = pa.record_batch([arr], names=["t"])
        for part in steps(batch, "t", RUN_BYTES):
            col = pc.fill_null(part.column(0), "")
            chars = pc.utf8_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(col) == 1 and chars[0] > STEP_BYTES // 2:
                for s in pieces_of(col[0].as_py(), STEP_BYTES // 2):
                    ids, n = self.step(s, np.array([len(s)]))
                    flat.append(ids)
                    counts[at] += n[0]
            else:
                ids, n = self.step("".join(col.to_pylist()), chars)
                flat.append(ids)
                counts[at : at + len(n)] = n
            at += len(col)
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), counts


def pieces_of(text: str, limit: int) -> list[str]:
    """Cut a long text into pieces of limit characters or somewhat more, at safe places only."""
    out, at = [], 0
    while len(text) - at > limit:
        m = SAFE.search(text, at + limit)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def tiktoken_of(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(4)
def rank_encoder(path: str) -> Encoder:
    """An encoder by a rank file, kept for the worker's life."""
    one = tiktoken_of(path)._core_bpe.encode_single_piece
    return Encoder(lambda words: [one(w.encode()) for w in words])


def default_path(name: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> str:
    return f"{folder}/{name}"
