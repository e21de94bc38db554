"""Words of many texts at once. A word is a longest run of bytes other than ASCII white space and controls."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from satchel.llm.pretok import BASE, powers

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
def windows(raw: np.ndarray, limit: int, overlap: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """One text's words by windows of about limit bytes: (number of the first word, how many of the words are this window's own,
    starts, ends). The rest of a window, `overlap` words, comes again at the beginning of the next."""
    begin, first = 0, 0
    while True:
        size = limit
        while True:
            end = min(begin + size, len(raw))
            while end < len(raw) and not _BLANK[raw[end]]:  # up to the end of a word
                blank = np.flatnonzero(_BLANK[raw[end : end + 4096]])
                end = min(end + (int(blank[0]) if len(blank) else 4096), len(raw))
            starts, ends, _ = bounds(raw[begin:end], np.array([0, end - begin]))
            if end == len(raw) or len(starts) > 2 * overlap:
                break
            size *= 2
        own = len(starts) if end == len(raw) else len(starts) - overlap
        yield first, own, starts + begin, ends + begin
        if end == len(raw):
            return
        first, begin = first + own, begin + int(starts[own]) if own < len(starts) else end


#: Longer words are hashed one by one.
LONG = 64
#: A prime, and a primitive root of it, for sums of powers that don't wrap around.
PRIME, ROOT = np.int64((1 << 31) - 1), 7


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and of each text the first word's number (one more entry at the end)."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~_BLANK[raw]
    b = np.zeros(n + 1, bool)
    b[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | b[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | b[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight bytes at a time go through a mixer that isn't linear, so that no pattern of the
    bytes makes words of one hash, as it does with sums of powers; words over LONG bytes have a cryptographic one."""
    n = ends - starts
    h = n.astype(np.uint64) * BASE
    if not len(n):
        return h
    low, high = int(starts[0]), int(ends[-1])
    data = np.zeros(high - low + 8, np.uint8)
    data[:-8] = raw[low:high]
    eight = np.ndarray(high - low + 1, "<u8", data, strides=(1,))
    short = n <= LONG
    live = np.flatnonzero(short)
    at = 0
    while len(live):
        left = np.minimum(n[live] - at, 8)
        part = eight[starts[live] - low + at] & (np.uint64((1 << 64) - 1) >> (np.uint64(8) * (np.uint64(8) - left.astype(np.uint64))))
        h[live] = mix(h[live] * BASE + mix(part ^ np.uint64(at + 1)))
        at += 8
        live = live[n[live] > at]
    for i in np.flatnonzero(~short).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_ids(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for words of the same bytes and for no others. The numbers are in no order: if they rose
    along the text, as those of the dictionary do, induced sorting would advance by far shorter stretches."""
    from satchel.llm.common import ranges

    offsets = np.append(0, np.cumsum(ends - starts))
    held = raw[ranges(starts, ends - starts)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)])
    held = words.dictionary_encode()
    return np.argsort(mix(np.arange(1, len(held.dictionary) + 1, dtype=np.uint64)))[held.indices.to_numpy()]


_ROOTS: list[np.ndarray] = []


def prime_sums(h: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each run h[start:stop], as a sum of powers in a prime field: 31 bits that have nothing to do with grams()."""
    size = len(h) + 1
    if not _ROOTS or len(_ROOTS[0]) < size:
        n = max(size, 1 << 16)
        up, down, x, y = np.ones(n, np.int64), np.ones(n, np.int64), ROOT, pow(ROOT, -1, int(PRIME))
        done = 1
        while done < n:  # by doubling
            m = min(done, n - done)
            up[done : done + m] = up[:m] * pow(x, done, int(PRIME)) % PRIME
            down[done : done + m] = down[:m] * pow(y, done, int(PRIME)) % PRIME
            done += m
        _ROOTS[:] = [up, down]
    up, down = _ROOTS
    sums = np.zeros(size, np.int64)
    np.cumsum((h % np.uint64(PRIME)).astype(np.int64) * up[: len(h)] % PRIME, out=sums[1:])
    return (sums[stops] - sums[starts]) % PRIME * down[starts] % PRIME


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row, of which the first is given: len(h) - k + 1 of them."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: len(h) - k + 1] * BASE)
