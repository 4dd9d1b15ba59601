"""Words of UTF-8 texts as numpy arrays, and Rabin-Karp hashes of every run of words.

Bytes, not characters: all separators are ASCII, so a byte rule and a code point rule agree. Hashes are polynomials
modulo 2^64 over an odd base (so a power has an inverse and a prefix-sum difference gives any run), finished by a
mixing step. ``PAIR`` has two independent bases; both together are the 128 bits that decide equality.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
PIECE = 1 << 20  # bytes hashed with one table of powers
# fixed odd multipliers (arbitrary)
PAIR = ((0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xC2B2AE3D27D4EB4F, 0xA24BAED4963EE407))


@lru_cache(8)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and its inverse powers modulo 2^64."""
    def row(b: int) -> np.ndarray:
        out = np.full(n, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)
    return row(base), row(pow(base, -1, 1 << 64))


def table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n - 1).bit_length())
    return powers(base, size)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def word_table(separators: bytes | None = None, keep: str = "") -> np.ndarray:
    """256 flags: byte belongs to a word. ``keep='alnum'``: digits, letters and all bytes above ASCII."""
    flags = np.ones(256, bool)
    if keep == "alnum":
        flags[:128] = False
        flags[48:58] = flags[65:91] = flags[97:123] = True
    else:
        flags[list(separators or SPACES)] = False
    return flags


SPACED, ALNUM = word_table(), word_table(keep="alnum")


def bounds(buf: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in a byte array."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = flags[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each word's bytes; long inputs go piece by piece, so tables and sums stay bounded."""
    base = PAIR[which][0]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
        hi = ends[j - 1]
        pw, inv = table(base, int(hi - lo))
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * pw[: hi - lo], out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[b] - sums[a]) * inv[a])
        i = j
    return out


def run_hashes(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Rolling hash of every ``n`` consecutive word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(m, np.uint64)
    for lo in range(0, m, PIECE):
        hi = min(m, lo + PIECE)
        part = words[lo : hi + n - 1]
        pw, inv = table(PAIR[which][1], len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * pw[: len(part)], out=sums[1:])
        out[lo:hi] = mix((sums[n : n + hi - lo] - sums[: hi - lo]) * inv[: hi - lo] + np.uint64(n))
    return out


class Words:
    """The words of several texts (one separator byte between them) with text number and place in the text."""

    def __init__(self, texts: list[bytes], flags: np.ndarray, lower: bool = False, pair: bool = True, sep: bytes = b" "):
        data = sep.join(texts)
        self.data = data.translate(LOWER_ASCII) if lower else data
        self.buf = np.frombuffer(self.data, np.uint8)
        self.starts, self.ends = bounds(self.buf, flags)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        first = np.cumsum(sizes) - sizes
        self.count = np.diff(np.append(np.searchsorted(self.starts, first), len(self.starts)))
        self.first = np.cumsum(self.count) - self.count
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self.place = np.arange(len(self.starts)) - self.first[self.text]
        self.h = [word_hashes(self.buf, self.starts, self.ends, w) for w in range(1 + pair)]

    def runs(self, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of ``n`` words inside one text."""
        h = run_hashes(self.h[which], n, which)
        at = np.flatnonzero(self.place[: len(h)] + n <= self.count[self.text[: len(h)]])
        return at, h[at]

    def slice(self, i: int, n: int) -> bytes:
        """Words i .. i+n-1 joined by one space."""
        return b" ".join(self.data[a:b] for a, b in zip(self.starts[i : i + n], self.ends[i : i + n]))
