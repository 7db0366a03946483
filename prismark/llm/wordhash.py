"""Vectorised word hashing over the raw UTF-8 buffer of an Arrow string column.

Everything here works on whole buffers with numpy, so a task never loops over words in Python. Hashes
are 64 bits: a polynomial over random per-byte codes, finished by an avalanche step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)

#: The white space of the contracts: space and the bytes 9 to 13.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNK_BYTES = 1 << 19
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse; grown when a longer buffer comes, then kept."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, _BASE_INV))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def lower(buf: np.ndarray) -> np.ndarray:
    """LOWER of each byte, by arithmetic, which is quicker than its table."""
    return buf + ((buf - np.uint8(65)) < 26).view(np.uint8) * np.uint8(32)


def white(buf: np.ndarray) -> np.ndarray:
    """WHITE of each byte, likewise."""
    return (buf == 32) | ((buf - np.uint8(9)) < 5)


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums of code * base^i before each position; differences give the hash of any substring."""
    up, _ = powers(len(buf))
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    codes = _CODES[buf]
    codes *= up[: len(buf)]
    np.cumsum(codes, out=out[1:])
    return out


def substring_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges of documents whose texts have about `most` bytes together; a longer document stands alone."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def word_spans(buf: np.ndarray, offsets: np.ndarray, edge: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of non-white bytes within a document) and words before each document.

    `edge` marks bytes at which a word ends and another begins.
    """
    dark = np.zeros(len(buf) + 2, bool)
    np.logical_not(white(buf), out=dark[1:-1])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    opens = dark[1:-1] & ~dark[:-2]
    closes = dark[1:-1] & ~dark[2:]
    opens[cut] |= dark[cut + 1]
    closes[cut - 1] |= dark[cut]
    if edge is not None:
        cut = np.flatnonzero(edge)
        opens[cut] |= dark[cut + 1]
        closes[cut - 1] |= dark[cut]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and the number of words before each document."""
    buf = lower(buf)
    starts, ends, firsts = word_spans(buf, offsets)
    return substring_hashes(prefix_sums(buf), starts, ends), firsts


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document's n-word shingles, one after another, and where each set starts.

    A document with fewer words has its whole word sequence as its only shingle; without words its set is empty.
    """
    hashes, firsts = words(buf, offsets)
    counts = np.diff(firsts)
    shingles = np.maximum(counts - n + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), shingles)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + firsts[:-1][doc]
    long = (counts >= n)[doc]
    out = np.zeros(len(doc), np.uint64)
    room = np.minimum(counts, n)[doc]
    for k in range(n):
        used = room > k
        out[used] = mix(out[used] * _U(0xD6E8FEB86659FD93) + hashes[at[used] + k])
    out[~long] = mix(out[~long] + room[~long].astype(np.uint64))
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[keep], np.searchsorted(doc[keep], np.arange(len(counts) + 1))


class Table:
    """An open hash table from 64-bit keys to row numbers, for whole arrays at a time; it grows as keys are added."""

    def __init__(self, bits: int = 12):
        self.bits, self.n = bits, 0
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        slot = self._slots(keys)
        out = self.rows[slot]
        wrong = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        last = (1 << self.bits) - 1
        while len(wrong):
            at = slot[wrong] = (slot[wrong] + 1) & last
            out[wrong] = self.rows[at]
            wrong = wrong[(self.keys[at] != keys[wrong]) & (out[wrong] >= 0)]
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Keys that are distinct and not there yet; their rows are numbered on if not given."""
        rows = np.arange(self.n, self.n + len(keys), dtype=np.int32) if rows is None else rows
        if (self.n + len(keys)) * 2 > len(self.keys):
            have = self.rows >= 0
            old_keys, old_rows = self.keys[have], self.rows[have]
            self.__init__(int(np.ceil(np.log2((self.n + len(keys)) * 4))))
            self.add(old_keys, old_rows)
        self.n += len(keys)
        slot, left = self._slots(keys), np.arange(len(keys))
        last = (1 << self.bits) - 1
        while len(left):
            free = left[self.rows[slot[left]] < 0]
            self.rows[slot[free]] = rows[free]  # of several for one slot, the last one written stays
            won = free[self.rows[slot[free]] == rows[free]]
            self.keys[slot[won]] = keys[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            left = left[lost[left]]
            slot[left] = (slot[left] + 1) & last
