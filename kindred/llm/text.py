"""Whole batches of texts as one byte array: words, word hashes and shingle hashes by numpy.

Texts of a batch are laid end to end with a space after each, so no word crosses texts.
Hashes are 64-bit and the same on every machine: a sum of random byte values times powers
of a base, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(BASE, -1, 1 << 64)
TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Also all ASCII characters but letters and digits.
MARKS = SPACE.copy()
MARKS[[i for i in range(128) if not chr(i).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = TABLE[LOWER]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1 << max(12, (n - 1).bit_length()), dtype=np.uint64)
        have[1] = U(base)
        k = 2
        while k < len(have):
            have[k : 2 * k] = have[:k] * U(pow(base, k, 1 << 64))
            k *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 512 << 10) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of a batch with about `most` bytes of text each, one text at least, and the texts as UTF-8 (null: None)."""
    texts = batch.column(column)
    size = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate([*size, most]):
        if i > start and (held + n > most or i == len(size)):
            yield batch.slice(start, i - start), texts.slice(start, i - start).cast(pa.large_binary()).to_pylist()
            start, held = i, 0
        held += n


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of texts: starts, ends (in `buf`), 64-bit hashes of their lower-cased (A-Z) bytes, and first[i]..first[i+1], the words of text i."""

    def __init__(self, texts: list[bytes | None], between: np.ndarray = SPACE):
        self.buf = np.frombuffer(b" ".join([b"", *(t or b"" for t in texts), b""]), dtype=np.uint8)
        size = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offset = np.concatenate([[1], 1 + np.cumsum(size)]).astype(np.int64)
        inside = ~between[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.offset)
        self.count = np.diff(self.first)
        scan = np.zeros(len(self.buf) + 1, dtype=np.uint64)
        np.cumsum(LOWER_TABLE[self.buf] * powers(_INV, len(self.buf)), out=scan[1:])
        self.scan = scan
        self.hash = mix((scan[self.end] - scan[self.start]) * powers(BASE, len(self.buf))[self.start])

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words have more than n bytes, and hashes of their first n, unlike those of words of n."""
        long = np.flatnonzero(self.end - self.start > n)
        at = self.start[long]
        return long, mix((self.scan[at + n] - self.scan[at]) * powers(BASE, len(self.buf))[at] + U(n * 0xD6E8FEB86659FD93 % (1 << 64)))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word shingles in order, and the bounds of each text's share. A text with fewer words has its whole sequence as one; without words none."""
        w, m = self.hash, len(self.hash)
        each = np.where(self.count >= n, self.count - n + 1, (self.count > 0).astype(np.int64))
        bound = np.concatenate([[0], np.cumsum(each)])
        if not m:
            return np.empty(0, np.uint64), bound
        full = np.zeros(m, dtype=np.uint64)
        for j in range(min(n, m)):
            full[: m - j] += w[j:] * U(pow(BASE, j + 1, 1 << 64))
        at = np.repeat(self.first[:-1], each) + (np.arange(bound[-1]) - np.repeat(bound[:-1], each))
        out = full[at]
        for i in np.flatnonzero((self.count > 0) & (self.count < n)):
            k = int(self.count[i])
            part = w[self.first[i] : self.first[i] + k]
            out[bound[i]] = U((int((part * powers(BASE, k + 1)[1:]).sum(dtype=np.uint64)) + k * 0xD6E8FEB86659FD93) % (1 << 64))
        return mix(out), bound


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one text."""
    return np.unique(Words([text]).shingles(n)[0])
