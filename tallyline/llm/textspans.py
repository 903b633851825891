"""Vectorised views of Arrow text columns: bytes, words, lines, word hashes and shingles.

Everything here works on one Arrow batch inside a task. Words are maximal runs of bytes other than space and
0x09-0x0D, which is the pattern [^\\x20\\x09-\\x0D]+; bytes of multi-byte characters are never white space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Spans of more bytes are hashed one by one with BLAKE2b.
_LONG = 64
#: Mask of the lowest 0 to 8 bytes.
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], _U)
_WEIGHT = _U(0x9FB21C651E98DF25)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_chunks(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, byte offsets) with about `limit` bytes each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-document offsets of the maximal runs of True that stay within a document."""
    full = offs[:-1] < offs[1:]
    first, last = inside.copy(), inside.copy()
    if len(inside):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begin, end = offs[:-1][full], offs[1:][full] - 1
        first[begin] = inside[begin]
        last[end] = inside[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each document's offsets into them."""
    return runs(~SPACE[buf], offs)


def octets(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one little-endian integer; beyond the end they count as 0."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes on every machine. lower: A-Z count as a-z.

    Each step mixes eight bytes non-linearly, so spans of up to eight bytes and one length never collide, and no regular
    pattern makes longer ones collide.
    """
    buf = _LOWER[buf] if lower else buf
    eight, n = octets(buf), ends - starts
    h = mix64((eight[starts] & MASKS[np.minimum(n, 8)]) ^ (n.astype(_U) * _U(0xD6E8FEB86659FD93)))
    left = np.flatnonzero((n > 8) & (n <= _LONG))
    done = 8
    while len(left):
        part = eight[starts[left] + done] & MASKS[np.minimum(n[left] - done, 8)]
        h[left] = mix64(h[left] * _WEIGHT + part)
        done += 8
        left = left[n[left] > done]
    for i in np.flatnonzero(n > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].data, digest_size=8).digest(), "little")
    return h


def run_hashes(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run first..end of word hashes. Words are mixed with their place in the run before they are summed,
    so runs of one word each, or of words in a regular pattern, do not cancel out. Runs are disjoint and ascending."""
    n = end - first
    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    place = (at - np.repeat(first, n) + 1).astype(_U)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix64(h[at] + place * _U(0xD1342543DE82EF95)))])
    cuts = np.concatenate([[0], np.cumsum(n)])
    return mix64(sums[cuts[1:]] - sums[cuts[:-1]] + n.astype(_U) * _U(0xD6E8FEB86659FD93))


def windows(h: np.ndarray, word_offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of k words and the index of its first word; windows stay within a document."""
    n = len(h)
    if n < k:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    acc = h[: n - k + 1].copy()
    for j in range(1, k):
        acc = mix64(acc * _WEIGHT + h[j : n - k + 1 + j])
    end = np.repeat(word_offs[1:], np.diff(word_offs))[: n - k + 1]
    at = np.flatnonzero(np.arange(n - k + 1) + k <= end)
    return mix64(acc[at] + _U(k)), at


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per document; with fewer than k words the whole sequence is the one shingle."""
    s, e, wo = words(buf, offs)
    h = span_hashes(buf, s, e, lower)
    sh, at = windows(h, wo, k)
    cuts = np.searchsorted(at, wo)
    out = []
    for d in range(len(offs) - 1):
        n = wo[d + 1] - wo[d]
        if n >= k:
            out.append(np.unique(sh[cuts[d] : cuts[d + 1]]))
        elif n:
            out.append(run_hashes(h, wo[d : d + 1], wo[d + 1 : d + 2]))
        else:
            out.append(np.zeros(0, _U))
    return out


def word_counts(texts: pa.Array) -> np.ndarray:
    """Number of words in each text."""
    out = np.zeros(len(texts), np.int64)
    for lo, hi, buf, offs in text_chunks(texts):
        out[lo:hi] = np.diff(words(buf, offs)[2])
    return out
