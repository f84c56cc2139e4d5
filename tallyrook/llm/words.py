"""Words of whole Arrow string columns as 64-bit hashes, without a Python loop over words.

Both word patterns of the library break at ASCII bytes only, so they can be applied to UTF-8 bytes. A word has two hashes that
depend on its bytes alone, so equal words have equal hashes in every task. Up to SHORT bytes they are the halves of a
128-bit number, the bytes and their count, after rounds of mixing and with that number added, so that they can't be turned
round; beyond, the halves of a 128-bit digest. Both are 128 bits of which no part is a sum over bytes: words that share them are not to be found.
Hashes of runs of words are folded, not added up, for the same reason.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)
#: Bytes of a slice; bytes of a word that are mixed and not digested.
SLICE, SHORT = 1 << 18, 15
_ROUNDS = np.arange(1, 5, dtype=np.uint64) * _STEP
#: Of 0 to SHORT bytes, those that lie in the first and in the second eight of a word.
_FIRST = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(SHORT + 1)], np.uint64)
_SECOND = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(SHORT + 1)], np.uint64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _breaks(ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Bytes between words: of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (taken after lower-casing).
SPACE = _breaks([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = _breaks([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads differences over all 64 bits."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


@dataclass
class Words:
    """Words of a column: two hashes of each, its byte range in data, and first[i]:first[i + 1], those of row i."""

    hash: np.ndarray
    other: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def lower(self, i: int) -> bytes:
        return _LOWER[self.data[self.start[i] : self.end[i]]].tobytes()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that what is computed for each word of a batch stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def split(column: pa.Array | pa.ChunkedArray, between: np.ndarray, lower: bool) -> Words:
    """The words of every row of the column."""
    data, at = utf8(column)
    hashes, starts, ends = [], [], []
    begin, size = 0, len(data)
    while begin < size:
        stop = _cut(data, at, begin, between, lower)
        x = data[begin:stop]
        if lower:
            x = _LOWER[x]
        gap = between[x]
        heads = at[np.searchsorted(at, begin, "left") : np.searchsorted(at, stop, "left")] - begin
        before, after = np.empty_like(gap), np.empty_like(gap)
        before[0] = after[-1] = True
        before[1:], after[:-1] = gap[:-1], gap[1:]
        before[heads] = True
        after[heads[heads > 0] - 1] = True
        s, e = np.flatnonzero(before & ~gap), np.flatnonzero(after & ~gap) + 1
        hashes.append(_hashes(x, s, e))
        starts.append(s + begin)
        ends.append(e + begin)
        begin = stop
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    both = np.concatenate(hashes, axis=1) if hashes else np.zeros((2, 0), np.uint64)
    return Words(both[0], both[1], start, join(ends, np.int64), np.searchsorted(start, at, "left"), data)


def _hashes(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Both hashes of the words of the bytes x."""
    padded = np.zeros(len(x) + 16, np.uint8)
    padded[: len(x)] = x
    eight = np.ndarray((len(x) + 9,), "<u8", padded, strides=(1,))
    size = np.minimum(end - start, SHORT)
    a = eight[start] & _FIRST[size]
    b = (eight[start + 8] & _SECOND[size]) | (size.astype(np.uint64) << _U(56))
    first, second = a, b
    for key in _ROUNDS:
        a, b = b, a ^ mix(b + key)
    out = np.stack([a ^ first, b ^ second])
    long = np.flatnonzero(end - start > SHORT)
    if len(long):
        letters, known = x.tobytes(), {}
        for i, s, e in zip(long.tolist(), start[long].tolist(), end[long].tolist(), strict=True):
            word = letters[s:e]
            if word not in known:
                known[word] = np.frombuffer(hashlib.blake2b(word, digest_size=16).digest(), np.uint64)
            out[:, i] = known[word]
    return out


def _cut(data: np.ndarray, at: np.ndarray, begin: int, between: np.ndarray, lower: bool) -> int:
    """The end of the slice from begin: a row's end, else after a byte between words, else the word's own end."""
    if begin + SLICE >= len(data):
        return len(data)
    row = at[np.searchsorted(at, begin + SLICE, "right") - 1]
    if row > begin:
        return int(row)
    end, k = int(at[np.searchsorted(at, begin, "right")]), 1
    while begin + k * SLICE < end:
        x = data[begin + (k - 1) * SLICE : begin + k * SLICE]
        found = np.flatnonzero(between[_LOWER[x] if lower else x])
        if len(found):
            return begin + (k - 1) * SLICE + int(found[-1]) + 1
        k += 1
    return end


def without_impostors(words: Words, known: dict[int, bytes]) -> Words:
    """words, where the hash of each word that has a known one's hash, but other letters (lower-cased), is made 0."""
    keys = np.array(sorted(known), np.uint64)
    at = np.searchsorted(keys, words.hash)
    at[at == len(keys)] = 0
    same = np.flatnonzero(keys[at] == words.hash) if len(keys) else np.zeros(0, np.int64)
    if not len(same):
        return words
    spelled = [known[k] for k in keys.tolist()]
    width = max(map(len, spelled))
    letters = np.zeros((len(keys), width), np.uint8)
    for i, x in enumerate(spelled):
        letters[i, : len(x)] = np.frombuffer(x, np.uint8)
    size = np.array([len(x) for x in spelled])[at[same]]
    wrong = words.end[same] - words.start[same] != size
    for j in range(width):
        own = _LOWER[words.data[np.minimum(words.start[same] + j, len(words.data) - 1)]]
        wrong |= (j < size) & (own != letters[at[same], j])
    if wrong.any():
        words.hash[same[wrong]] = 0
    return words


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and of each whether it lies within one row."""
    rows = words.rows()
    n = max(len(rows) - k + 1, 0)
    return rolled(words.hash, k), rows[:n] == rows[k - 1 :] if n else np.zeros(0, bool)


def folded(x: np.ndarray, y: np.ndarray, step: np.uint64) -> np.ndarray:
    """A hash of each x followed by y. The inner mixing has both, so that it isn't a sum of what each gives."""
    return mix(mix(x * step + y) + x)


def rolled(hashes: np.ndarray, k: int, step: np.uint64 = _STEP) -> np.ndarray:
    """Hashes of all runs of k, folded from runs of powers of two; another step gives others."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    block, size, at, out = hashes, 1, 0, None
    while True:
        if k & size:
            piece = block[at : at + n]
            out = piece if out is None else folded(out, piece, step)
            at += size
        if 2 * size > k:
            return mix(out + _U(k))
        block, size = folded(block[:-size], block[size:], step), 2 * size


def sequence(hashes: np.ndarray) -> int:
    """The hash of one whole sequence, as windows() has it for its length."""
    return int(rolled(hashes, len(hashes))[0])
