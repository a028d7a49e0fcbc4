"""Words, word hashes and word windows of whole texts, on Arrow buffers with numpy.

Hashes only bring together what may be equal: wherever equality decides a
result, the words' bytes are compared, and windows by the words' numbers.

Every function here works on one piece of a batch at a time, so a very long
text costs its word list (some 24 bytes a word), never a table per byte.
Separators are ASCII bytes, which no multi-byte UTF-8 character contains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 20  # bytes hashed at once
ROWS_BYTES = 1 << 22  # bytes of texts that are handled together


def _separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


BLANKS = _separators((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = _separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z folded."""
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on every bit of x."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_STEP = U64(0xA0761D6478BD642F)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 256  # bytes from which a word is hashed and compared by itself, as a loop over its eighths would be slower


class Bytes:
    """Bytes that can be read eight at a time from any place."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eights = np.ndarray((len(data) + 1,), "<u8", self.data, strides=(1,))

    def one(self, start: int, end: int) -> bytes:
        return self.data[start:end].tobytes()


def _hash_spans(text: Bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span. Every eight bytes are mixed with all before them, so no structure of words makes them meet."""
    length = ends - starts
    out = mix(length.astype(np.uint64) * _STEP + U64(1))
    long, k = np.flatnonzero(length > _LONG), 0
    alive = np.flatnonzero(length <= _LONG)
    while len(alive):
        left = length[alive] - k
        block = text.eights[starts[alive] + k] & _MASKS[np.minimum(left, 8)]
        out[alive] = mix((out[alive] ^ block) * U64(0x9E3779B97F4A7C15) + U64(k + 1))
        alive = alive[left > 8]
        k += 8
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(text.data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def equal(x: Bytes, x_start: np.ndarray, x_end: np.ndarray, y: Bytes, y_start: np.ndarray, y_end: np.ndarray) -> np.ndarray:
    """Which spans of x have the bytes of their spans of y."""
    length = x_end - x_start
    out = length == y_end - y_start
    alive, k = np.flatnonzero(out & (length <= _LONG)), 0
    for i in np.flatnonzero(out & (length > _LONG)).tolist():
        out[i] = x.one(x_start[i], x_end[i]) == y.one(y_start[i], y_end[i])
    while len(alive):
        left = length[alive] - k
        same = ((x.eights[x_start[alive] + k] ^ y.eights[y_start[alive] + k]) & _MASKS[np.clip(left, 0, 8)]) == 0
        out[alive[~same]] = False
        alive = alive[same & (left > 8)]
        k += 8
    return out


def numbered(keys: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal things, and one thing of each number. Things of one key are compared, so keys may collide."""
    numbers, firsts, todo, n = np.empty(len(keys), np.int64), [np.zeros(0, np.int64)], np.argsort(keys), 0
    while len(todo):
        ordered = keys[todo]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        group, first = np.cumsum(new) - 1, todo[new]
        fits = same(todo, first[group])
        numbers[todo[fits]] = n + group[fits]
        firsts.append(first)
        n += len(first)
        todo = todo[~fits]
    return numbers, np.concatenate(firsts)


@dataclass
class Words:
    """One entry a word: row (in the chunk), hash, byte offsets in the chunk, and code points where they were asked for."""

    row: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    chars: np.ndarray


def text_chunks(column: pa.Array, most: int = ROWS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) with at most `most` bytes, or one row. Null texts are empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if column.null_count:
        return (yield from text_chunks(column.fill_null(""), most))
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def _cuts(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces that end at a separator or with a row."""
    low, n = 0, len(data)
    while low < n:
        high = min(low + PIECE, n)
        if high < n:
            row = int(offsets[np.searchsorted(offsets, high, "right") - 1])
            back = np.flatnonzero(separators[data[max(low, high - 65536) : high]])
            best = max(row, max(low, high - 65536) + int(back[-1]) + 1 if len(back) else low)
            while best <= low:  # a word longer than a piece
                after = np.flatnonzero(separators[data[high : high + PIECE]])
                row = int(offsets[np.searchsorted(offsets, high)])
                best = min(row, high + int(after[0]) + 1 if len(after) else n)
                if best > high + PIECE and not len(after):
                    high, best = high + PIECE, low
            high = best
        yield low, high
        low = high


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool, chars: bool = False) -> Words:
    """The maximal runs of other bytes than separators in each row, hashed after lower-casing A-Z if asked."""
    parts: list[tuple[np.ndarray, ...]] = []
    for low, high in _cuts(data, offsets, separators):
        piece = data[low:high]
        folded = _LOWER[piece] if lower else piece
        inside = ~separators[folded]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = offsets[(offsets > low) & (offsets < high)] - low
        begins[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        points = np.zeros(len(piece) + 1 if chars else 0, np.int32)
        if chars:
            np.cumsum((piece & 0xC0) != 0x80, out=points[1:])
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets - low)))
        parts.append((row, _hash_spans(Bytes(folded), start, end), start + low, end + low, points[end] - points[start] if chars else points))
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(none, none.astype(np.uint64), none, none, none)
    return Words(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def identify(text: Bytes, found: Words) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words only, and a place of each number."""
    return numbered(found.hash, lambda a, b: equal(text, found.start[a], found.end[a], text, found.start[b], found.end[b]))


def identify_windows(ids: np.ndarray, keys: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """A number for each window of n numbered words (all, or those that begin at `at`), equal for equal ones only; keys are their hashes."""
    at = np.arange(len(keys)) if at is None else at

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for k in range(n):
            out &= ids[at[a] + k] == ids[at[b] + k]
        return out

    return numbered(keys, same)[0]


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive entries; rows aren't looked at."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total, size = hashes.copy(), 1
    for bit in f"{n:b}"[1:]:  # of two neighbours of a size one of twice the size, then one entry more where n has it
        total, size = total[:-size] * U64(pow(int(_STEP), size, 1 << 64)) + total[size:], 2 * size
        if bit == "1":
            total, size = total[:-1] * _STEP + hashes[size:], size + 1
    return mix(total + U64(n))


def least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive entries."""
    size = 1
    while size < n:
        step = min(size, n - size)
        values, size = np.minimum(values[:-step], values[step:]), size + step
    return values


def by_row(row: np.ndarray, n_rows: int) -> np.ndarray:
    """Where each row's entries begin in a column that is sorted by row; n_rows + 1 entries."""
    return np.searchsorted(row, np.arange(n_rows + 1))


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0
