"""Words, word hashes and shingles of whole texts, vectorised over the bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15
#: Bytes of whole texts that are taken together; arrays over them take some 40 times that.
TOGETHER = 2 << 20
#: Words of more bytes are hashed and compared one by one.
LONG = 64
#: KEEP[n]: the low n bytes of a number.
KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes: all but white space; letters, digits and non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def batches(column: pa.Array, most: int = TOGETHER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about `most` bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, places, data = column.buffers()
    ends = np.frombuffer(places, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, side="right")) - 1)
        last = min(last, n)
        yield first, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def word_bounds(data: np.ndarray, ends: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; none spans two texts. data: lower-cased already where that matters."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.take(word, data, out=inside[1:-1])
    edge = ends[(ends > 0) & (ends < len(data))]
    begins = inside[1:-1] & ~inside[:-2]
    begins[edge] = inside[1:-1][edge]
    stops = inside[1:-1] & ~inside[2:]
    stops[edge - 1] = inside[1:-1][edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; bytes after the end are zero."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word: eight at a time through a chain of bijections, long words by xxh3."""
    n = stops - starts
    out = mix(n.astype(U) * U(STEP))
    lanes = _lanes(data)
    live = np.flatnonzero(n <= LONG)
    for at in range(0, LONG, 8):
        live = live[n[live] > at]
        if not len(live):
            break
        left = np.minimum(n[live] - at, 8)
        out[live] = mix((out[live] ^ (lanes[starts[live] + at] & KEEP[left])) * U(STEP) + U(at + 1))
    for i in np.flatnonzero(n > LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : stops[i]].tobytes())
    return out


def word_classes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each class of equal words, and the class of each word. Hashes order the words, bytes decide."""
    _, first, which = np.unique(word_hashes(data, starts, stops), return_index=True, return_inverse=True)
    n, lanes, model = stops - starts, _lanes(data), first[which]
    same = n == n[model]
    live = np.flatnonzero(same & (model != np.arange(len(n))))
    for at in range(0, LONG, 8):
        live = live[n[live] > at]
        if not len(live):
            break
        keep = KEEP[np.minimum(n[live] - at, 8)]
        same[live] &= lanes[starts[live] + at] & keep == lanes[starts[model[live]] + at] & keep
    for i in live[n[live] > LONG] if len(live) else ():
        j = model[i]
        same[i] = np.array_equal(data[starts[i] : stops[i]], data[starts[j] : stops[j]])
    if not same.all():  # different words with one hash: each gets a class of its own
        known: dict[bytes, int] = {}
        extra = []
        for i in np.flatnonzero(~same).tolist():
            word = data[starts[i] : stops[i]].tobytes()
            if word not in known:
                known[word] = len(first) + len(extra)
                extra.append(i)
            which[i] = known[word]
        first = np.concatenate([first, extra]).astype(first.dtype)
    return first, which


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive word hashes."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    total = np.full(m, U(k * 0xD6E8FEB86659FD93 & MASK))
    factor = 1
    for i in range(k):
        factor = factor * 0xC2B2AE3D27D4EB4F & MASK
        total += hashes[i : i + m] * U(factor)
    return mix(total)


def texts_bounds(column: pa.Array, word: np.ndarray = NOT_SPACE, lower: bool = True, most: int | None = TOGETHER) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts, stops, index of each row's first word and the end) for runs of rows, or all of them."""
    for first, data, ends in batches(column, 1 << 62 if most is None else most):
        data = LOWER[data] if lower else data
        starts, stops = word_bounds(data, ends, word)
        yield first, data, starts, stops, np.searchsorted(starts, ends)


def texts_words(column: pa.Array, word: np.ndarray = NOT_SPACE, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts, stops, word hashes, index of each row's first word and the end) for runs of rows."""
    for first, data, starts, stops, rows in texts_bounds(column, word, lower):
        yield first, data, starts, stops, word_hashes(data, starts, stops), rows


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """The distinct k-word shingles of one text, sorted: its whole word sequence if that is shorter, none without words."""
    if 0 < len(hashes) < k:
        k = len(hashes)
    return np.unique(runs(hashes, k)) if len(hashes) else np.zeros(0, U)
