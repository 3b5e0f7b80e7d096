"""Words and shingles of many texts at once, as 64-bit hashes in numpy, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: An odd number that sets the places of words in a shingle apart.
BASE = 0x9E3779B97F4A7C15
#: Places of a word whose bytes have their numbers in a table.
PLACES = 32
#: Bytes that are hashed together; bounds the memory of the working arrays.
CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _numbers(places: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """A number for each byte at its place in a word, independent of those of other bytes and places."""
    return mix(mix((places.astype(np.uint64) << np.uint64(8)) | raw) + np.uint64(BASE))


_TABLE = _numbers(np.repeat(np.arange(PLACES), 256), np.tile(np.arange(256, dtype=np.uint8), PLACES))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of whole texts (first, last) of about `limit` bytes; a longer text is a range of its own."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, in order, and n + 1 offsets into them. A word never spans two texts.

    Words are runs of bytes other than space, tab and the four line breaks; A-Z become lower case. A hash is the sum of
    a word's numbers, one for each byte at its place, so words collide by chance alone (2**-64 a pair).
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if lower:
        raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    begins[edges] = inside[edges]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    size = np.flatnonzero(ends) + 1 - start
    letters, stop = raw[inside], np.cumsum(size)
    place = np.arange(len(letters)) - np.repeat(stop - size, size)
    values = _TABLE[(np.minimum(place, PLACES - 1) << 8) | letters]
    far = np.flatnonzero(place >= PLACES)
    values[far] = _numbers(place[far], letters[far])
    total = np.zeros(len(letters) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return mix(total[stop] - total[stop - size] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(start, offsets).astype(np.int64)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `width` words, in order, and offsets; a text with fewer words is one shingle, if any."""
    counts = np.diff(offsets)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_at = np.concatenate(([0], np.cumsum(made)))
    first = np.repeat(offsets[:-1] - out_at[:-1], made) + np.arange(out_at[-1])
    length = np.repeat(np.minimum(counts, width), made)
    out = np.zeros(len(first), dtype=np.uint64)
    for k in range(width):
        has = length > k
        if has.all():
            out = mix(out * np.uint64(BASE) + words[first + k])
        else:
            out[has] = mix(out[has] * np.uint64(BASE) + words[first[has] + k])
    return out, out_at


def distinct_in_groups(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each group, ascending, and their offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate(([0], np.cumsum(sizes)))


def exact_shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of runs of `width` words, in order, and offsets, as of :func:`shingle_hashes`, but without hashing.

    Two runs have one number only if their words are the same; the numbers hold within one call.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = split.flatten()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))))
    offsets = np.concatenate(([0], np.cumsum(full)))[ends]
    coded = words.dictionary_encode()
    ids, none = coded.indices.to_numpy()[full].astype(np.int64), len(coded.dictionary)
    counts = np.diff(offsets)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_at = np.concatenate(([0], np.cumsum(made)))
    first = np.repeat(offsets[:-1] - out_at[:-1], made) + np.arange(out_at[-1])
    length = np.repeat(np.minimum(counts, width), made)
    runs = ids[first]
    for k in range(1, width):
        following = np.where(length > k, ids[np.minimum(first + k, max(0, len(ids) - 1))], none)
        runs = np.unique(runs * (none + 1) + following, return_inverse=True)[1]
    return runs, out_at
