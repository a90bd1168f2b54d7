"""Words of Arrow text columns as numpy arrays, and rolling hashes over them.

All functions work on one slice of a batch: the UTF-8 bytes of some rows and their offsets. A null text has no bytes.
Words are runs of bytes that a class table marks; the classes used are ASCII sets, so bytes of other characters are
told apart by their high bit and never split.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U = np.uint64

_MULTIPLIER = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def process_cache(name: str, large: bool = False) -> dict:
    """A dict that lives as long as the Python worker, shared by its tasks. Functions are sent by value, so their own
    module's variables start anew in every task.

    A ``large`` one replaces all others, and is given up when a task of another operator asks for its own.
    """
    home = vars(sys.modules.setdefault("_text_caches", types.ModuleType("_text_caches")))
    larger = home.setdefault("larger", {})
    for held in (larger, home) if large else (larger,):
        for other in [n for n, made in held.items() if isinstance(made, dict) and made is not larger and n != name]:
            held.pop(other).clear()
    return (larger if large else home).setdefault(name, {})


def in_small_batches(df):
    """Have this session send texts to Python in batches of at most 8 MB, so that a worker's arrays stay small."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


def byte_class(spans: list[tuple[int, int]], inverted: bool = False) -> np.ndarray:
    """Table of 256 flags, true for bytes inside the given inclusive spans."""
    table = np.zeros(256, bool)
    for a, b in spans:
        table[a : b + 1] = True
    return ~table if inverted else table


#: Words ``[^\\x20\\x09-\\x0D]+``.
NOT_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)], inverted=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def slices(column: pa.Array, most_bytes: int = SLICE_BYTES, most_rows: int | None = None):
    """``(first row, bytes, offsets)`` of consecutive row runs of about ``most_bytes``; a longer text is a run of its own.

    ``most_rows`` bounds a run of very short texts, for those who hold an array per row.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
        end = min(n, max(end, at + 1), at + (most_rows or n))
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
    del column, data
    pa.default_memory_pool().release_unused()


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE):
    """Byte starts and ends of all words, and for each row the index of its first word (one more entry than rows)."""
    flag = inside[data]
    before, after = np.zeros_like(flag), np.zeros_like(flag)
    before[1:], after[:-1] = flag[:-1], flag[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    starts = np.flatnonzero(flag & ~before)
    ends = np.flatnonzero(flag & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power(n: int, which: str) -> np.ndarray:
    """Powers 0..n-1 of the multiplier or of its inverse modulo 2^64."""
    powers = process_cache("powers")
    have = powers.get(which)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), _MULTIPLIER if which == "up" else _INVERSE, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 8 * SLICE_BYTES:  # longer ones serve one very long text only
            powers[which] = have
    return have


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser that spreads every input bit over the output."""
    h = h ^ U(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run ``values[start:end]``, whatever its place."""
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * _power(len(values) + 1, "up")[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * _power(len(values) + 1, "down")[starts]


_bytes = mix(np.arange(1, 257, dtype=U), 7)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """64-bit hash of each word after mapping its bytes through ``fold``."""
    return mix(_ranges(_bytes[fold][data], starts, ends), 1) if len(starts) else np.zeros(0, U)


def grams(hashes: np.ndarray, k: int, seed: int = 2) -> np.ndarray:
    """Hash of the ``k`` words from each word on; entry i is right only where i + k words exist."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U)
    at = np.arange(n - k + 1)
    return mix(_ranges(hashes, at, at + k), seed)


def sequence_hashes(hashes: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each row's whole word sequence; rows without words get the hash of nothing."""
    other = mix(hashes, seed)  # mixed anew, so that two seeds give independent hashes
    return mix(_ranges(other, first[:-1], first[1:]) + (first[1:] - first[:-1]).astype(U), seed)


def code_points(data: np.ndarray, offsets: np.ndarray):
    """Code points of the bytes, and each row's offsets counted in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return points, heads[offsets]


def arrow(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Arrow list column whose row i holds the next ``counts[i]`` values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


_GRAM = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def gram_ids(points: np.ndarray, offsets: np.ndarray, n: int, dim: int) -> np.ndarray:
    """Bucket below ``dim`` (a power of two) of the ``n``-gram from each code point on; ``dim`` where the row ends before."""
    out = np.full(len(points), dim, np.int32)
    m = len(points) - n + 1
    if m <= 0:
        return out
    h = np.full(m, np.uint32(n * 0x01000193 & 0xFFFFFFFF))
    for k in range(n):
        h += points[k : k + m]
        h *= _GRAM[k]
        h ^= h >> np.uint32(15)
    h *= _GRAM[3]
    out[:m] = h >> np.uint32(32 - dim.bit_length() + 1)
    ends = offsets[1:]
    for k in range(1, n):  # the last n - 1 places of every row
        late = ends - k
        out[late[(late >= offsets[:-1])]] = dim
    return out


def letters() -> np.ndarray:
    """For every code point its lower-case letter, or a space where it is no letter."""
    cache = process_cache("letters")
    if "table" not in cache:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        cache["table"] = table
    return cache["table"]


def character_classes() -> np.ndarray:
    """For every code point one of: a lower-case or other letter, a capital, a digit, else itself."""
    cache = process_cache("classes")
    if "table" not in cache:
        table = np.arange(0x110000, dtype=np.uint32)
        table[letters() != 32] = ord("a")
        for c in range(0x110000):
            if table[c] != ord("a") and chr(c).isdigit():
                table[c] = ord("0")
            elif table[c] == ord("a") and chr(c).isupper():
                table[c] = ord("A")
        cache["table"] = table
    return cache["table"]
