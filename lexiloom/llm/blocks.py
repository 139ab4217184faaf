"""Words and lines of many texts at once: numpy over the UTF-8 bytes of a block.

A batch of texts is walked in blocks of at most ``BLOCK_BYTES`` (one longer text
is a block of its own), so memory does not depend on the number of rows.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BLOCK_BYTES = 1 << 20
HASH_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
BATCH_SETTING, DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "67108864", "64m", "64MB")
BASE, SALT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def bounded_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of at most ``BATCH_BYTES``, unless the session has a setting of its own.

    The setting only shapes the transfer. With Spark's default a batch of long texts
    takes 64 MB several times over: in the JVM, on the way, and in each Python worker.
    """
    if spark.conf.get(BATCH_SETTING) in DEFAULT_BATCH:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


class Block(NamedTuple):
    """Rows ``first`` to ``first + rows`` of a batch; ``offsets`` has rows + 1 entries."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Word i is ``data[start[i]:end[i]]``; row r has the words ``bounds[r]:bounds[r + 1]``."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` in lower-cased UTF-8
ALPHANUMERIC = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: ``[^\x20\x09-\x0D]``
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins; a null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array, lower: bool = True, most: int = BLOCK_BYTES) -> Iterator[Block]:
    data, offsets = utf8(texts)
    first, n = 0, len(texts)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        own = data[offsets[first] : offsets[last]]
        yield Block(first, last - first, LOWER[own] if lower else own, offsets[first : last + 1] - offsets[first])
        first = last
    pa.default_memory_pool().release_unused()  # workers are kept for later tasks: what they do not need goes back


def words(block: Block, table: np.ndarray) -> Words:
    """Maximal runs of bytes of ``table``; a run never passes the end of a text."""
    inside = table[block.data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = block.offsets[(block.offsets > 0) & (block.offsets < len(inside))]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, block.offsets))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = _powers(base, max(n, HASH_BYTES))
    return _POWERS[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def runs_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``values[start:end]``; starts ascend, runs do not overlap."""
    out = np.empty(len(start), np.uint64)
    inverse = pow(BASE, -1, 1 << 64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + HASH_BYTES, side="right")))
        part = values[base : int(end[j - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(part)), out=sums[1:])
        a, b = start[i:j] - base, end[i:j] - base
        out[i:j] = mix((sums[b] - sums[a]) * powers(inverse, len(part) + 1)[a] + (b - a).astype(np.uint64) * np.uint64(SALT))
        i = j
    return out


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in each ``offsets[r]:offsets[r + 1]``."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, ...`` with ``count[i]`` values for each i, one after another."""
    total = int(count.sum())
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count) if len(count) else np.zeros(0, np.int64)
    return shift + np.arange(total)


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """One list for each count, filled from ``values`` in order."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)
