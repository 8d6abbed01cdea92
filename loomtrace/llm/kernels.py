"""Vectorised byte and word kernels that run inside Arrow batches of Spark tasks.

Texts of a batch are one contiguous byte buffer with offsets, so that splitting into words, hashing
words and hashing n-grams are a handful of numpy passes over the buffer, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the polynomial hashes, its inverse modulo 2**64, and the seed of the byte table.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0..BASE**(n-1) modulo 2**64, or the powers of its inverse."""
    key = "inverse" if inverse else "base"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), INVERSE if inverse else BASE, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 1 << 23:
            _POWERS[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def class_of(pattern_excludes: list[tuple[int, int]]) -> np.ndarray:
    """Byte table that is True for the bytes of words; the ranges given separate words."""
    table = np.ones(256, bool)
    for low, high in pattern_excludes:
        table[low : high + 1] = False
    return table


#: Byte ranges that separate words under the two word patterns in use.
SPACE_SEPARATED = class_of([(0x20, 0x20), (0x09, 0x0D)])
ALPHANUMERIC = class_of([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, and its n+1 offsets; null is the empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most ``size`` text bytes, or one row: bounds what a kernel allocates."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        lengths = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            base = total[start] - lengths[start]
            stop = max(start + 1, int(np.searchsorted(total, base + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of all words; words never cross rows."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = edges[edges > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with ``(h[e] - h[s]) * BASE**-s`` the polynomial hash of data[s:e]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans have equal hashes wherever they stand."""
    raw = (prefix[ends] - prefix[starts]) * powers(len(prefix), inverse=True)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    return span_hash(prefix_hash(LOWER[data] if lower else data), starts, ends)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes (those that cross rows are the caller's to drop)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    total = np.full(m, n, np.uint64)
    for j in range(n):
        total += hashes[j : j + m] * np.uint64(pow(BASE, 2 * j + 1, 1 << 64))
    return mix(total)


def run_starts(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each row's run in a sorted row-number column, for rows 0..n-1."""
    at = np.searchsorted(rows, np.arange(n + 1))
    return at[:-1], np.diff(at)


def shard_of(hashes: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Number of the range, of ``shards`` equal ones, that each hash of so many bits lies in."""
    top = hashes >> np.uint64(bits - 32) if bits > 32 else hashes << np.uint64(32 - bits)
    return ((top * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def squeeze(ascending: np.ndarray) -> tuple[bytes, int]:
    """Ascending hashes as differences of the fewest bytes that hold the largest."""
    steps = np.diff(ascending, prepend=np.uint64(0))
    steps[0] = 0
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    packed = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
    return int(ascending[0]).to_bytes(8, "little") + packed, width


def unsqueeze(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    steps = wide.view("<u8").ravel()
    steps[0] = int.from_bytes(data[:8], "little")
    return np.cumsum(steps, dtype=np.uint64)


def map_arrow(df, function, schema: pa.Schema):
    """``df.mapInArrow`` with the result's type given as an Arrow schema."""
    from pyspark.sql.pandas.types import from_arrow_schema

    return df.mapInArrow(function, from_arrow_schema(schema))
