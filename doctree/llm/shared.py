"""Helpers that several operators share: cut-off tables, Arrow columns as byte buffers, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import let
from ..sources.scratch import Tables, cut, shared_dir  # noqa: F401

#: Bytes of text that one numpy step works on; one longer text is still taken whole.
BLOCK_BYTES = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_WORD_BASE = _U(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_POWERS: dict[int, np.ndarray] = {}


#: Bytes of an Arrow batch on its way to Python, unless the session says something else than Spark's own default.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are small: workers hold a batch, its parts and its results at once."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if df.sparkSession.conf.get(key) == default:
        df.sparkSession.conf.set(key, f"{BATCH_BYTES}b")
    return df


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def set_aside(df: DataFrame, *names: str):
    """df with columns of these names renamed, and a function that drops these names and undoes that."""
    moved = {c: fresh(df, "_" + c) for c in df.columns if c.lower() in {n.lower() for n in names}}
    return df.withColumnsRenamed(moved), lambda out: out.drop(*names).withColumnsRenamed({b: a for a, b in moved.items()}).select(*df.columns)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h = h * _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for later calls."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= BLOCK_BYTES * 8:
            _POWERS[int(base)] = have
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return _U(pow(int(base), -1, 1 << 64))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Polynomial hashes of values[start:end], each independent of where it stands."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(inverse(base), len(values) + 1)[starts])


def byte_table(inside) -> np.ndarray:
    """A table of 256 flags."""
    return np.array([bool(inside(i)) for i in range(256)])


#: ASCII upper case to lower case, all else as it is.
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
#: Bytes of words that end at white space.
NOT_SPACE = byte_table(lambda i: not (i == 32 or 9 <= i <= 13))
#: Bytes of words of letters and digits; every byte of a code point over 127 counts.
WORD = byte_table(lambda i: 48 <= i <= 57 or 97 <= i <= 122 or i >= 128)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(at, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def blocks(batches, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts Arrow batches into runs of rows with about `most` bytes of text: (rows, bytes, offsets)."""
    for batch in batches:
        data, at = buffers(batch.column(column))
        n, low = batch.num_rows, 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
            high = min(high, n)
            yield batch.slice(low, high - low), data[at[low] : at[high]], at[low : high + 1] - at[low]
            low = high


class Words:
    """The words of a run of texts: starts and ends in its bytes, hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, at: np.ndarray, inside: np.ndarray, lower: bool = True):
        data = LOWER[data] if lower else data
        flags = inside[data]
        first = np.zeros(len(data) + 1, bool)
        first[at] = True
        left = np.zeros(len(data), bool)
        left[1:] = flags[:-1]
        left[first[:-1]] = False
        right = np.zeros(len(data), bool)
        right[:-1] = flags[1:]
        right[first[1:]] = False
        self.data = data
        self.starts = np.flatnonzero(flags & ~left)
        self.ends = np.flatnonzero(flags & ~right) + 1
        self.first = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.first)
        self.hashes = range_hashes(_BYTE[data], self.starts, self.ends)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of each run of `size` words inside one text."""
        n = len(self.starts)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = np.repeat(self.first[1:], self.counts)
        begin = np.flatnonzero(np.arange(n) + size <= last)
        return begin, range_hashes(self.hashes, begin, begin + size, _WORD_BASE)

    def joined(self, low: int, high: int) -> bytes:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[low:high], self.ends[low:high]))


def char_offsets(data: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Code points before each byte position of one text."""
    counts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=counts[1:])
    return counts[positions]


def running(values: Column | str, join) -> Column:
    """The running sums, maxima or the like of an array of integers: by steps of 1, 2, 4 .. elements, so its time hardly exceeds its length's."""
    values = F.col(values) if isinstance(values, str) else values
    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int")
    steps = F.transform(F.sequence(F.lit(0), rounds - 1), lambda r: F.pow(F.lit(2.0), r).cast("int"))
    double = lambda acc, step: F.transform(acc, lambda x, i: F.when(i >= step, join(x, F.get(acc, i - step))).otherwise(x))
    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(steps, values, double))


#: Code points of a part that `pieces_of` takes pieces from.
_PART = 4096


def pieces_of(text: Column, starts: Column, ends: Column, between: Column | None = None) -> Column:
    """text[start:end] of spans in order, in code points, joined, with between[i] after the i-th.

    A piece of a string is found from its beginning; so text is cut into parts first, and a text of many pieces takes
    time in proportion to its length.
    """
    between = F.array().cast("array<string>") if between is None else between
    spans = F.arrays_zip(starts.alias("start"), ends.alias("end"), between.alias("after"))

    def joined(parts):
        def piece(p):
            low, high, after = p["start"], p["end"], F.coalesce(p["after"], F.lit(""))
            first = F.floor(low / _PART).cast("int")
            count = F.floor((high - 1) / _PART).cast("int") - first + 1
            begin = lambda k: F.greatest(low - (first + k) * _PART, F.lit(0))
            own = F.transform(F.slice(parts, first + 1, F.greatest(count, F.lit(0))), lambda part, k: F.substring(part, begin(k) + 1, F.least(high - (first + k) * _PART, F.lit(_PART)) - begin(k)))
            return F.when(high > low, F.concat(F.array_join(own, ""), after)).otherwise(after)

        return F.array_join(F.transform(spans, piece), "")

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{{_PART}}}|.+"), F.lit(0)), joined)
