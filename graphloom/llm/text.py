"""Reading texts from Arrow batches in slices, so that a batch of long texts is never all Python objects at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession

BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
SLICE_BYTES = 4 << 20
SLICE_ROWS = 512
LONG = 256  # bytes of a word that is hashed by itself
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, their texts as UTF-8) of up to SLICE_ROWS rows or about SLICE_BYTES; null is empty."""
    at = batch.schema.get_field_index(column)
    col = batch.column(at)
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    elif pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    start, rows = 0, batch.num_rows
    while start < rows:
        stop, size = start, 0
        while stop < rows and stop - start < SLICE_ROWS and size < SLICE_BYTES:
            size += len(col[stop].as_buffer()) if col[stop].is_valid else 0
            stop += 1
        yield batch.slice(start, stop - start), [x or b"" for x in col.slice(start, stop - start).to_pylist()]
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words (runs of anything but ASCII white space, ASCII letters lower-cased) of some texts, with a 64-bit hash each.

    All are arrays, so no word becomes an object: start and end (bytes in `low`, the lower-cased texts, one line break
    after each), hash, of (place of the text). first, word: byte and word at which each text starts. Invalid UTF-8 is replaced.
    """

    def __init__(self, values: list[bytes]):
        joined = b"\n".join(values)
        try:
            joined.decode()
        except UnicodeDecodeError:
            values = [v.decode("utf-8", "replace").encode() for v in values]
            joined = b"\n".join(values)
        self.first = np.cumsum([0, *[len(v) + 1 for v in values]])  # of one more at the end
        raw = np.frombuffer(joined + b"\n" + bytes(8), np.uint8)
        self.low = raw + (((raw - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
        self.bytes = raw[:-8]
        space = np.r_[True, (self.bytes == 32) | ((self.bytes - np.uint8(9)) < 5)]
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.word = np.searchsorted(self.start, self.first)
        self.of = np.repeat(np.arange(len(values)), np.diff(self.word))
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        size = self.end - self.start
        eight = np.ndarray(len(self.bytes), "<u8", self.low.data, 0, (1,))

        def part(some, k: int) -> np.ndarray:
            """Up to 8 bytes of these words from the k-th."""
            left = np.minimum(size[some] - k, 8).astype(np.uint64)
            return eight[self.start[some] + k] & (FULL >> (np.uint64(64) - np.uint64(8) * left))

        h = mix(part(slice(None), 0) ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        some, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(some):
            h[some] = mix(h[some] * np.uint64(0xD6E8FEB86659FD93) + part(some, k))
            k += 8
            some = some[size[some] > k]
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = xxhash.xxh64_intdigest(self.low[self.start[i] : self.end[i]].tobytes())
        return h

    def points(self) -> np.ndarray:
        """Code points before each byte, and in all."""
        return np.cumsum(np.r_[False, (self.bytes & 0xC0) != 0x80], dtype=np.int32)


def records(names: list[str], arrays: list, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, type=t) for a, t in zip(arrays, types, strict=True)], names=names)


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to a few MB where they may be larger: whole texts travel in them."""
    for key, most in BATCH.items():
        now = str(spark.conf.get(key)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
