"""Vectorised text kernels over Arrow string buffers.

All functions work on the UTF-8 bytes of many rows at once.  A byte class table decides which
bytes belong to a word, which is enough for the patterns used here: every non-ASCII character is
a word character in each of them, so characters never need decoding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes of [^\x20\x09-\x0D]+
SOLID = bytes(0 if b == 32 or 9 <= b <= 13 else 1 for b in range(256))
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = bytes(1 if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256))
#: Bytes of a line
NOT_NEWLINE = bytes(0 if b == 10 else 1 for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def in_batches(docs: DataFrame, megabytes: int = 1) -> DataFrame:
    """``docs``, with the Arrow batches of its session held to so many bytes: what a task has in
    memory then follows the size of a batch or of a single text, not of 10,000 rows.  Arrow's pool in the
    JVM reuses buffers of a few MB; larger ones come and go outside of it and leave holes, which the
    executor is charged for.  The session keeps the limit, as plans run after this returns."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")
    return docs


def pieces_of(docs: DataFrame, piece_bytes: int) -> int:
    """Pieces of about ``piece_bytes`` that the planner's size of ``docs`` (of its files, where nothing
    better is known) makes, one for each shuffle partition at least."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // piece_bytes), 1 << 20))


def lean(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` for mapInArrow, giving freed memory back to the system after each batch: Python
    workers live on after a task, and an allocator that keeps what they once held is charged to the
    executor for as long."""

    def run(batches: Iterator) -> Iterator:
        import ctypes

        trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)
        for out in task(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()
            trim(0)
        pa.default_memory_pool().release_unused()
        trim(0)

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * MIX2
    h ^= h >> np.uint64(29)
    h *= MIX1
    h ^= h >> np.uint64(32)
    return h


class Texts:
    """The bytes of consecutive rows: row i is data[offsets[i]:offsets[i + 1]]; null is empty."""

    def __init__(self, data: bytes | pa.Buffer, offsets: np.ndarray):
        self._data, self.offsets, self.rows = data, offsets, len(offsets) - 1

    @property
    def raw(self) -> bytes:
        """All bytes; a column's buffer is only copied when they are asked for as a whole."""
        if isinstance(self._data, pa.Buffer):
            self._data = self._data.to_pybytes()
        return self._data

    def part(self, a: int, b: int) -> Texts:
        """Rows a to b."""
        off = self.offsets[a : b + 1]
        x, y = int(off[0]), int(off[-1])
        data = self._data.slice(x, y - x).to_pybytes() if isinstance(self._data, pa.Buffer) else self._data[x:y]
        return Texts(data, off - x)

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        if column.null_count:
            column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, off, data = column.buffers()
        if not len(column) or off is None:
            return cls(b"", np.zeros(len(column) + 1, np.int64))
        offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])) if data is not None and offsets[-1] > offsets[0] else b""
        return cls(raw, offsets - offsets[0])

    def chunks(self, limit: int = 2_000_000, rows: int = 1 << 16) -> Iterator[tuple[int, Texts]]:
        """(first row, rows) in blocks of about ``limit`` bytes and at most ``rows`` rows; a longer
        row is a block of its own."""
        a = 0
        while a < self.rows:
            b = min(a + rows, max(a + 1, int(np.searchsorted(self.offsets, self.offsets[a] + limit, "right")) - 1))
            yield a, self.part(a, b)
            a = b

    def lower(self) -> Texts:
        return Texts(self.raw.translate(LOWER), self.offsets)

    def spans(self, cls: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of class bytes within each row, and for each row the
        index of its first run (rows + 1 values)."""
        m = np.frombuffer(self.raw.translate(cls), np.uint8)
        n = len(m)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(self.rows + 1, np.int64)
        edge = np.zeros(n + 1, np.uint8)
        edge[1:n] = m[1:] ^ m[:-1]
        edge[0], edge[n] = m[0], m[-1]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        joined = np.unique(cut[(m[cut] & m[cut - 1]) == 1])  # runs that touch over a row's end
        at = np.flatnonzero(edge)
        if len(joined):
            at = np.sort(np.concatenate([at, joined, joined]))
        s, e = at[0::2], at[1::2]
        return s, e, np.searchsorted(s, self.offsets).astype(np.int64)

    def hashes(self, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
        """64-bit hashes of byte spans; spans of up to 8 bytes never collide with one another
        when they have one length."""
        buf = self.raw + bytes(8)
        view = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
        n = e - s
        h = _load(view, s, n) + n.astype(np.uint64) * MIX1 + np.uint64(seed)
        h = mix(h)
        at = np.flatnonzero(n > 8)
        k = 8
        while len(at):
            h[at] = mix(h[at] * MIX1 + _load(view, s[at] + k, n[at] - k))
            k += 8
            at = at[n[at] > k]
        return h


_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def _load(view: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    return view[s] & _MASKS[np.minimum(n, 8)]


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values of h (len(h) - k + 1 of them)."""
    if len(h) < k:
        return h[:0]
    m = len(h) - k + 1
    out = h[:m].copy()
    for i in range(1, k):
        out = mix(out * MIX1 + h[i : i + m])
    return out


def list_column(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array with values[first[i]:first[i + 1]] in row i."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def blob_column(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary array with the bytes of values[first[i]:first[i + 1]] in row i."""
    off = (np.asarray(first, np.int64) * values.dtype.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
