"""Vectorised work on UTF-8 texts inside Arrow batches.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``.  Everything here works on
the raw UTF-8 buffer of an Arrow string column, so that no Python object is
made per word.  Slices of a batch are bounded in bytes, so memory per Python
worker follows the longest single text, never the batch.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_C1, _C2, _C3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _S33)
    x = x * _C1
    x ^= x >> _S33
    x *= _C2
    x ^= x >> _S33
    return x


def combine64(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of a hash and a further value."""
    return mix64(h * _C3 + x)


def hash_spans(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; buf must have 8 spare bytes at its end."""
    win = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    h = mix64(lens.astype(np.uint64) * _C3 + np.uint64(seed))
    at, left, idx = starts, lens, None
    while True:
        part = win[at] & _MASKS[np.minimum(left, 8)]
        if idx is None:
            h = mix64((h ^ part) * _C3)
        else:
            h[idx] = mix64((h[idx] ^ part) * _C3)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        idx = more if idx is None else idx[more]
        at, left = at[more] + 8, left[more] - 8


@dataclass
class Words:
    """Words of a run of documents: byte starts and lengths, and where each document's words begin."""

    buf: np.ndarray
    starts: np.ndarray
    lens: np.ndarray
    first: np.ndarray  # len(documents) + 1

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hash_spans(self.buf, self.starts, self.lens, seed)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each (one row at least)."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b
        a = b


def padded(raw: np.ndarray, lower: bool = False) -> np.ndarray:
    buf = np.zeros(len(raw) + 16, np.uint8)
    buf[: len(raw)] = LOWER[raw] if lower else raw
    return buf


def words(buf: np.ndarray, off: np.ndarray) -> Words:
    """Words of documents whose bytes are buf[off[i]:off[i + 1]]; off[0] is 0, buf is padded."""
    n = int(off[-1])
    text = ~_WS[buf[:n]]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    begin, end = text.copy(), text.copy()
    if n:
        begin[1:] &= ~text[:-1] | cut[1:n]
        end[:-1] &= ~text[1:] | cut[1:n]
    starts = np.flatnonzero(begin)
    lens = np.flatnonzero(end) + 1 - starts
    return Words(buf, starts, lens, np.searchsorted(starts, off))


def run_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]], empty runs included."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


@functools.cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system after a batch: Python workers live on, and what they hold idle counts against the executor."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def map_texts(df: DataFrame, text: str, keep: list[str], fields: str, fn: Callable[[pa.Array], dict], limit: int = SLICE_BYTES) -> DataFrame:
    """Columns `keep` and those that fn makes of slices of the text column; fields: their DDL."""
    keep_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            _, off = utf8(col)
            for a, b in slices(off, limit):
                made = fn(col.slice(a, b - a))
                arrays = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(v) if not isinstance(v, pa.Array) else v for v in made.values()], names=keep + list(made))
                del made, arrays
            give_back()

    return df.select(*keep, df[text].cast("string").alias("_text_")).mapInArrow(run, f"{keep_ddl}, {fields}" if keep_ddl else fields)
