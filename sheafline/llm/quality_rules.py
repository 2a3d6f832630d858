"""Quality rules by compression bands.

Base counts come first (words, symbols, repeated lines and 8-word windows).
Then zstandard ratios, taken over the whole document and over fixed chunks of
it, must lie in a band that depends on the length: text that compresses far
better than prose of its length is repetitive, text that hardly compresses is
noise.  Short texts hold too little context for a ratio, so bands widen as
texts get shorter; below `LENGTH_BANDS[0]` bytes the frame of the packed text
outweighs its content and only the base counts decide.  Every byte is judged:
the last chunk, which may be short, has the limits of its own length, and chunks
count by their bytes.

Cases: null text counts as empty (no words, base_failed); repeated rows are
judged row by row; an empty table gives an empty table; other columns of the
input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import text as tx

LEVEL = 3
CHUNK = 4096
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Limits by length: from so many bytes on, the compressed share of a whole text or of a last, short chunk must lie in [low, high].
LENGTH_BANDS = (64, 128, 256, 512, 1024, 2048, 4096, 16384)
LOW = (0.45, 0.38, 0.32, 0.32, 0.30, 0.30, 0.28, 0.25)
HIGH = (1.15, 0.95, 0.82, 0.76, 0.72, 0.70, 0.70, 0.66)
#: Limits of a full chunk of CHUNK bytes; a document goes if more than CHUNK_SHARE of its bytes lie in chunks outside on one side.
CHUNK_LOW, CHUNK_HIGH, CHUNK_SHARE = 0.26, 0.70, 0.34

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_bytes long, whole_ratio double, n_chunks long, n_low_bytes long, n_high_bytes long, reason string"
)
_SYMBOLS = b"#*$%&|<>"


def repeated_words(w: tx.Words) -> np.ndarray:
    """Per document: words that lie in a window of WINDOW words found twice or more in its text."""
    n_docs, total = len(w.first) - 1, len(w.starts)
    out = np.zeros(n_docs, np.int64)
    if total < WINDOW:
        return out
    h = w.hashes()
    doc = w.doc_of()
    n = total - WINDOW + 1
    roll = tx.mix64(doc[:n].astype(np.uint64))
    for k in range(WINDOW):
        roll = tx.combine64(roll, h[k : k + n])
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    if not len(inside):
        return out
    roll = roll[inside]
    order = np.argsort(roll)
    same = roll[order[1:]] == roll[order[:-1]]
    twice = np.zeros(len(inside), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(total + 1, np.int64)
    at = inside[twice]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return tx.run_sums(np.cumsum(edge[:-1]) > 0, w.first)


def base_counts(col: pa.Array) -> dict[str, np.ndarray]:
    """The five base counts of every text of an Arrow column."""
    raw, off = tx.utf8(col)
    buf = tx.padded(raw)
    w = tx.words(buf, off)
    body = buf[: len(raw)]
    points = ((body & 0xC0) != 0x80) & ~tx._WS[body]
    symbol = np.zeros(256, bool)
    symbol[list(_SYMBOLS)] = True
    whole = raw.tobytes()
    dup = np.zeros(len(off) - 1, np.int64)
    for i in range(len(off) - 1):
        lines = [x for x in whole[off[i] : off[i + 1]].split(b"\n") if x and x.strip()]
        dup[i] = len(lines) - len(set(lines))
    return {
        "n_words": np.diff(w.first).astype(np.int64),
        "word_chars": tx.run_sums(points, off),
        "n_symbols": tx.run_sums(symbol[body], off),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(w),
    }


def limits(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest compressed share of texts of these sizes."""
    band = np.searchsorted(LENGTH_BANDS, size, "right")
    return np.array((0.0, *LOW))[band], np.array((np.inf, *HIGH))[band]


def judge(col: pa.Array, packer: zstandard.ZstdCompressor | None = None) -> dict[str, np.ndarray | pa.Array]:
    packer = packer or zstandard.ZstdCompressor(level=LEVEL)
    out = base_counts(col)
    raw, off = tx.utf8(col)
    whole, n = raw.tobytes(), len(off) - 1
    size = np.diff(off)
    base = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    ratio, low, high = np.ones(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    lows, highs = limits(size)
    for i in range(n):
        if not size[i]:
            continue
        part = whole[off[i] : off[i + 1]]
        ratio[i] = len(packer.compress(part)) / len(part)
        for a in range(0, len(part), CHUNK):
            chunk = part[a : a + CHUNK]
            if len(chunk) == CHUNK:
                least, most = CHUNK_LOW, CHUNK_HIGH
            else:
                least, most = (float(v[0]) for v in limits(np.array([len(chunk)])))
            r = ratio[i] if len(chunk) == len(part) else len(packer.compress(chunk)) / len(chunk)
            low[i] += len(chunk) * (r < least)
            high[i] += len(chunk) * (r > most)
    reasons = [
        ("base", base),
        ("repetitive", ratio < lows),
        ("incompressible", ratio > highs),
        ("repetitive_chunks", low > CHUNK_SHARE * size),
        ("incompressible_chunks", high > CHUNK_SHARE * size),
    ]
    why = np.full(n, None, object)
    for name, hit in reversed(reasons):
        why[hit] = name
    return out | {
        "base_failed": base,
        "kept": np.array([x is None for x in why], bool),
        "n_bytes": size,
        "whole_ratio": ratio,
        "n_chunks": -(-size // CHUNK),
        "n_low_bytes": low,
        "n_high_bytes": high,
        "reason": pa.array(why, pa.string()),
    }


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per document with its counts, ratios, verdict and the first reason against it (null: kept)."""
    return tx.map_texts(docs, text, list(keep), FIELDS, judge)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = tx.utf8(batch.column(at))
            for a, b in tx.slices(off):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(judge(part.column(at))["kept"]))
            tx.give_back()

    return docs.mapInArrow(run, docs.schema)
