"""Quality by compression against two dictionaries.

One zstandard dictionary holds good, the other bad labelled texts of a bounded
sample, whole texts of at most DICTIONARY bytes together.  A text is compressed with each in fixed chunks, so that the dictionary
and not the text's own repeats decides; the difference of the two summed sizes
over their sum says which it resembles.  A second part of the sample turns that
number into a probability with an isotonic map.

Cases: null and empty texts have difference 0 and get a score like any other;
repeated rows get equal scores; an empty table gives an empty table; without
labelled rows of both classes all scores are the base rate (0.5 without any);
other columns of the input are not read.  Labels, lang, source and doc_id are
no inputs of a score.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import learn
from . import text as tx

FOLDS, FOLD = 5, 0
CUT = 0.3
LEVEL = 9
CHUNK = 512
#: Bytes of each dictionary at most.
DICTIONARY = 1 << 20


@functools.lru_cache(2)
def _packers(good: bytes, bad: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    out = []
    for data in (good, bad):
        if not data:
            out.append(zstandard.ZstdCompressor(level=LEVEL))
            continue
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
    return out[0], out[1]


def difference(col: pa.Array, good: bytes, bad: bytes) -> np.ndarray:
    """(size with bad - size with good) / (sum of both), one number per text."""
    g, b = _packers(good, bad)
    raw, off = tx.utf8(col)
    whole = raw.tobytes()
    out = np.zeros(len(off) - 1)
    for i in range(len(out)):
        if off[i + 1] > off[i]:
            part = whole[off[i] : off[i + 1]]
            chunks = [part[a : a + CHUNK] for a in range(0, len(part), CHUNK)]
            x, y = sum(len(g.compress(c)) for c in chunks), sum(len(b.compress(c)) for c in chunks)
            out[i] = (y - x) / (y + x)
    return out


class Model:
    def __init__(self, texts: list[bytes], y: np.ndarray, w: np.ndarray) -> None:
        part = np.zeros(len(y), int)
        for c in (0, 1):
            at = np.flatnonzero(y == c)
            part[at] = np.arange(len(at)) % 2
        take = lambda c: self._dictionary([t for t, p, v in zip(texts, part, y, strict=True) if p == 0 and v == c])
        self.good, self.bad = take(1), take(0)
        rest = learn.arrow_texts([t for t, p in zip(texts, part, strict=True) if p == 1])
        self.calibrated = learn.Isotonic(difference(rest, self.good, self.bad), y[part == 1], w[part == 1])

    @staticmethod
    def _dictionary(texts: list[bytes]) -> bytes:
        """Distinct whole texts in their order, each that still fits, up to DICTIONARY bytes."""
        out: list[bytes] = []
        left = DICTIONARY
        for t in dict.fromkeys(texts):
            if len(t) < left:
                out.append(t)
                left -= len(t) + 1
        return b"\n".join(out)

    def score(self, col: pa.Array) -> np.ndarray:
        return self.calibrated(difference(col, self.good, self.bad))


def fit(docs: DataFrame, labels: DataFrame, rows: int = learn.FIT_ROWS) -> Model:
    return Model(*learn.labelled_sample(docs, labels, "quality", FOLDS, FOLD, rows=rows))


def score_documents(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), cut: float = CUT) -> DataFrame:
    """keep columns, held_out, score and predicted of every row."""

    def run(col: pa.Array) -> dict:
        s = model.score(col)
        return {"score": s, "predicted": (s >= cut).astype(np.int32)}

    scored = tx.map_texts(docs, text, list(keep), "score double, predicted int", run)
    return scored.withColumn("held_out", learn.held_out("doc_id", FOLDS, FOLD)) if "doc_id" in keep else scored
