"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically.

One third of a bounded sample of labelled rows teaches a lexicon: words and word beginnings
that toxic rows hold far more often than others.  The features of a text are
the densities of lexicon words, of lexicon beginnings and of words that match
only after undoing obfuscation; how often such words stand near a second-person
word; rates of capitals, exclamation and other punctuation; the rate of
obfuscated spellings; and the length.  The second third grows the trees, the
last calibrates their margin.  Labels, lang, source and doc_id are no features.

Cases: null and empty texts have all-zero features and get a score like any
other; repeated rows get equal scores; an empty table gives an empty table;
without labelled rows of both classes every text scores the base rate (0.5
without any); other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import learn
from . import text as tx

FOLDS, FOLD = 3, 1
CUT = 0.7
NEAR = 5
N_FEATURES = 12
#: Lexicon entries: so many toxic rows and such a share of them hold an entry at least, and its share is so many times that among others.
MIN_ROWS, MIN_SHARE, MIN_LIFT, BEGINNINGS = 5, 0.02, 12.0, (4, 5, 6)
#: Second-person words of the four languages (fixed values).
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie tú ti usted ustedes vosotros tus su".split()

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PLAIN = tx.LOWER.copy()
_PLAIN[_PUNCT] = 32
_LEET = tx.LOWER.copy()
for _a, _b in zip("013457@$", "oieastas", strict=True):
    _LEET[ord(_a)] = ord(_b)
_DROP = np.zeros(256, bool)
_DROP[[ord(c) for c in "*.-_'|!?,;:\"()"]] = True


def _tables(raw: np.ndarray, off: np.ndarray) -> tuple[tx.Words, np.ndarray, list[np.ndarray], np.ndarray]:
    """Words without punctuation, their hashes, hashes of their beginnings, and hashes of words with obfuscation undone (by document, see first)."""
    w = tx.words(tx.padded(_PLAIN[raw]), off)
    starts = [np.where(w.lens >= k, tx.hash_spans(w.buf, w.starts, np.minimum(w.lens, k), 100 + k), np.uint64(0)) for k in BEGINNINGS]
    return w, w.hashes(), starts, w.first


def _undone(raw: np.ndarray, off: np.ndarray) -> tuple[tx.Words, np.ndarray]:
    keep = ~_DROP[raw]
    place = np.concatenate([[0], np.cumsum(keep)])
    w = tx.words(tx.padded(_LEET[raw[keep]]), place[off])
    return w, w.hashes()


_SECOND = None


def _second_person() -> np.ndarray:
    global _SECOND
    if _SECOND is None:
        raw, off = tx.utf8(pa.array(SECOND_PERSON))
        _SECOND = np.sort(tx.words(tx.padded(raw), off).hashes())
    return _SECOND


def _member(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    at = np.searchsorted(table, h)
    at[at == len(table)] = 0
    return table[at] == h


class Lexicon:
    """Sorted hashes of toxic words and beginnings."""

    def __init__(self, col: pa.Array, y: np.ndarray) -> None:
        n1, n0 = max(1, int(y.sum())), max(1, int((y == 0).sum()))
        kinds = 1 + len(BEGINNINGS)
        seen: list[list[np.ndarray]] = [[] for _ in range(kinds)]  # distinct tokens of each text, in text order
        mark: list[list[np.ndarray]] = [[] for _ in range(kinds)]  # and the label of their text
        _, off = tx.utf8(col)
        for a, b in tx.slices(off):
            w, h, starts, _ = _tables(*tx.utf8(col.slice(a, b - a)))
            doc = w.doc_of()
            for k, s in enumerate([h, *starts]):
                order = np.lexsort((s, doc))
                s, d = s[order], doc[order]
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
                seen[k].append(s[new])
                mark[k].append(y[a:b][d[new]])
        picked = [self._pick(np.concatenate(s or [np.zeros(0, np.uint64)]), np.concatenate(m or [np.zeros(0, int)]), n1, n0) for s, m in zip(seen, mark, strict=True)]
        self.words, self.starts = picked[0], picked[1:]

    @staticmethod
    def _pick(tokens: np.ndarray, toxic: np.ndarray, n1: int, n0: int) -> np.ndarray:
        token, at = np.unique(tokens, return_inverse=True)
        one, both = np.bincount(at, toxic, len(token)), np.bincount(at, minlength=len(token))
        lift = (one / n1) / ((both - one + 0.5) / n0)
        return token[(one >= max(MIN_ROWS, MIN_SHARE * n1)) & (lift >= MIN_LIFT) & (token != 0)]


def features(col: pa.Array, lex: Lexicon) -> np.ndarray:
    """Dense features, one row per text."""
    _, off = tx.utf8(col)
    return np.concatenate([_features(col.slice(a, b - a), lex) for a, b in tx.slices(off)] or [np.zeros((0, N_FEATURES))])


def _features(col: pa.Array, lex: Lexicon) -> np.ndarray:
    raw, off = tx.utf8(col)
    w, h, starts, first = _tables(raw, off)
    n = np.maximum(np.diff(first), 1)
    size = np.maximum(np.diff(off), 1)
    hit = _member(h, lex.words)
    begun = np.zeros(len(h), bool)
    for s, table in zip(starts, lex.starts, strict=True):
        begun |= _member(s, table)
    any_hit = hit | begun
    u, uh = _undone(raw, off)
    hidden = tx.run_sums(_member(uh, lex.words), u.first) - tx.run_sums(hit, first)
    second = _member(h, _second_person())
    doc = w.doc_of()
    near = np.zeros(len(h), bool)
    for k in range(1, NEAR + 1):
        if len(h) > k:
            same = doc[k:] == doc[:-k]
            near[k:] |= second[:-k] & same
            near[:-k] |= second[k:] & same
    body = raw
    upper, lower = (body >= 65) & (body <= 90), (body >= 97) & (body <= 122)
    digit, punct = (body >= 48) & (body <= 57), _PUNCT[body]
    letter = upper | lower | (body >= 128)
    mixed = np.zeros(len(body), bool)
    if len(body) > 2:
        mixed[1:-1] = (digit | np.isin(body, [42, 64, 36]))[1:-1] & letter[:-2] & letter[2:]
    letters = np.maximum(tx.run_sums(letter, off), 1)
    total = tx.run_sums(any_hit, first)
    return np.stack(
        [
            tx.run_sums(hit, first) / n,
            tx.run_sums(begun, first) / n,
            total / n,
            np.log1p(total),
            np.maximum(hidden, 0) / n,
            tx.run_sums(any_hit & near, first) / n,
            tx.run_sums(second, first) / n,
            tx.run_sums(upper, off) / letters,
            tx.run_sums(body == 33, off) / size,
            tx.run_sums(punct, off) / size,
            tx.run_sums(mixed, off) / n,
            np.log1p(np.diff(first)),
        ],
        axis=1,
    ).astype(float)


class Model:
    """Lexicon, trees and calibration; small enough to be sent with each task."""

    def __init__(self, texts: list[bytes], y: np.ndarray, w: np.ndarray) -> None:
        # Thirds in turn within each class, so all have both classes.
        part = np.zeros(len(y), int)
        for c in (0, 1):
            at = np.flatnonzero(y == c)
            part[at] = np.arange(len(at)) % 3
        pick = lambda k: learn.arrow_texts([t for t, p in zip(texts, part, strict=True) if p == k])
        self.lexicon = Lexicon(pick(0), y[part == 0])
        self.trees = learn.BoostedTrees(features(pick(1), self.lexicon), y[part == 1], w[part == 1])
        self.calibrated = learn.Isotonic(self.trees.margin(features(pick(2), self.lexicon)), y[part == 2], w[part == 2])

    def score(self, col: pa.Array) -> np.ndarray:
        return self.calibrated(self.trees.margin(features(col, self.lexicon)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = learn.FIT_ROWS) -> Model:
    return Model(*learn.labelled_sample(docs, labels, "toxic", FOLDS, FOLD, rows=rows))


def score_documents(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), cut: float = CUT) -> DataFrame:
    """keep columns, held_out, score and predicted of every row."""

    def run(col: pa.Array) -> dict:
        s = model.score(col)
        return {"score": s, "predicted": (s >= cut).astype(np.int32)}

    scored = tx.map_texts(docs, text, list(keep), "score double, predicted int", run)
    return scored.withColumn("held_out", learn.held_out("doc_id", FOLDS, FOLD)) if "doc_id" in keep else scored


def keep_clean(docs: DataFrame, model: Model, text: str = "text", cut: float = CUT) -> DataFrame:
    """The documents scored below the cut, with all their columns."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = tx.utf8(batch.column(at))
            for a, b in tx.slices(off):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(model.score(part.column(at)) < cut))
            tx.give_back()

    return docs.mapInArrow(run, docs.schema)
