"""Bounded samples of labelled rows, calibration, and gradient-boosted trees in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of each class that a classifier is fitted on at most, and the longest text among them (bytes).
FIT_ROWS = 3000
FIT_BYTES = 32 << 10


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Is crc32 of the id as text, modulo folds, the given fold? A null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, text: str = "text", rows: int = FIT_ROWS, longest: int = FIT_BYTES) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, labels and weights of at most `rows` documents of each class outside the fold.

    The rows with the least hashes are taken, so the sample depends on ids and
    not on the order or layout of the tables.  Texts above `longest` bytes are
    not fitted on (they are scored).  A class weighs as much as it has rows in
    all, so a calibrated score keeps the base rate.  Conflicting labels of one
    id and null labels are left out; of several texts of one id the least is
    fitted on.
    """
    marks = labels.filter(F.col(label).isin(0, 1) & ~held_out("doc_id", folds, fold)).groupBy("doc_id").agg(F.min(label).alias("_y_"), F.max(label).alias("_z_"))
    marks = marks.filter(F.col("_y_") == F.col("_z_")).select("doc_id", "_y_")
    totals = {r["_y_"]: r["n"] for r in marks.groupBy("_y_").agg(F.count("*").alias("n")).collect()}
    # The ids first, so that only a bounded number of rows meets the texts.
    parts = [marks.filter(F.col("_y_") == y).orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").limit(rows) for y in (0, 1)]
    ids = parts[0].unionByName(parts[1])
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    got = docs.select("doc_id", body.alias("_t_")).filter(F.octet_length("_t_") <= longest).join(F.broadcast(ids), "doc_id")
    got = got.groupBy("doc_id").agg(F.min("_t_").alias("_t_"), F.min("_y_").alias("_y_")).orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").toArrow()
    y = np.asarray(got["_y_"].to_pylist(), np.int64)
    per = {c: totals.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1)}
    texts = [t.as_buffer().to_pybytes() for t in got["_t_"].combine_chunks()] if got.num_rows else []
    del got
    return texts, y, np.array([per[int(c)] for c in y])


class Isotonic:
    """A non-decreasing map from scores to probabilities (pool adjacent violators), linear between blocks."""

    def __init__(self, score: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        if not len(score) or y.min() == y.max():
            p = float(y.mean()) if len(y) else 0.5
            self.x, self.p = np.array([0.0]), np.array([p])
            return
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of wy, sum of w, least and largest score
        for s, t, v in zip(score[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
            if blocks and s == blocks[-1][3]:
                blocks[-1][0] += v * t
                blocks[-1][1] += v
            else:
                blocks.append([v * t, v, s, s])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                b = blocks.pop()
                blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
        base = float((w * y).sum() / w.sum())
        one = float(w.mean())
        self.x = np.array([x for b in blocks for x in (b[2], b[3])])
        self.p = np.array([(b[0] + base * one) / (b[1] + one) for b in blocks for _ in (0, 1)])
        self.p = np.maximum.accumulate(self.p)

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.x, self.p), 0.0, 1.0)


class BoostedTrees:
    """Logistic gradient boosting with depth-limited histogram trees."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0) -> None:
        w = w / w.mean() if len(w) else w
        self.depth = depth
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        p = float(np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-3, 1 - 1e-3))
        self.start = float(np.log(p / (1 - p)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        binned = self._bin(x)
        out = np.full(len(x), self.start)
        for _ in range(trees if len(x) else 0):
            q = 1 / (1 + np.exp(-out))
            tree = self._grow(binned, w * (y - q), w * q * (1 - q), bins, penalty, rate)
            self.trees.append(tree)
            out += self._walk(tree, binned)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if x.shape[1] else np.zeros((len(x), 0), int)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, lam: float, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        node = np.zeros(len(b), int)
        for k in range(size):
            rows = np.flatnonzero(node == k)
            gs, hs = g[rows].sum(), h[rows].sum()
            value[k] = rate * gs / (hs + lam)
            if k >= 2**self.depth - 1 or len(rows) < 20:
                continue
            best = 1e-6
            for j in range(b.shape[1]):
                gl = np.cumsum(np.bincount(b[rows, j], g[rows], bins + 1))
                hl = np.cumsum(np.bincount(b[rows, j], h[rows], bins + 1))
                gain = gl**2 / (hl + lam) + (gs - gl) ** 2 / (hs - hl + lam) - gs**2 / (hs + lam)
                gain[(hl < 1e-3) | (hs - hl < 1e-3)] = 0
                c = int(gain.argmax())
                if gain[c] > best:
                    best, feature[k], cut[k] = gain[c], j, c
            if feature[k] >= 0:
                right = b[rows, feature[k]] > cut[k]
                node[rows] = 2 * k + 1 + right
        return feature, cut, value

    def _walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), int)
        for _ in range(self.depth):
            f = feature[node]
            inner = f >= 0
            right = b[np.arange(len(b)), np.maximum(f, 0)] > cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.start + sum((self._walk(t, b) for t in self.trees), np.zeros(len(x)))


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Probability that a row of class 1 scores above one of class 0; ties count half."""
    s, at = np.unique(score, return_inverse=True)
    one, all_ = np.bincount(at, y, len(s)), np.bincount(at, minlength=len(s))
    zero = all_ - one
    n = one.sum() * zero.sum()
    return float(((np.cumsum(zero) - zero / 2) * one).sum() / n) if n else float("nan")


def arrow_texts(texts: list[bytes]) -> pa.Array:
    return pa.array([t.decode() for t in texts], pa.string())
