"""Near-duplicate vectors: spherical k-means cells and blocked cosine products within cells.

Vectors are compared only under equal labels (and dimensions).  Every label gets
centroids, fitted in a task of its own on a sample of FIT_BYTES at most; their
number is the power of two, from 2 up to a sixteenth of the sample, for which the
sample promises the least work.  Every vector has the cell of its nearest
centroid as home.  A vector near a border is also a guest of the cells beyond it:
the distance of y to the border of cells C and D is (cos(y, C) - cos(y, D)) /
|C - D|, and a link spans at most sqrt(2 - 2 tau).  A link across the border has
its ends on both sides, their distances to it add up to its length at most, so
one of them lies within half of it: guests up to MARGIN = 1/2 of that span find
every link, whatever the data.  Each pair is counted in one cell.

Centroids stay a table: the vectors of a label are dealt into parts of PART_BYTES,
and each part meets its label's centroids in a cogroup that adds home and cells
to each vector.  A cell is dealt into blocks of about BLOCK_BYTES by a hash, and each
pair of blocks is one group of a grouped map: memory is bounded by two blocks, a
hot cell spreads over many groups, and a group returns one row per linked vector
(its links there and the least vector it reaches), never a row per pair.

Equal vectors of a label are compared once, as one with its number of copies: a
group of copies costs no products, and links are counted with copies.  Equality
is that of two 64-bit hashes and the dimension.

Cases: null, zero, null-holding and non-finite vectors, null labels and null
ids link with nothing; of rows that share a vec_id one takes part, that with the
least label and vector; each row of the input gives a row; an empty table gives
an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .lineage import cut, drop

THRESHOLD = 0.93
MARGIN = 0.5
#: Slack for rounding, in distance to a border.
SLACK = 1e-6
#: Bytes, at four a component, of the sample of a label, of a part of its vectors, and of a block of a cell.
FIT_BYTES, PART_BYTES, BLOCK_BYTES = 16 << 20, 4 << 20, 1 << 20
#: Entries of a matrix of products at once, about.
PRODUCTS = 1 << 20
#: Sampled vectors per centroid, and what it costs to ship a vector, in products.
PER_CENTROID, SHIP = 16, 2000
_KEYS = ["label", "d"]


def matrix(col: pa.Array, d: int, rows: np.ndarray) -> np.ndarray:
    """The given rows, all of length d, in double precision; null components become nan."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = np.asarray(col.offsets).astype(np.int64)
    values = np.asarray(col.values.to_numpy(zero_copy_only=False), np.float64)
    return values[off[:-1][rows][:, None] + np.arange(d)]


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and which rows have a length that is finite and not 0."""
    with np.errstate(all="ignore"):
        top = np.abs(x).max(1, initial=0.0)
        scaled = x / np.where(top > 0, top, 1)[:, None]
        length = np.sqrt((scaled * scaled).sum(1))
        ok = np.isfinite(x).all(1) & (top > 0)
        return scaled / np.where(ok, length, 1)[:, None], ok


def _slices(n: int, k: int) -> Iterator[slice]:
    """Row ranges for which a matrix with k columns has about PRODUCTS entries."""
    step = max(16, PRODUCTS // max(1, k))
    return (slice(a, a + step) for a in range(0, n, step))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """k unit centroids of unit rows; empty cells keep their centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[part] @ c.T).argmax(1) for part in _slices(len(x), k)])
        order = np.argsort(own, kind="stable")
        cells, first = np.unique(own[order], return_index=True)
        m = np.add.reduceat(x[order], first)
        n = np.linalg.norm(m, axis=1)
        c[cells[n > 0]] = m[n > 0] / n[n > 0][:, None]
    return c


def cells_of(c: np.ndarray, x: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each row, and a boolean matrix of the cells in which it takes part."""
    s = x @ c.T
    at = np.arange(len(x))
    home = s.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * c[home] @ c.T, 1e-8))
    part = (s[at, home][:, None] - s) / apart <= MARGIN * sqrt(max(0.0, 2 - 2 * tau)) + SLACK
    part[at, home] = True
    return home, part


def fitted(x: np.ndarray, n: int, block: int, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """Centroids for n vectors, from a sample of unit rows, and the vectors to expect in each cell (guests too)."""
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    k, worse = 2, 0
    while len(x) and worse < 2 and (best is None or k <= len(x) // PER_CENTROID):
        c = spherical_kmeans(x, k)
        size = sum(cells_of(c, x[part], tau)[1].sum(0) for part in _slices(len(x), k)) * (n / len(x))
        work = float((size * size / 2 + SHIP * size * np.ceil(size / block)).sum())
        if best is None or work < best[0]:
            best, worse = (work, c, size), 0
        else:
            worse += 1
        k *= 2
    if best is None:  # no usable vector in the sample: one cell
        return np.zeros((1, 0)), np.array([float(n)])
    return best[1], best[2]


def fit(vectors: DataFrame, tau: float, fit_bytes: int = FIT_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """label, d, n, block counts of the cells and centroids of each label; a cut table. vectors: label, d, embedding."""

    def run(t: pa.Table) -> pa.Table:
        label, d, n = (t[k][0].as_py() for k in ("label", "d", "n"))
        x, ok = unit(matrix(t["embedding"], d, np.arange(len(t))))
        block = max(16, block_bytes // (4 * d))
        c, size = fitted(x[ok], n, block, tau)
        blocks = np.maximum(np.ceil(size / block), 1).astype(np.int32)
        return pa.table({"label": [label], "d": pa.array([d], pa.int32()), "n": [n], "blocks": pa.array([blocks.tolist()], pa.list_(pa.int32())), "centroids": pa.array([c.tobytes()], pa.binary())})

    counts = cut(vectors.groupBy(*_KEYS).agg(F.count("*").alias("n")))
    sample = vectors.join(counts, _KEYS).filter(F.rand(1) * F.col("n") * 4 * F.col("d") < fit_bytes)
    models = sample.groupBy(*_KEYS).applyInArrow(run, "label string, d int, n long, blocks array<int>, centroids binary")
    # A label that the sample missed is one cell.
    models = cut(models)
    rest = counts.join(models.select(*_KEYS), _KEYS, "left_anti")
    one = F.array(F.ceil(F.col("n") * 4 * F.col("d") / block_bytes).cast("int"))
    out = cut(models.unionByName(rest.select(*_KEYS, "n", one.alias("blocks"), F.lit(b"").alias("centroids"))))
    drop(counts, models)
    return out


def assigned(vectors: DataFrame, models: DataFrame, tau: float, part_bytes: int = PART_BYTES) -> DataFrame:
    """vec_id, copies, embedding, label, d, home, cells and the block counts of these, for every usable vector."""
    kind, vec = vectors.schema["vec_id"].dataType.simpleString(), vectors.schema["embedding"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        d = left["d"][0].as_py() if len(left) else 1
        blocks = np.asarray(right["blocks"][0].as_py() if len(right) else [1], np.int32)
        x, ok = unit(matrix(left["embedding"], d, np.arange(len(left))))
        c = np.frombuffer(right["centroids"][0].as_py() if len(right) else b"", np.float64).reshape(-1, d)
        left, x = left.filter(pa.array(ok)), x[ok]
        homes, owners, cells = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)]
        for rows in _slices(len(x), len(c)):
            n = len(x[rows])
            home, part = cells_of(c, x[rows], tau) if len(c) else (np.zeros(n, int), np.ones((n, 1), bool))
            i, j = np.nonzero(part)
            homes, owners, cells = [*homes, home], [*owners, i + rows.start], [*cells, j]
        flat = np.concatenate(cells)
        first = pa.array(np.searchsorted(np.concatenate(owners), np.arange(len(x) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(first, pa.array(v.astype(np.int32))) for v in (flat, blocks[flat])]
        made = [left[k].combine_chunks() for k in ("vec_id", "copies", "label", "d", "embedding")] + [pa.array(np.concatenate(homes).astype(np.int32)), *lists]
        return pa.table(dict(zip(("vec_id", "copies", "label", "d", "embedding", "home", "cells", "blocks"), made, strict=True)))

    parts = F.ceil(F.col("n") * 4 * F.col("d") / part_bytes).cast("int")
    keyed = vectors.join(models.select(*_KEYS, "n"), _KEYS).withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))
    keyed = keyed.select("vec_id", "copies", "label", "d", "embedding", "part").groupBy(*_KEYS, "part")
    dealt = models.select(*_KEYS, "blocks", "centroids", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).groupBy(*_KEYS, "part")
    return keyed.cogroup(dealt).applyInArrow(run, f"vec_id {kind}, copies long, label string, d int, embedding {vec}, home int, cells array<int>, blocks array<int>")


def deal(vectors: DataFrame) -> DataFrame:
    """A row for every assigned vector in every pair of blocks in which it takes part."""
    in_cells = vectors.select("*", F.explode(F.arrays_zip("cells", "blocks")).alias("at"))
    in_cells = in_cells.select("vec_id", "copies", "label", "d", "embedding", "home", "cells", F.col("at.cells").alias("cell"), F.col("at.blocks").alias("m"))
    in_block = in_cells.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return in_block.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("m", "other")


def _joined(parent: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The forest of least labels after the edges (p, q)."""
    while len(p):
        a, b = parent[p], parent[q]
        apart = a != b
        if not apart.any():
            break
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def _compare(table: pa.Table, tau: float) -> pa.Table:
    ids = table["vec_id"].combine_chunks()
    d = table["d"][0].as_py()
    x, _ = unit(matrix(table["embedding"], d, np.arange(len(table))))
    cell, lo, hi = (table[k][0].as_py() for k in ("cell", "lo", "hi"))
    block, home = np.asarray(table["block"]), np.asarray(table["home"])
    order = np.argsort(np.asarray(ids), kind="stable")
    key = np.empty(len(order), np.int64)  # the rank of each id
    key[order] = np.arange(len(order))
    a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    counted = np.zeros((len(table), 0), bool)
    foreign = np.unique(home[home != cell])
    if len(foreign):  # is a row also a guest in the home of the others?
        spans = table["cells"].combine_chunks()
        owner = np.repeat(np.arange(len(table)), np.asarray(spans.value_lengths()))
        flat = np.asarray(spans.flatten())
        at = np.searchsorted(foreign, flat)
        at[at == len(foreign)] = 0
        counted = np.zeros((len(table), len(foreign)), bool)
        good = foreign[at] == flat
        counted[owner[good], at[good]] = True
    n, copies = np.zeros(len(table), np.int64), np.asarray(table["copies"])
    parent = np.arange(len(table))  # in the order of ids
    for s in range(0, len(a), 256):
        u = a[s : s + 256]
        hit = x[u] @ x[b].T >= tau
        hit &= (key[u][:, None] < key[b][None, :]) if lo == hi else (key[u][:, None] != key[b][None, :])
        gu, gb = home[u] != cell, home[b] != cell
        if gu.any() or gb.any():
            hit &= ~(gu[:, None] & gb[None, :])
            i, j = np.nonzero(hit)
            p, q = u[i], b[j]
            guest, host = np.where(home[p] != cell, p, q), np.where(home[p] != cell, q, p)
            cross = home[guest] != cell
            k = np.searchsorted(foreign, home[guest])
            twice = np.zeros(len(p), bool)
            twice[cross] = counted[host[cross], k[cross]] & (cell > home[guest[cross]])
            p, q = p[~twice], q[~twice]
        else:
            i, j = np.nonzero(hit)
            p, q = u[i], b[j]
        np.add.at(n, p, copies[q])
        np.add.at(n, q, copies[p])
        parent = _joined(parent, key[p], key[q])
    some = np.flatnonzero(n)
    return pa.table({"vec_id": ids.take(pa.array(some)), "n": n[some], "root": ids.take(pa.array(order[parent[key[some]]]))})


def _once(vectors: DataFrame) -> DataFrame:
    """One row of each vec_id: that with the least label and embedding. Only repeated ids are shuffled."""
    twice = cut(vectors.groupBy("vec_id").agg(F.count("*").alias("k")).filter("k > 1").select("vec_id"))
    if twice.isEmpty():
        return vectors
    least = vectors.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v"))
    return vectors.join(twice, "vec_id", "left_anti").unionByName(least.select("vec_id", "v.label", "v.embedding"))


def _copies(vectors: DataFrame) -> DataFrame:
    """vec_id, cid and copies of every vector that has equals in its label; cid is the least vec_id among them. A cut table."""
    keyed = vectors.select("vec_id", *_KEYS, F.xxhash64("embedding").alias("f"), F.xxhash64(F.lit("g"), "embedding").alias("g"))
    many = cut(keyed.groupBy(*_KEYS, "f", "g").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies")).filter("copies > 1"))
    out = cut(keyed.join(many, [*_KEYS, "f", "g"]).select("vec_id", "cid", "copies"))
    drop(many)
    return out


def near_vectors(
    vectors: DataFrame, tau: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    fit_bytes: int = FIT_BYTES, part_bytes: int = PART_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector; see the module's text."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("embedding"))
    usable = _once(rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0))).withColumn("d", F.size("embedding"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    equal = _copies(usable)
    first = equal.filter("vec_id = cid").select("vec_id", "copies")
    ones = usable.join(equal.filter("vec_id <> cid"), "vec_id", "left_anti").join(first, "vec_id", "left").withColumn("copies", F.coalesce("copies", F.lit(1)).cast("long"))
    models = fit(ones, tau, fit_bytes, block_bytes)
    dealt = deal(assigned(ones, models, tau, part_bytes))
    found = cut(dealt.groupBy("label", "d", "cell", "lo", "hi").applyInArrow(lambda t: _compare(t, tau), f"vec_id {kind}, n long, root {kind}"))
    drop(models)
    links = cut(found.groupBy("vec_id").agg(F.sum("n").alias("n")))
    labels = components(found, "vec_id", "root").withColumnsRenamed({"id": "vec_id"})
    # Copies have the links of the first of them, and each other; zero and broken vectors have none.
    real = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    ok = usable.join(first, "vec_id", "left_semi").filter(real).select(F.col("vec_id").alias("cid"))
    ends = ok.join(links.withColumnsRenamed({"vec_id": "cid"}), "cid", "left").join(labels.withColumnsRenamed({"vec_id": "cid"}), "cid", "left")
    ends = cut(ends.select("cid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "cid").alias("component")))
    of_copies = equal.join(ends, "cid").select("vec_id", (F.col("n") + F.col("copies") - 1).alias("_n_"), F.col("component").alias("_c_"))
    out = rows.select("vec_id").join(links, "vec_id", "left").join(labels, "vec_id", "left").join(of_copies, "vec_id", "left")
    comp = F.coalesce("_c_", "component", "vec_id")
    return out.select("vec_id", F.coalesce("_n_", "n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))
