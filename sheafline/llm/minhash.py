"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: round i < t throws every shingle of a document into a hashed one of t
bins and keeps the least value (i, hash) of each bin; rounds t to 2t - 1 throw
all shingles into bin i - t.  So every coordinate is filled, a document of n
shingles needs about (t log t) / n rounds, and equal coordinates estimate the
Jaccard similarity with concentration bounds.  `bands` keys of `rows`
coordinates each are the buckets in which candidates meet.

Equal shingle sets are one class, known by a hash of its row with the least
doc_id and that row's text.  Within a bucket, classes are compared with
pivots, not all with all: first with the least class of the bucket, then with
four random ones.  A class already in the pivot's component needs
no comparison, a pivot is done with its bucket, and a bucket of one component
is done as a whole; so the groups of near copies that make buckets large leave
after a few turns.  The last turn takes all classes that are left as pivots.
The classes of a bucket are dealt into parts of about PART, each of which meets
all its pivots, so a hot bucket is spread over as many tasks.
The join that makes pairs bounds their similarity from above by set sizes and
1024 parity bits of either set, which loses no link, so families of documents
just below the threshold don't become pairs.
Every comparison counts shingles of the full texts, as 64-bit hashes.  So each
pair that shares a bucket is either compared or known to be connected, and
components lose nothing; a pair at the threshold shares a bucket with
probability 1 - (1 - 0.8^rows)^bands, 0.99994 with the defaults.

Cases: null texts and texts without words have an empty set, link with nothing
and are kept; a null doc_id links with nothing and has no component; rows that
share a doc_id but not a text are vertices of their own, each in the component of
its text, and none is lost by `keep_one`; rows equal in both are one vertex; an
empty table gives an empty table; very long texts only cost their own length;
other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .lineage import cut, drop, new_folder, remove

BANDS, ROWS = 32, 6
SHINGLE = 5
#: A link needs 100 * |intersection| >= PERCENT * |union|.
PERCENT = 80
#: Pivots of each bucket in each turn, on average; the first turn takes the least class, None takes all that are left.
PIVOTS = (1, 4, None)
#: Classes of a bucket in a part, about.
PART = 1024
#: Parity bits of a set.
BITS = 1024
#: Bit tables of 32768 bits that preselect texts, at least and at most.
BITMAPS, MAX_BITMAPS = 512, 16384
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)


def shingles(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text (sorted within a text), and where each text's begin (len + 1)."""
    raw, off = tx.utf8(col)
    w = tx.words(tx.padded(raw, lower=True), off)
    h, n = w.hashes(), np.diff(w.first)
    doc = w.doc_of()
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), count)
    start = w.first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    width = np.minimum(n, size)[owner]
    s = tx.mix64(width.astype(np.uint64))
    for k in range(size):
        more = width > k
        s = np.where(more, tx.combine64(s, h[np.minimum(start + k, max(len(h) - 1, 0))]), s) if len(h) else s
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    del doc
    return s, np.searchsorted(owner, np.arange(len(n) + 1))


def sketch(s: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """A row of t coordinates for each set s[first[i]:first[i + 1]]; empty sets keep unfilled rows."""
    n = len(first) - 1
    out = np.full(n * t, _EMPTY)
    doc = np.repeat(np.arange(n), np.diff(first))
    x = s
    for i in range(2 * t):
        if not len(x):
            break
        h = tx.mix64(x ^ tx.mix64(np.array([i + 1], np.uint64)))
        at = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, doc * t + at, np.uint64(i << 32) | (h & _LOW))
        open_ = (out.reshape(n, t) == _EMPTY).any(1)
        rest = open_[doc]
        if not rest.all():
            x, doc = x[rest], doc[rest]
    return out.reshape(n, t)


def band_keys(sk: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sk.reshape(len(sk), bands, rows)
    key = np.broadcast_to(tx.mix64(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2])
    for k in range(rows):
        key = tx.combine64(key, parts[:, :, k])
    return key


def parities(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BITS parity bits of each set, as rows of 64-bit words: bit i tells whether an odd number of shingles falls on i.

    Two sets differ in at least as many shingles as their rows differ in bits.
    """
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    bit = (tx.mix64(s ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(BITS)).astype(np.int64)
    key, count = np.unique(doc * BITS + bit, return_counts=True)
    key = key[count % 2 == 1]
    out = np.zeros(n * BITS // 64, np.uint64)
    np.bitwise_or.at(out, key // 64, np.uint64(1) << (key % 64).astype(np.uint64))
    return out.reshape(n, BITS // 64)


def _lists(rows: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Rows as list values, null where not kept."""
    n, k = rows.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64)))
    return lists.take(pa.array(np.arange(n), mask=~keep))


def _row(doc_id: Column, text: Column) -> Column:
    """A hash of id and text that stands for a row; null without an id."""
    return F.when(doc_id.isNotNull(), F.xxhash64(doc_id, F.xxhash64(text)))


def sketches(docs: DataFrame, size: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, row, n_shingles, a 128-bit fingerprint of the set (f, g), its band keys and parity bits (null: empty set)."""

    def run(col: pa.Array) -> dict:
        s, first = shingles(col, size)
        n = np.diff(first)
        keys = band_keys(sketch(s, first, bands * rows), bands, rows)
        f = tx.run_sums(s.view(np.int64), first)
        g = tx.run_sums(tx.mix64(s ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64), first)
        return {"n_shingles": n.astype(np.int64), "f": f, "g": g, "bands": _lists(keys, n > 0), "bits": _lists(parities(s, first), n > 0)}

    body = F.col(text).cast("string")
    ids = docs.select(F.col(doc_id).alias("doc_id"), _row(F.col(doc_id), body).alias("row"), body.alias("text"))
    return tx.map_texts(ids, "text", ["doc_id", "row"], "n_shingles long, f long, g long, bands array<long>, bits array<long>", run)


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs (a, b, ca, cb) whose full shingle sets are similar enough; texts: _id_, _t_."""
    kind = pairs.schema["a"].dataType.simpleString()
    one = pairs.join(texts, F.col("a") == F.col("_id_")).select("a", "b", "ca", "cb", F.col("_t_").alias("s"))
    both = one.join(texts, F.col("b") == F.col("_id_")).select("a", "b", "ca", "cb", "s", F.col("_t_").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = tx.utf8(batch.column(4))
            for x, y in tx.slices(off):
                part = batch.slice(x, y - x)
                s, sf = shingles(part.column(4), size)
                t, tf = shingles(part.column(5), size)
                n, m = np.diff(sf), np.diff(tf)
                owner = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)])
                h = np.concatenate([s, t])
                order = np.lexsort((h, owner))
                same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
                shared = np.bincount(owner[order][1:][same], minlength=len(n))
                union = n + m - shared
                ok = pa.array((100 * shared >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(4)], names=["a", "b", "ca", "cb"]).filter(ok)
            tx.give_back()

    return both.mapInArrow(run, f"a {kind}, b {kind}, ca {kind}, cb {kind}")


def _maybe(docs: DataFrame, key: str, ids: DataFrame, n: int) -> DataFrame:
    """docs with _maybe_: can the key be among the n ids (column v)? False is certain.

    The ids become a bit table of 16 bits an id, of BITMAPS to MAX_BITMAPS rows of 4 KB, so that other texts
    never leave their scan.
    """
    bits = min(MAX_BITMAPS, max(BITMAPS, 1 << (n * 16 >> 15).bit_length())) * 32768
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    slot = ids.select(place(F.col("v")).alias("h"))
    table = slot.select(F.floor(F.col("h") / 32768).alias("_slot_"), F.bitmap_bit_position(F.col("h") % 32768 + 1).alias("p")).groupBy("_slot_").agg(F.bitmap_construct_agg("p").alias("_bits_"))
    found = docs.withColumn("_h_", F.when(F.col(key).isNotNull(), place(F.col(key)))).join(F.broadcast(table), F.floor(F.col("_h_") / 32768) == F.col("_slot_"), "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits_"), F.expr("cast(_h_ % 32768 div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    return found.withColumn("_maybe_", F.coalesce(F.getbit(byte, (F.col("_h_") % 8).cast("int")) == 1, F.lit(False))).drop("_h_", "_slot_", "_bits_")


def _linked(docs: DataFrame, size: int, percent: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, row, n_shingles, component_id (null without an id) and first (does the row stand for its component?) of every row; a cut table."""
    spark = docs.sparkSession
    sk = cut(sketches(docs, size, bands, rows, doc_id, text))
    full = sk.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # Aggregates are cut before they are joined back: a join of two plain shuffles can split a hot class or bucket.
    classes = cut(full.groupBy("f", "g").agg(F.min("doc_id").alias("cid"), F.min_by("row", "doc_id").alias("v")))
    # One row of each class carries its bands into the buckets; a bucket of one class is of no use.
    reps = full.join(classes.select(F.col("v").alias("row")), "row", "left_semi").dropDuplicates(["row"])
    reps = cut(reps.select(F.col("row").alias("v"), F.col("n_shingles").alias("n"), "bands", "bits"))
    dealt = reps.select(F.explode("bands").alias("bucket"), "v", "n")
    many = cut(dealt.groupBy("bucket").agg(F.min("v").alias("least"), F.max("v").alias("v1"), F.count("*").alias("size")).filter("least < v1").drop("v1"))
    met = cut(dealt.join(many, "bucket").withColumn("c", F.col("v")))
    drop(many)
    body = F.col(text).cast("string")
    wanted = met.select("v").distinct()
    texts = _maybe(docs.select(_row(F.col(doc_id), body).alias("_id_"), body.alias("_t_")), "_id_", wanted, wanted.count()).filter("_maybe_").drop("_maybe_")
    twice = cut(full.groupBy("row").agg(F.count("*").alias("k")).filter("k > 1").select("row"))
    if not twice.isEmpty():  # equal rows give one text
        on = F.col("_id_") == F.col("row")
        texts = texts.join(twice, on, "left_anti").unionByName(texts.join(twice, on, "left_semi").dropDuplicates(["_id_"]))
    texts.write.parquet(path := new_folder(spark))
    texts = spark.read.schema(texts.schema).parquet(path)
    drop(twice)

    # At most (n + m - h) / 2 shingles are shared if h parity bits differ: pairs that can't reach the threshold are never made.
    differ = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("other")[i])) for i in range(BITS // 64)), F.lit(0))
    both = F.col("n") + F.col("m")
    near = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent) & (100 * (both - differ) >= percent * (both + differ))
    labels = cut(classes.limit(0).select(F.col("v").alias("id"), F.col("v").alias("component")))
    for turn, k in enumerate(PIVOTS):
        if met.isEmpty():
            break
        if turn == 0:  # every class with the least of its bucket, which the bucket's row has brought along
            pairs = met.filter("v <> least").select(F.col("v").alias("a"), F.col("least").alias("b"), F.col("v").alias("ca"), F.col("least").alias("cb"))
            chosen = met.join(reps.select("v", "bits"), "v").withColumn("pivot", F.col("v") == F.col("least")).drop("least")
        else:
            chance = F.pmod(F.xxhash64("v", "bucket", F.lit(turn)), F.lit(1 << 30)) * F.col("size") < F.lit((k or 0) << 30)
            chosen = met.withColumn("pivot", chance if k else F.lit(True))
            parts = F.ceil(F.col("size") / PART)
            p = chosen.filter("pivot").select(F.col("bucket").alias("_b_"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_p_"), F.col("v").alias("y"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("bits").alias("other"))
            asking = chosen.withColumn("part", F.pmod(F.xxhash64("v"), parts))
            # Two pivots meet twice; the smaller one asks then.
            asks = (F.col("bucket") == F.col("_b_")) & (F.col("part") == F.col("_p_")) & (F.col("c") != F.col("d")) & near & (~F.col("pivot") | (F.col("v") > F.col("y")))
            pairs = asking.join(p, asks).select(F.greatest("v", "y").alias("a"), F.least("v", "y").alias("b"), F.greatest("c", "d").alias("ca"), F.least("c", "d").alias("cb"))
        links = cut(verified(pairs.dropDuplicates(["a", "b"]), texts, size, percent))
        moves = components(links, "ca", "cb")
        step = moves.withColumnsRenamed({"id": "_i_", "component": "_c_"})
        old = labels.join(step, F.col("component") == F.col("_i_"), "left").select("id", F.coalesce("_c_", "component").alias("component"))
        new = cut(old.unionByName(moves))
        # A pivot is settled with its whole bucket; so is a bucket of one component.
        now = chosen.filter("not pivot").join(step, F.col("c") == F.col("_i_"), "left").select("bucket", "v", "n", "bits", F.coalesce("_c_", "c").alias("c"))
        apart = cut(now.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("size")).filter("c0 < c1").select("bucket", "size"))
        rest = cut(now.join(apart, "bucket"))
        drop(links, moves, labels, apart, met)
        labels, met = new, rest
    drop(met, reps)
    remove(spark, path)

    # The least id of each component of two classes or more, and the class that has it.
    ends = labels.unionByName(labels.select(F.col("component").alias("id"), "component").distinct())
    named = classes.join(ends, F.col("v") == F.col("id"))
    best = cut(named.groupBy("component").agg(F.min("cid").alias("least"), F.min_by("v", "cid").alias("keep")))
    names = ends.join(best, "component").select(F.col("id").alias("_v_"), "least", "keep")
    out = sk.select("doc_id", "row", "n_shingles", "f", "g").join(classes, ["f", "g"], "left").join(names, F.col("v") == F.col("_v_"), "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    comp = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("least", "cid"))
    out = cut(out.select("doc_id", "row", "n_shingles", comp.alias("component_id"), (alone | (F.col("row") == F.coalesce("keep", "v"))).alias("first")))
    drop(sk, classes, labels, best)
    return out


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (is it the component's least id?) of every row; see the module's text."""
    out = _linked(docs, size, percent, bands, rows, doc_id, text)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with all its columns: the one with the least id.

    Rows are told apart by id and text, so a text stays unless a near copy of it
    does.  Of rows equal in both any one stays; rows without an id or without
    words all do.
    """
    marked = _linked(docs, size, percent, BANDS, ROWS, doc_id, text).filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    gone = marked.filter(~F.col("first")).select(F.col("row").alias("_row_")).distinct()
    again = marked.filter("first").groupBy(F.col("row").alias("_row_")).agg(F.count("*").alias("_n_")).filter("_n_ > 1").select("_row_")
    odd = cut(gone.withColumn("_gone_", F.lit(True)).unionByName(again.withColumn("_gone_", F.lit(False))))
    # Only rows that may be among these are shuffled.
    rows = _maybe(docs.withColumn("_row_", _row(F.col(doc_id), F.col(text).cast("string"))), "_row_", odd.select(F.col("_row_").alias("v")), odd.count())
    near = rows.filter("_maybe_").join(odd, "_row_", "left")
    once = near.filter("not _gone_").dropDuplicates(["_row_"])
    return rows.filter("not _maybe_").unionByName(near.filter("_gone_ is null").unionByName(once).drop("_gone_")).select(*docs.columns)
