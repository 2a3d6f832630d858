"""Best-fit packing of documents into sequences, after a Martello-Toth reduction.

Lengths are whole numbers up to the capacity, so the instance is a histogram of
at most `capacity` counts however many documents there are.  The plan is made
on that histogram: whole groups of equal lengths are placed at once.

Reduction: going down the lengths, a set that holds the longest piece is fixed
for good where it provably dominates every other set with that piece: the piece
alone if nothing fits beside it; with its exact complement; with the longest
piece that fits, if no two others fit, or if no three fit and no fitting pair
is larger than that piece.  Fixing sets only takes pieces away, and with fewer
pieces a dominance stays one, so a set is fixed as often as its pieces last:
every step uses up a length, and the plan has a small multiple of `capacity`
rows however many pieces there are.  The rest is packed best-fit, longest
first, whole runs of sequences with equal room at a time; a run that takes in
pieces of a length is left with less than half its room, so it is visited
log2(capacity) times at most.

Pieces get numbers 0, 1, ... within their length (see sharding.gapless) and find
their place in the plan by length and number.  The numbers of a length are dealt
to salts in proportion to its count (PARTS in all), so a length that a third of
the pieces have is numbered by a third of all parts.  Full pieces are sequences of their own.

Cases: a null text is empty (one token, the end mark); a null doc_id keeps its
row; repeated rows are packed each; an empty table gives an empty table; longer
documents are cut into full pieces from the end, so the first may be shorter.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import text as tx
from .lineage import cut
from .sharding import gapless

CAPACITY = 1024
END = 2
#: Parts among which all pieces are numbered, about; each length has one at least.
PARTS = 1 << 15


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    name = bpe.ship(docs, path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = tx.utf8(batch.column(1))
            for a, b in tx.slices(off, bpe.SLICE):
                ids, first = bpe.encoder(name, "").encode(batch.column(1).slice(a, b - a))
                flat = memoryview(np.insert(ids, first[1:], end).astype("<u4").tobytes())
                first = first + np.arange(len(first))
                total = np.diff(first)
                n = -(-total // capacity)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = total - (n - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                at = (first[doc] + start) * 4
                crc = np.array([zlib.crc32(flat[x : x + 4 * k]) for x, k in zip(at.tolist(), length.tolist(), strict=True)], np.int64)
                keys = batch.column(0).slice(a, b - a).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([keys, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
            tx.give_back()

    return docs.select("doc_id", F.col(text).cast("string").alias("_text_")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Places for a histogram of lengths below the capacity. places: (length, from, to, sequence, per, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.left = [0] * (capacity + 1)
        for k, n in counts.items():
            self.left[k] = n
        self.given = [0] * (capacity + 1)
        self.places: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()

    def _put(self, length: int, bins: int, per: int, sequence: int, offset: int) -> None:
        """per pieces of a length into each of `bins` sequences."""
        a = self.given[length]
        self.places.append((length, a, a + bins * per, sequence, per, offset))
        self.given[length] += bins * per
        self.left[length] -= bins * per

    def _fix(self, lengths: list[int], bins: int) -> None:
        at = 0
        for x in lengths:
            self._put(x, bins, 1, self.sequences, at)
            at += x
        self.sequences += bins

    def _smallest(self, k: int, but: int) -> list[int]:
        """The k smallest remaining lengths without one piece of length `but`."""
        out: list[int] = []
        for x in range(1, self.capacity + 1):
            n = self.left[x] - (x == but)
            out += [x] * min(n, k - len(out))
            if len(out) == k:
                break
        return out

    def _pair_above(self, low: int, high: int, but: int) -> bool:
        """Is there a pair of remaining pieces, without one of length `but`, with low < sum <= high?"""
        n = lambda x: self.left[x] - (x == but)
        have = [x for x in range(1, high) if n(x) > 0]
        for x in have:
            i = bisect.bisect_right(have, high - x) - 1
            while i >= 0 and have[i] == x and n(x) < 2:
                i -= 1
            if i >= 0 and x + have[i] > low:
                return True
        return False

    def _reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for w in range(self.capacity - 1, 0, -1):
                while self.left[w]:
                    room = self.capacity - w
                    small = self._smallest(3, w)
                    if not small or small[0] > room:
                        self._fix([w], 1 if w <= room else self.left[w])
                    elif self.left[room] - (room == w) > 0:
                        self._fix([w, room], self.left[w] // 2 if room == w else min(self.left[w], self.left[room]))
                    else:
                        b = next(x for x in range(room, 0, -1) if self.left[x] - (x == w) > 0)
                        two = len(small) > 1 and small[0] + small[1] <= room
                        three = len(small) > 2 and sum(small) <= room
                        if two and (three or self._pair_above(b, room, w)):
                            break
                        self._fix([w, b], self.left[w] // 2 if b == w else min(self.left[w], self.left[b]))
                    changed = True

    def _best_fit(self) -> None:
        open_runs: dict[int, list[tuple[int, int]]] = {}
        rooms: list[int] = []

        def store(room: int, sequence: int, bins: int) -> None:
            if bins and room:
                if room not in open_runs:
                    open_runs[room] = []
                    bisect.insort(rooms, room)
                open_runs[room].append((sequence, bins))

        for w in range(self.capacity - 1, 0, -1):
            while k := self.left[w]:
                i = bisect.bisect_left(rooms, w)
                if i < len(rooms):
                    room = rooms[i]
                    sequence, bins = open_runs[room].pop()
                    if not open_runs[room]:
                        del open_runs[room]
                        rooms.pop(i)
                else:
                    room, sequence, bins = self.capacity, self.sequences, -(-k // (self.capacity // w))
                    self.sequences += bins
                per = min(room // w, k)
                take = min(bins, k // per)
                self._put(w, take, per, sequence, self.capacity - room)
                store(room - per * w, sequence, take)
                store(room, sequence + take, bins - take)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, text: str = "text") -> DataFrame:
    """The pieces of all documents with their sequence and offset in it."""
    spark = docs.sparkSession
    cutpieces = cut(pieces(docs, path, capacity, end, text))
    counts = {r["length"]: r["n"] for r in cutpieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = Plan({k: n for k, n in counts.items() if k < capacity}, capacity)
    schema = "_length_ long, _from_ long, _to_ long, _sequence_ long, _per_ long, _offset_ long"
    places = spark.createDataFrame(plan.places, schema)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = cutpieces.filter(F.col("length") == capacity).withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long"))
    total = max(1, sum(counts.values()))
    salts = F.element_at(F.array(*[F.lit(max(1, -(-PARTS * counts.get(k, 0) // total))) for k in range(1, capacity + 1)]), F.col("length").cast("int"))
    part = gapless(cutpieces.filter(F.col("length") < capacity), "length", ["doc_id", "piece", "ids_crc32"], "_rank_in_", salts)
    here = (F.col("length") == F.col("_length_")) & (F.col("_rank_in_") >= F.col("_from_")) & (F.col("_rank_in_") < F.col("_to_"))
    step = F.col("_rank_in_") - F.col("_from_")
    part = part.join(F.broadcast(places), here).withColumn("sequence_id", F.col("_sequence_") + F.expr("(_rank_in_ - _from_) div _per_")).withColumn("offset", F.col("_offset_") + (step % F.col("_per_")) * F.col("length"))
    return full.select(*cols).unionByName(part.select(*cols))
