"""Byte-level BPE encoding and decoding with a pair occurrence index.

Encoding works on all distinct pieces (pre-tokens) of a slice of a partition
at once.  Their bytes stand in one array of symbols; an index maps every
adjacent pair that has a merge rank to all its positions.  Ranks are taken in
ascending order from a heap of active ranks: all positions of the pair merge in
one vectorised step, the neighbours' pairs are looked up, and their lists are
extended.  A merge can only create pairs that hold the new symbol, whose own
rank is later, so ascending order is the order of the usual algorithm.

Splitting follows the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` by comparing neighbouring character
classes.  Ids of pieces are kept in a bounded table per Python worker.

Cases: null and empty texts have no tokens; repeated rows repeat their result;
an empty table gives an empty table; very long texts form a slice of their own;
other columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from . import text as tx

#: Distinct pieces whose ids a worker keeps at most; beyond it the table starts anew (results stay the same).
KEPT_PIECES = 1 << 19
#: Bytes of text encoded at once: more of them share the steps of one run through the ranks.
SLICE = 2 << 20
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by its public rule."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    chars = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for m in regex.finditer(pattern, chars):
            points = np.frombuffer(m.group().encode("utf-32-le"), "<u4")
            out[points] = kind
    return out


class Vocabulary:
    """Merges, ids and token bytes of a byte-level BPE file."""

    def __init__(self, spec: str) -> None:
        doc = json.loads(spec)
        back = _byte_symbols()
        vocab: dict[str, int] = doc["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in doc.get("added_tokens", ())}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in s) if s not in self.special else s.encode()
        for s, i in self.special.items():
            self.token_bytes[i] = s.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in back.items():
            self.byte_id[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in doc["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = keys[order], order.astype(np.int64)
        self.token_len = np.array([len(b) for b in self.token_bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.flat_at = np.concatenate([[0], np.cumsum(self.token_len)])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 without one."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.key_rank[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids."""
        n = self.token_len[ids]
        total = int(n.sum())
        step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        return self.flat[np.repeat(self.flat_at[ids], n) + step].tobytes()


def merge_all(v: Vocabulary, symbols: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols and their pieces; symbols stand in piece order."""
    n = len(symbols)
    sym = symbols.astype(np.int64)
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    last = np.ones(n, bool)
    last[:-1] = piece[1:] != piece[:-1]
    nxt[last] = n
    first = np.ones(n, bool)
    first[1:] = last[:-1]
    prv[first] = -1
    alive = np.ones(n + 1, bool)
    alive[n] = False
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(at: np.ndarray) -> None:
        if not len(at):
            return
        r = v.ranks(sym[at], sym[nxt[at]])
        ok = r >= 0
        at, r = at[ok], r[ok]
        if not len(at):
            return
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(np.diff(r)) + 1
        heads = r[np.concatenate([[0], cuts])].tolist()
        for rank, where in zip(heads, np.split(at, cuts), strict=True):
            if (known := index.get(rank)) is None:
                index[rank] = [where]
                heapq.heappush(active, rank)
            else:
                known.append(where)

    add(np.flatnonzero(~last))
    left_of, right_of = v.keys[np.argsort(v.key_rank)] >> 32, v.keys[np.argsort(v.key_rank)] & 0xFFFFFFFF
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[alive[at]]
        at = at[nxt[at] < n]
        a, b = left_of[rank], right_of[rank]
        at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
        if not len(at):
            continue
        if a == b:  # of overlapping positions of one run, every second counts from the left
            follows = np.zeros(len(at), bool)
            follows[1:] = nxt[at[:-1]] == at[1:]
            head = np.flatnonzero(~follows)
            depth = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
            at = at[depth % 2 == 0]
        gone = nxt[at]
        sym[at] = v.merged[rank]
        alive[gone] = False
        after = nxt[gone]
        nxt[at] = after
        inner = after < n
        prv[after[inner]] = at[inner]
        before = prv[at]
        add(np.unique(np.concatenate([at[inner], before[before >= 0]])))
    return sym[alive[:n]], piece[alive[:n]]


def split_pieces(buf: np.ndarray, off: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pieces of texts raw[off[i]:off[i + 1]], and the first piece of each text."""
    total = int(off[-1])
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
    lead = np.flatnonzero((buf[:total] & 0xC0) != 0x80)
    kind = classes()[points]
    n = len(points)
    head = np.zeros(n + 1, bool)
    text_at = np.searchsorted(lead, off)
    head[text_at] = True
    new = np.ones(n + 1, bool)
    new[1:n] = kind[1:] != kind[:-1]
    new |= head
    # The last white space before other text: a plain space joins what follows, another stands alone.
    space = kind == _SPACE
    final = space.copy()
    final[:-1] &= ~space[1:] & ~head[1:n]
    if n:
        final[-1] = False
    w = np.flatnonzero(final)
    new[w] = True
    new[w[points[w] == 32] + 1] = False
    # Contractions: only where an apostrophe starts a piece.
    ap = np.flatnonzero((points == 39) & new[:n])
    if len(ap):
        ends = text_at[np.searchsorted(text_at, ap, "right")]
        ext = np.concatenate([points, np.zeros(3, np.uint32)])
        one, two = ext[ap + 1], ext[ap + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & (ap + 2 <= ends)
        long = np.zeros(len(ap), bool)
        for x in ("re", "ve", "ll"):
            long |= (one == ord(x[0])) & (two == ord(x[1]))
        long &= ap + 3 <= ends
        size = np.where(short, 2, np.where(long, 3, 0))
        for i, k in zip(ap[size > 0].tolist(), size[size > 0].tolist(), strict=True):
            new[i + 1 : i + k] = False
            new[i + k] = True
    cut = np.flatnonzero(new[:n])
    return lead[cut], np.searchsorted(lead[cut], off)


class Encoder:
    """Encodes slices of texts; keeps the ids of pieces that it has met."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(v.special, key=len, reverse=True)).encode()) if v.special else None
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros((0, 2), np.uint64)
        self.begins, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def pieces(self, raw: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, and the first id of each text."""
        buf = tx.padded(np.frombuffer(raw, np.uint8))
        starts, first = split_pieces(buf, off, raw)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        lens = np.diff(np.append(starts, off[-1]))
        a, b = tx.hash_spans(buf, starts, lens, 1), tx.hash_spans(buf, starts, lens, 2)
        uniq, at, inv = np.unique(a, return_index=True, return_inverse=True)
        if not (b[at][inv] == b).all():
            raise RuntimeError("two pieces have one hash")
        if len(self.known) + len(uniq) > KEPT_PIECES:
            self.clear()
        pos = np.searchsorted(self.known[:, 0], uniq)
        pos[pos == len(self.known)] = 0
        have = (self.known[pos, 0] == uniq) & (self.known[pos, 1] == b[at]) if len(self.known) else np.zeros(len(uniq), bool)
        if not have.all():
            self._learn(buf, starts[at[~have]], lens[at[~have]], uniq[~have], b[at[~have]])
            pos = np.searchsorted(self.known[:, 0], uniq)
        count = self.counts[pos][inv].astype(np.int64)
        begin = self.begins[pos][inv]
        done = np.cumsum(count)
        step = np.arange(int(done[-1])) - np.repeat(done - count, count)
        ids = self.ids[np.repeat(begin, count) + step].astype(np.int64)
        return ids, np.concatenate([[0], done])[first]

    def _learn(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        step = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        symbols = self.v.byte_id[buf[np.repeat(starts, lens) + step]]
        ids, piece = merge_all(self.v, symbols, np.repeat(np.arange(len(starts)), lens))
        counts = np.bincount(piece, minlength=len(starts))
        begins = np.cumsum(counts) - counts + len(self.ids)
        at = np.searchsorted(self.known[:, 0], a)  # a is sorted, as are the known hashes
        self.known = np.insert(self.known, at, np.stack([a, b], 1), axis=0)
        self.begins, self.counts = np.insert(self.begins, at, begins), np.insert(self.counts, at, counts.astype(np.int32))
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow column, and where each text's ids begin (len + 1)."""
        view, off = tx.utf8(col)
        raw = view.tobytes()
        found = list(self.special.finditer(raw)) if self.special else []
        if not found:
            return self.pieces(raw, off)
        # Texts are cut around special tokens; each part is encoded by itself.
        cuts, body, owner, marks = [0], [], [], {}
        at = 0
        for i in range(len(off) - 1):
            a, z = int(off[i]), int(off[i + 1])
            while at < len(found) and found[at].start() < z:
                m = found[at]
                at += 1
                if m.start() < a or m.end() > z:
                    continue
                body.append(raw[a : m.start()])
                owner.append(i)
                marks[len(body) - 1] = self.v.special[m.group().decode()]
                a = m.end()
            body.append(raw[a:z])
            owner.append(i)
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in body])]).astype(np.int64)
        ids, first = self.pieces(b"".join(body), cuts)
        parts, sizes = [], np.zeros(len(off) - 1, np.int64)
        for k, i in enumerate(owner):
            part = ids[first[k] : first[k + 1]]
            if k in marks:
                part = np.append(part, marks[k])
            parts.append(part)
            sizes[i] += len(part)
        return (np.concatenate(parts) if parts else ids), np.concatenate([[0], np.cumsum(sizes)])


_encoders: dict[str, Encoder] = {}


def encoder(name: str, path: str) -> Encoder:
    """This worker's encoder of a vocabulary file that the driver has shipped by addFile, or of a local path."""
    if name not in _encoders:
        with open(path or SparkFiles.get(name), encoding="utf-8") as f:
            _encoders[name] = Encoder(Vocabulary(f.read()))
    return _encoders[name]


def ship(df: DataFrame, path: str) -> str:
    """Sends a vocabulary file to all executors (also those that start later); returns its name there."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """Ids of each text (where wanted), their count and hash, and the hash of the text decoded from them."""
    name = ship(docs, path)

    def run(col: pa.Array) -> dict:
        enc = encoder(name, "")
        ids, first = enc.encode(col)
        flat = ids.astype("<u4")
        n = len(first) - 1
        whole = enc.v.decode(ids)
        byte_at = np.concatenate([[0], np.cumsum(enc.v.token_len[ids])])[first]
        out: dict = {"n_tokens": np.diff(first).astype(np.int64)}
        out["ids_sha256"] = pa.array([hashlib.sha256(flat[first[i] : first[i + 1]].tobytes()).hexdigest() for i in range(n)], pa.string())
        out["decoded_sha256"] = pa.array([hashlib.sha256(_valid(whole[byte_at[i] : byte_at[i + 1]])).hexdigest() for i in range(n)], pa.string())
        if with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return out

    return tx.map_texts(docs, text, list(keep), "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""), run, SLICE)


def _valid(b: bytes) -> bytes:
    """Bytes of the text that a lossy UTF-8 reading of b gives."""
    try:
        b.decode("utf-8")
        return b
    except UnicodeDecodeError:
        return b.decode("utf-8", "replace").encode("utf-8")


def decode_ids(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The texts of arrays of ids (null: empty)."""
    name = ship(df, path)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def run(batches):
        for batch in batches:
            v = encoder(name, "").v
            texts = [_valid(v.decode(np.asarray(x or [], np.int64))).decode() for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return df.select(*keep, df[ids].alias("_ids_")).mapInArrow(run, f"{ddl}, text string")


def crc(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
