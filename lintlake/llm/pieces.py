"""Encoding and decoding with a SentencePiece BPE model by suffix-array matching.

Texts are cut where no piece can reach across: before a run of word marks, and around line feeds when no piece holds
one. Distinct segments of a batch that are not known yet are concatenated and indexed together:

1. a suffix array of the concatenation, ordered by as many characters as the longest piece has;
2. every piece is binary-searched in it: its range of suffixes are its occurrences;
3. the occurrences are edges (position, length, piece), sorted by position;
4. relaxation. The model is a BPE one, so the ids it wants are not those of a best-sum path; edges are relaxed in the
   model's own order: in each segment, again and again, the best-scored edge that spans two neighbouring symbols (of
   equals the leftmost) joins them. All segments take a step together.

A character that no piece covers falls back to its bytes. Results equal the sentencepiece library's; tests hold them to it.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lintlake.llm.common import pick, ready, regroup
from lintlake.llm.tokens import tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Segments kept per worker, and characters indexed at once.
KEPT, INDEXED = 400_000, 1 << 18
#: Segments over this many characters are cut at neighbours that no piece holds, and relaxed with a heap.
LONG = 256
_NONE = np.int32(1 << 30)


class PieceModel:
    """The pieces of a model file, as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = np.array(plain, np.int32)
        self.longest = max(len(self.names[i]) for i in plain)
        scores = np.array([sp.get_score(i) for i in range(n)])
        _, rank = np.unique(-scores, return_inverse=True)
        self.rank = rank.astype(np.int32)  # equal scores share a rank
        self.single = {self.names[i]: i for i in plain if len(self.names[i]) == 1}
        bodies = [self.names[i] for i in plain]
        self.chars = "".join(bodies)
        inner = any(MARK in b.lstrip(MARK) for b in bodies)
        feed = "\n" in self.chars
        pairs = {ord(x) << 21 | ord(y) for b in bodies for x, y in zip(b, b[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.cut = None if inner else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if feed else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall
        probe = " Ab  c\té  x\n"
        self.plain_rules = sp.normalize(probe) == self._mark(probe) if hasattr(sp, "normalize") else True
        self.sp = sp
        self.bytes_of = [self._bytes(i) for i in range(n)]
        lengths = np.array([len(b) for b in bodies], np.int64)
        self.by_length = {int(k): self.ids[lengths == k] for k in np.unique(lengths)}
        self.codes = {k: np.array([[ord(c) for c in self.names[i]] for i in v], np.int64) for k, v in self.by_length.items()}

    def _mark(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def split(self, segment: str) -> list[str]:
        """The segment cut between neighbouring characters that stand together in no piece: nothing is ever joined across."""
        codes = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        cuts = (np.flatnonzero(~np.isin(codes[:-1] << 21 | codes[1:], self.pairs)) + 1).tolist()
        return [segment[a:b] for a, b in zip([0, *cuts], [*cuts, len(segment)], strict=True)]

    def normal(self, text: str) -> str:
        """The text as the pieces see it: blanks as marks, one in front."""
        return self._mark(text) if self.plain_rules else self.sp.normalize(text)

    def _bytes(self, i: int) -> bytes:
        if self.sp.is_byte(i):
            return bytes([int(self.names[i][3:5], 16)])
        if self.sp.is_control(i):
            return b""
        return " ⁇ ".encode() if self.sp.is_unknown(i) else self.names[i].replace(MARK, " ").encode()

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class SuffixIndex:
    """Suffixes of a text of code points, ordered by their first `depth` characters (0 ends a segment and never matches)."""

    def __init__(self, body: np.ndarray, depth: int):
        self.alphabet, ranks = np.unique(body, return_inverse=True)
        if self.alphabet[0] != 0:
            raise ValueError("segments end with 0")
        self.bits = max(1, int(len(self.alphabet)).bit_length())
        self.per = 62 // self.bits
        keys = -(-depth // self.per)
        padded = np.r_[ranks.astype(np.int64), np.zeros(keys * self.per, np.int64)]
        n = len(body)
        self.keys = []
        for k in range(keys):
            key = np.zeros(n, np.int64)
            for j in range(self.per):
                key = key << self.bits | padded[k * self.per + j : k * self.per + j + n]
            self.keys.append(key)
        self.order = np.lexsort(self.keys[::-1]) if keys > 1 else np.argsort(self.keys[0], kind="stable")
        self.keys = [key[self.order] for key in self.keys]

    def ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of code points of one length: where their occurrences lie in `order`."""
        at = np.searchsorted(self.alphabet, codes)
        there = (at < len(self.alphabet)) & (self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == codes)
        known = there.all(axis=1)
        at, rows = at[known].astype(np.int64), np.flatnonzero(known)
        lo, hi = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        width = codes.shape[1]
        low, high = self._pack(at[:, : self.per])
        a, b = np.searchsorted(self.keys[0], low, "left"), np.searchsorted(self.keys[0], high, "right")
        if width > self.per:
            for k in range(1, -(-width // self.per)):
                low, high = self._pack(at[:, k * self.per : (k + 1) * self.per])
                for r in np.flatnonzero(b > a).tolist():
                    part = self.keys[k][a[r] : b[r]]
                    a[r], b[r] = a[r] + np.searchsorted(part, low[r], "left"), a[r] + np.searchsorted(part, high[r], "right")
        lo[rows], hi[rows] = a, b
        return lo, hi

    def _pack(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.zeros(len(at), np.int64)
        for j in range(at.shape[1]):
            low = low << self.bits | at[:, j]
        rest = self.bits * (self.per - at.shape[1])
        return low << rest, (low + 1 << rest) - 1


def edges(model: PieceModel, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every occurrence of every piece in body: position, length, id; sorted by position."""
    index = SuffixIndex(body, model.longest)
    pos, length, ids = [], [], []
    for k, codes in model.codes.items():
        lo, hi = index.ranges(codes)
        n = hi - lo
        take = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pos.append(index.order[take])
        length.append(np.full(len(take), k, np.int32))
        ids.append(np.repeat(model.by_length[k], n))
    pos, length, ids = np.concatenate(pos), np.concatenate(length), np.concatenate(ids)
    order = np.argsort(pos, kind="stable")
    return pos[order], length[order], ids[order]


def encode_segments(model: PieceModel, segments: list[str]) -> list[bytes]:
    """Ids of each segment, as little-endian 32-bit bytes."""
    sizes = np.array([len(s) for s in segments], np.int64)
    body = np.frombuffer("\0".join([*segments, ""]).encode("utf-32-le"), "<u4").astype(np.int64)
    pos, length, ids = edges(model, body)
    wide = model.longest + 1
    table = np.full((len(body), wide), -1, np.int32)  # id of the edge at a position, by length
    table[pos, length] = ids
    first = np.cumsum(sizes + 1) - sizes - 1
    out: list[bytes] = [b""] * len(segments)
    order = np.argsort(sizes, kind="stable")
    cuts = [0]
    while cuts[-1] < len(order):  # segments of like size step together
        s = max(int(sizes[order[cuts[-1]]]), 1)
        cuts.append(int(np.searchsorted(sizes[order], max(s + s // 4, s), "right")))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[a:b]
        if sizes[rows[0]] > LONG:
            for row in rows.tolist():
                out[row] = _relax_long(model, table, body, int(first[row]), int(sizes[row]))
            continue
        _relax(model, table, body, first[rows], sizes[rows], rows, out)
    return out


def _relax(model: PieceModel, table: np.ndarray, body: np.ndarray, first: np.ndarray, size: np.ndarray, rows: np.ndarray, out: list[bytes]) -> None:
    n, most = len(first), int(size.max())
    if not most:
        return
    here = np.arange(most, dtype=np.int32)
    nxt = np.broadcast_to(here + 1, (n, most)).astype(np.int32)
    prv = np.broadcast_to(here - 1, (n, most)).astype(np.int32)
    nxt = np.pad(nxt, ((0, 0), (0, 1)), constant_values=most + 1)
    prv = np.pad(prv, ((0, 0), (0, 1)), constant_values=most - 1)
    wide = model.longest

    def rank(r: np.ndarray, i: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Rank of the piece from i to e in segments r; none: _NONE."""
        span = e - i
        ok = (span <= wide) & (e <= size[r]) & (i >= 0)
        at = np.full(len(r), -1, np.int32)
        k = np.flatnonzero(ok)
        at[k] = table[first[r[k]] + i[k], span[k]]
        return np.where(at >= 0, model.rank[at], _NONE)

    pair = np.full((n, most + 1), _NONE, np.int32)
    every = np.repeat(np.arange(n), most)
    i = np.tile(here, n)
    pair[:, :most] = rank(every, i, i + 2).reshape(n, most)
    live = np.arange(n)
    while len(live):
        j = pair[live].argmin(axis=1)
        good = pair[live, j] < _NONE
        live, j = live[good], j[good].astype(np.int32)
        if not len(live):
            break
        k = nxt[live, j]  # the symbol that is taken in
        e = nxt[live, k]
        nxt[live, j] = e
        inside = e < size[live]
        prv[live[inside], e[inside]] = j[inside]
        pair[live, k] = _NONE
        pair[live, j] = _NONE
        r = live[inside]
        pair[r, j[inside]] = rank(r, j[inside], nxt[r, e[inside]])
        p = prv[live, j]
        left = p >= 0
        pair[live[left], p[left]] = rank(live[left], p[left], e[left])
    # symbols that are left: follow the links from each segment's first
    starts = np.zeros((n, most), bool)
    now, at = np.arange(n), np.zeros(n, np.int32)
    while len(now):
        starts[now, at] = True
        at = nxt[now, at]
        go = at < size[now]
        now, at = now[go], at[go]
    r, i = np.nonzero(starts)
    ids = table[first[r] + i, nxt[r, i] - i]
    if (ids < 0).any():  # no piece: a single character by its bytes
        parts = [[int(x)] if x >= 0 else [model.byte_ids.get(b, model.unknown) for b in chr(int(body[first[q] + c])).encode("utf-8", "surrogatepass")] if model.byte_ids else [model.unknown] for x, q, c in zip(ids, r, i, strict=True)]
        r = np.repeat(r, [len(p) for p in parts])
        ids = np.array([x for p in parts for x in p], np.int32)
    flat, ends = ids.astype("<i4").tobytes(), np.cumsum(np.bincount(r, minlength=n)) * 4
    begin = 0
    for row, end in zip(rows.tolist(), ends.tolist(), strict=True):
        out[row] = flat[begin:end]
        begin = end


def _relax_long(model: PieceModel, table: np.ndarray, body: np.ndarray, first: int, size: int) -> bytes:
    """The same relaxation for one long segment, with a heap of (rank, position): near-linear in its length."""
    nxt, prv = list(range(1, size + 2)), list(range(-1, size))
    rank, wide = model.rank, model.longest
    heap: list[tuple[int, int, int]] = []

    def offer(i: int, e: int) -> None:
        if e - i <= wide and (k := int(table[first + i, e - i])) >= 0:
            heapq.heappush(heap, (int(rank[k]), i, e))

    for i in range(size - 1):
        offer(i, i + 2)
    gone = bytearray(size + 1)
    while heap:
        _, i, e = heapq.heappop(heap)
        if gone[i] or nxt[i] >= size or nxt[nxt[i]] != e:
            continue
        gone[nxt[i]] = 1
        nxt[i] = e
        if e < size:
            prv[e] = i
            offer(i, nxt[e])
        if prv[i] >= 0:
            offer(prv[i], e)
    ids, i = [], 0
    while i < size:
        k = int(table[first + i, nxt[i] - i])
        if k >= 0:
            ids.append(k)
        else:
            ids += [model.byte_ids.get(b, model.unknown) for b in chr(int(body[first + i])).encode("utf-8", "surrogatepass")] if model.byte_ids else [model.unknown]
        i = nxt[i]
    return np.array(ids, "<i4").tobytes()


class PieceEncoder:
    """Ids of whole texts; segments that repeat are matched once a worker."""

    def __init__(self, path: str):
        self.model, self.store = PieceModel(path), {}

    def encode(self, texts: list[str]) -> list[bytes]:
        model, store = self.model, self.store
        cut = [model.cut(model.normal(t)) if model.cut else [model.normal(t)] for t in texts]
        cut = [[p for w in c for p in (model.split(w) if len(w) > LONG else (w,))] if max(map(len, c), default=0) > LONG else c for c in cut]
        if len(store) > KEPT:
            for w in [w for w, _ in zip(store, range(KEPT // 2), strict=False)]:
                del store[w]
        new = [w for w in dict.fromkeys(w for c in cut for w in c if w not in store)]
        at = 0
        while at < len(new):
            end, held = at, 0
            while end < len(new) and (held == 0 or held + len(new[end]) < INDEXED):
                held += len(new[end]) + 1
                end += 1
            store.update(zip(new[at:end], encode_segments(model, new[at:end]), strict=True))
            at = end
        get = store.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        for w in new:  # whole texts without blanks are not kept
            if len(w) > LONG:
                del store[w]
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in regroup(batches, 2 << 20):
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = []
            for t, ids in zip(texts, enc.encode(texts), strict=True):
                back = enc.model.decode(np.frombuffer(ids, "<i4"))
                rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == t))
            n, crc, sha, same = zip(*rows, strict=True)
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names=["id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"])

    return run


def piece_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row per row of docs: id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the text decoded from them), round_trip (whether it is the text).

    Null and empty texts have no pieces. A text that holds the word mark itself decodes to a blank there. Repeated rows
    give repeated results; an empty table none; other columns are ignored.
    """
    ready(docs.sparkSession)
    schema = "id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return pick(docs, id_col, text_col).mapInArrow(_encode(model or tokenizer_path(MODEL)), schema).withColumnRenamed("id", id_col)
