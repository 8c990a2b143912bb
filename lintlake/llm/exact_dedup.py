"""Exact dedup over an extendible-hash index on shared files.

1. Each scan task folds equal texts it meets (byte comparison) into one row, so a text that is copied millions of times
   leaves a task once for every FOLD_BYTES of other texts. Where every document needs an answer, the folded texts and the
   documents folded into them are written to the shared folder first, so that their numbers stay what they are.
2. Owner tasks get the folded rows by ranges of the 64-bit key, in ascending order. Each row goes through the owner's
   directory to its bucket and there along the chain of its key, where bytes are compared: equal bytes join an entry,
   other bytes that share the key begin one of their own. An overfull bucket splits, doubling the directory when the
   bucket is as deep as it.
3. As keys ascend, a bucket that they have passed is complete: its entries leave for the index's file and its bytes are
   forgotten, so an owner holds one open bucket, however many rows it has.
4. An entry names the folded texts that found it; documents get its answer through theirs.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import SPACES, pick, ready, regroup, tasks, written

BUCKET_ENTRIES = 512
#: A bucket this deep takes what comes: keys that agree in so many bits would double the directory for nothing.
DEEPEST = 22
#: What a folding task holds: texts, and the documents behind them.
FOLD_BYTES, FOLD_ROWS = 8 << 20, 1 << 16
#: Input bytes, as they lie in files, for each owner beyond those that the session's shuffles have.
OWNER_BYTES = 64 << 20
#: Folded texts that one row of the index names; an entry with more has further rows.
NAMED = 4096
_WORD = 1 << 64


def normal(text: bytes) -> bytes:
    """The text without its white space; UTF-8 keeps ASCII bytes to ASCII characters, so deleting bytes deletes characters."""
    return text.translate(None, SPACES)


def _signed(x: int) -> int:
    return x - _WORD if x >> 63 else x


def rank(chars: int, doc: int | None, handle: int) -> tuple:
    """The order of equal texts: most code points first, then the smallest id (null ids last), then the row met first."""
    return -chars, doc is None, doc or 0, handle


class Entry:
    """A distinct text: its best row, its rows, and the folded texts that found it."""

    __slots__ = ("best", "body", "folds", "n", "row")

    def __init__(self, body: bytes):
        self.body, self.best, self.row, self.n, self.folds = body, None, None, 0, array("q")


class Bucket:
    __slots__ = ("chains", "depth", "first")

    def __init__(self, depth: int, first: int):
        self.depth, self.first, self.chains = depth, first, {}


class ExtendibleHash:
    """Directory of 2**depth slots over a 64-bit key's high bits; a slot names a bucket, a bucket holds keys and their chains.

    A bucket with more than `capacity` distinct keys splits on its next bit; entries that share a key are chained in one
    bucket and never force a split. A bucket's `first` is the smallest key that belongs to it.
    """

    def __init__(self, capacity: int = BUCKET_ENTRIES):
        self.capacity, self.depth = capacity, 0
        self.directory: list[Bucket | None] = [Bucket(0, 0)]
        self.done = 0  # slots that completed() has emptied

    def bucket(self, key: int) -> Bucket | None:
        return self.directory[key >> (64 - self.depth)]

    def find(self, key: int, body: bytes) -> Entry | None:
        held = self.bucket(key)
        return next((e for e in held.chains.get(key, ()) if e.body == body), None) if held else None

    def put(self, key: int, body: bytes) -> Entry:
        """The entry of these bytes, a new one at the end of the key's chain if they are not there."""
        held = self.bucket(key)
        chain = held.chains.setdefault(key, [])
        for e in chain:
            if e.body == body:
                return e
        chain.append(entry := Entry(body))
        while len(held.chains) > self.capacity and held.depth < DEEPEST:
            self._split(held)
            held = self.bucket(key)
        return entry

    def _split(self, held: Bucket) -> None:
        if held.depth == self.depth:
            self.directory = [b for b in self.directory for _ in (0, 1)]
            self.depth += 1
            self.done *= 2
        bit = 63 - held.depth
        held.depth += 1
        high = Bucket(held.depth, held.first | 1 << bit)
        high.chains = {k: c for k, c in held.chains.items() if k >> bit & 1}
        held.chains = {k: c for k, c in held.chains.items() if not k >> bit & 1}
        at, wide = high.first >> (64 - self.depth), 1 << (self.depth - held.depth)
        self.directory[at : at + wide] = [high] * wide

    def completed(self, key: int | None) -> Iterator[Bucket]:
        """Buckets all of whose keys lie below `key` (all buckets for null), each once and in order; they are let go."""
        end = 1 << self.depth if key is None else key >> (64 - self.depth)
        if key is not None:  # not the bucket that the key is in
            end = self.directory[end].first >> (64 - self.depth)
        while self.done < end:
            held = self.directory[self.done]
            wide = 1 << (self.depth - held.depth)
            self.directory[self.done : self.done + wide] = [None] * wide
            self.done += wide
            yield held


FOLDED = "fold long, key long, body binary, chars long, id long, n long, handle long"


def _folds(batches: Iterator[pa.RecordBatch], at_id: int, at_text: int, members: bool, payload: bool) -> Iterator[pa.RecordBatch]:
    """Folded texts (FOLDED); members: after them a row (fold, id, handle) for every document; payload: with the whole best row of each text."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 40
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["fold", "key", "body", "chars", "id", "n", "handle"]
    held: dict[bytes, list] = {}
    kept: list[pa.RecordBatch] = []
    docs: list[tuple[int, int | None, int]] = []
    size = seen = folds = rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal folds
        bodies = list(held)
        best = [x[0] for x in held.values()]
        cols = [[x[2] for x in held.values()], [_signed(xxhash.xxh64_intdigest(b)) for b in bodies], bodies, [-b[0] for b in best], [None if b[1] else b[2] for b in best], [x[1] for x in held.values()], [b[3] for b in best]]
        out = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
        if payload:
            row = pa.Table.from_batches(kept).take(pa.array([x[3] for x in held.values()], pa.int64())).combine_chunks()
            out += [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in row.columns]
        yield pa.record_batch(out, names=names + [f"c{k}" for k in range(len(out) - len(names))])
        if members:
            nothing = [pa.nulls(len(docs), t) for t in types]
            for k, c in zip((0, 4, 6), zip(*docs, strict=True), strict=True):
                nothing[k] = pa.array(c, types[k])
            yield pa.record_batch(nothing, names=names)

    for b in regroup(batches, FOLD_BYTES):
        chars = pc.fill_null(pc.utf8_length(b.column(at_text)), 0).to_pylist()
        ids = b.column(at_id).cast(pa.int64()).to_pylist()
        if payload:
            kept.append(b)
            size += b.nbytes
        for i, n, t in zip(ids, chars, b.column(at_text).cast(pa.binary()).to_pylist(), strict=True):
            body, mine = normal(t or b""), rank(n, i, base + seen)
            if (old := held.get(body)) is None:
                held[body] = old = [mine, 1, base + folds, rows]
                folds += 1
                size += len(body) + 200
            else:
                old[1] += 1
                if mine < old[0]:
                    old[0], old[3] = mine, rows
            if members:
                docs.append((old[2], i, base + seen))
            seen += 1
            rows += 1
        if size > FOLD_BYTES or len(docs) > FOLD_ROWS:
            yield from flush()
            held, kept, docs, size, rows = {}, [], [], 0, 0
    if held:
        yield from flush()


INDEX = "owner int, bucket long, depth int, key long, chain int, part int, sha binary, keep_id long, keep_chars long, keep_handle long, group_size long, folds array<long>"


def _bounds(owner: int, owners: int) -> tuple[int, int]:
    """The keys (unsigned) of an owner: from, to. Owners divide the upper 24 bits."""
    return -(-owner * (1 << 24) // owners) << 40, -(-(owner + 1) * (1 << 24) // owners) << 40


def _by_part(rows: list[tuple[pa.RecordBatch, int]]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Rows (batch, place) by batch."""
    parts: dict[int, tuple[pa.RecordBatch, list[int]]] = {}
    for part, i in rows:
        parts.setdefault(id(part), (part, []))[1].append(i)
    yield from parts.values()


def _own(owners: int, capacity: int, payload: bool):
    """Owner tasks. Rows come by ascending key (unsigned)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        owner = TaskContext.get().partitionId()
        low, high = _bounds(owner, owners)
        index = ExtendibleHash(capacity)

        def entries(buckets: Iterator[Bucket]) -> Iterator[tuple[Bucket, int, int, Entry]]:
            for held in buckets:
                for key, chain in held.chains.items():
                    for place, e in enumerate(chain):
                        yield held, key, place, e

        def rows(found: list[tuple[Bucket, int, int, Entry]]) -> Iterator[pa.RecordBatch]:
            if payload:
                for part, at in _by_part([e.row for _, _, _, e in found]):
                    yield part.take(pa.array(at, pa.int64()))
                return
            out = []
            for held, key, place, e in found:
                sha = hashlib.sha256(e.body).digest()
                for part, i in enumerate(range(0, len(e.folds), NAMED)):
                    out.append((owner, held.first >> 1, held.depth, _signed(low - (-key * (high - low) // _WORD)), place, part, sha, None if e.best[1] else e.best[2], -e.best[0], e.best[3], e.n, e.folds[i : i + NAMED]))
            for i in range(0, len(out), 4096):
                cols = list(zip(*out[i : i + 4096], strict=True))
                types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["owner", "bucket", "depth", "key", "chain", "part", "sha", "keep_id", "keep_chars", "keep_handle", "group_size", "folds"])

        for b in batches:
            slot, better = None, {}
            for at, (fold, key, body, chars, doc, n, handle) in enumerate(zip(*[c.to_pylist() for c in b.columns[:7]], strict=True)):
                slot = ((key & _WORD - 1) - low) * _WORD // (high - low)  # the owner's range drawn out to 64 bits
                e = index.put(slot, body)
                mine = rank(chars, doc, handle)
                if e.best is None or mine < e.best:
                    e.best = mine
                    better[id(e)] = (e, at)
                e.n += n
                if not payload:
                    e.folds.append(fold)
            if payload and better:  # only the best rows stay, as copies, so a text that comes again and again holds one row
                part = pa.record_batch(b.columns[7:], names=b.schema.names[7:]).take(pa.array([i for _, i in better.values()], pa.int64()))
                for i, (e, _) in enumerate(better.values()):
                    e.row = (part, i)
            if slot is not None:
                yield from rows(list(entries(index.completed(slot))))
        yield from rows(list(entries(index.completed(None))))

    return run


def _owners(docs: DataFrame) -> int:
    """Owner tasks: as many as a shuffle has, and more where the input's files are larger than that many can take."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(tasks(docs.sparkSession), min(1 << 20, size // OWNER_BYTES if size < 1 << 60 else 0))


def _owned(folded: DataFrame, owners: int) -> DataFrame:
    """Folded rows at their owners, by ascending unsigned key."""
    owner = F.floor((F.shiftrightunsigned("key", 40).cast("double") * owners) / float(1 << 24)).cast("int")
    return folded.repartitionById(owners, owner).sortWithinPartitions(F.col("key") < 0, "key")


def fold(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The folded texts of docs (FOLDED), and (fold, id, handle) of every document in rows without a key; written to the shared folder."""
    ready(docs.sparkSession)
    return written(pick(docs, id_col, text_col).mapInArrow(lambda x: _folds(x, 0, 1, True, False), FOLDED), "exact-folded")


def build_index(folded: DataFrame, owners: int, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """The index over folded texts, written to the shared folder: one row per distinct text (more where it names over NAMED folds), in the order of its owner's buckets."""
    texts = _owned(folded.filter("key IS NOT NULL"), owners)
    return written(texts.mapInArrow(_own(owners, capacity, False), INDEX), "exact-index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they have the same bytes after their white space is deleted; null counts as empty, and all
    empty texts are one group. Of a group the row with most code points, then smallest id stays; a null id comes last.
    Of repeated rows (same id and same length, chosen to stay) exactly one is marked kept. An empty table gives none.
    Extra columns of docs are ignored. No key of a join holds more than FOLD_ROWS and a batch of documents, however often
    a text occurs.
    """
    folded = fold(docs, id_col, text_col)
    index = build_index(folded, _owners(docs), capacity)
    entry = index.select(F.explode("folds").alias("fold"), "keep_id", "keep_handle", "group_size", "sha")
    out = folded.filter("key IS NULL").select("fold", "id", "handle").join(entry, "fold")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("handle") == F.col("keep_handle")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """The rows of docs that exact_dedup marks kept, whole: the best row of each text travels with it to its owner and comes back from there, so neither repeated ids nor null ids matter."""
    ready(docs.sparkSession)
    names = docs.columns
    i, t, owners = names.index(id_col), names.index(text_col), _owners(docs)
    carried = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema))
    folded = docs.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(lambda x: _folds(x, i, t, False, True), f"{FOLDED}, {carried}")
    out = _owned(folded, owners).mapInArrow(_own(owners, capacity, True), carried)
    return out.toDF(*names)
