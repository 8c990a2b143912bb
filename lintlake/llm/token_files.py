"""Token-id files compressed by Re-Pair.

File format: a folder of Parquet files; each row is a shard that is decoded on its own. Shards lie in ascending order of
document id: `part`, then `seq`. A shard holds

    part, seq, before      place, and ids of the part in front of it
    n_ids                  ids in it
    doc_ids, doc_sizes     its documents in order and the ids of each (end id included)
    base                   first nonterminal; below it a symbol is an id
    rules                  little-endian int32 pairs: nonterminal base + k stands for the two symbols of pair k
    sizes                  little-endian int32: ids that nonterminal base + k expands to
    symbols                little-endian int32: the compressed sequence

Re-Pair: the most frequent pairs of adjacent symbols are replaced by new nonterminals, again and again, until no pair
occurs `least` times. Pairs are counted in batches: a round takes all pairs that occur at least a quarter as often as
the round before demanded, so a shard needs about as many rounds as its top count has digits by 4. Where candidates overlap, the more
frequent one is replaced, then the left one. Any range of ids is decoded from the symbols that cover it: a search in the
running expansion sizes finds them.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.llm.common import pick, ready, regroup, shared_dir, tasks
from lintlake.llm.tokens import encoder, places, tokenizer_path

BASE = 1 << 20
SHARD_IDS = 1 << 21
#: A rule takes three numbers, so pairs that occur less often than this gain nothing.
LEAST = 4
_SLOTS = 18

FORMAT = "part int, seq int, before long, n_ids long, doc_ids array<long>, doc_sizes array<long>, base int, rules binary, sizes binary, symbols binary"


@dataclass
class Grammar:
    """A Re-Pair grammar: symbols, and rule k as (left, right) with the size it expands to."""

    base: int
    rules: np.ndarray
    sizes: np.ndarray
    symbols: np.ndarray
    _flat: tuple[np.ndarray, np.ndarray] | None = None

    def _size_of(self, s: np.ndarray) -> np.ndarray:
        return np.where(s >= self.base, self.sizes[np.maximum(s - self.base, 0)], 1) if len(self.sizes) else np.ones(len(s), np.int64)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rules one after another, and where each rule's begin. Rules are opened once, those whose parts are ready at a time."""
        if self._flat is None:
            begin = np.cumsum(self.sizes) - self.sizes
            out = np.empty(int(self.sizes.sum()), np.uint32)
            to = np.stack([begin, begin + self._size_of(self.rules[:, 0])], axis=1).ravel()
            part = self.rules.ravel()
            plain = part < self.base
            out[to[plain]] = part[plain]
            child = np.where(self.rules >= self.base, self.rules - self.base, -1)
            depth = np.zeros(len(self.rules) + 1, np.int64)  # the last stands for ids
            while (more := np.r_[1 + depth[child].max(axis=1), 0]).tobytes() != depth.tobytes():
                depth = more
            level = np.repeat(depth[:-1], 2)
            for d in range(2, int(depth.max()) + 1):
                at = np.flatnonzero((level == d) & ~plain)
                rule = part[at] - self.base
                out[places(to[at], self.sizes[rule])] = out[places(begin[rule], self.sizes[rule])]
            self._flat = out, begin
        return self._flat

    def expand(self, s: np.ndarray) -> np.ndarray:
        """Ids of the symbols."""
        if not len(self.rules):
            return s.astype(np.uint32)
        flat, begin = self.flat()
        single = s < self.base
        body = np.r_[flat, s[single].astype(np.uint32)]
        at = np.empty(len(s), np.int64)  # where the ids of each symbol begin in body
        at[single] = len(flat) + np.arange(len(body) - len(flat))
        at[~single] = begin[s[~single] - self.base]
        return body[places(at, self._size_of(s))]

    def slice(self, start: int, n: int, ends: np.ndarray | None = None) -> np.ndarray:
        """ids[start : start + n] without decoding the rest. ends: self.ends(), when many slices are taken."""
        ends = self.ends() if ends is None else ends
        i = int(np.searchsorted(ends, start, "right"))
        j = int(np.searchsorted(ends, start + n, "left"))
        skip = start - (int(ends[i - 1]) if i else 0)
        return self.expand(self.symbols[i : j + 1])[skip : skip + n]

    def ends(self) -> np.ndarray:
        return np.cumsum(self._size_of(self.symbols))


def _slots(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """A number below 2**bits for each pair; equal pairs have equal ones."""
    return ((left.view(np.uint32) * np.uint32(2654435769) ^ right.view(np.uint32) * np.uint32(2246822519)) >> np.uint32(32 - bits)).astype(np.intp)


def _without(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """s without the places that follow those of `at`."""
    if len(at) < 2000:
        cuts = (at + 1).tolist()
        return np.concatenate([s[i:j] for i, j in zip([0, *[i + 1 for i in cuts]], [*cuts, len(s)], strict=True)])
    stay = np.ones(len(s), bool)
    stay[at + 1] = False
    return s[stay]


def re_pair(ids: np.ndarray, base: int = BASE, least: int = LEAST) -> Grammar:
    """Compresses a shard's ids (all below base) until no pair occurs `least` times."""
    if len(ids) and int(ids.max()) >= base:
        raise ValueError(f"token id {int(ids.max())} does not lie below {base}, where nonterminals begin")
    s = ids.astype(np.int32)
    rules, sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
    have, number = rules, rules  # the rules in ascending order, and their nonterminals
    ask = 0
    look = None  # once a round was made at `least`: the places where a pair can occur so often
    while len(s) > 1:
        if look is None:
            bits = _SLOTS if ask == 0 or ask > 64 else _SLOTS + 3  # rarer pairs need more slots to be told from chance
            slot = _slots(s[:-1], s[1:], bits)
            per = np.bincount(slot, minlength=1 << bits)
            top = int(per.max())
            ask = max(least, (min(ask, top) or top) // 4)
            if top < least:
                break
            at = np.flatnonzero((per >= ask)[slot])
        else:  # any other pair was too rare then, and no pair of old symbols has become more frequent
            at = look
            if len(at) > 1 << 14:
                slot = _slots(s[at], s[at + 1], _SLOTS + 2)
                at = at[(np.bincount(slot, minlength=1 << _SLOTS + 2) >= ask)[slot]]
        keys = s[at].astype(np.int64) << 32 | s[at + 1]
        grouped = pa.array(keys).dictionary_encode()  # by hash, in order of first places
        pairs, which = grouped.dictionary.to_numpy(), grouped.indices.to_numpy()
        n = np.bincount(which, minlength=len(pairs))
        use = (n >= ask)[which]
        if not use.any():
            if ask == least:
                break
            continue
        at, which = at[use], which[use]
        n = n[which]
        meets = at[1:] == at[:-1] + 1  # the next candidate begins where this one ends
        left, right = np.r_[0, n[:-1] * meets], np.r_[n[1:] * meets, 0]
        begins = np.r_[True, ~meets | (n[1:] != n[:-1])]  # of level stretches: every other pair of one is kept
        first = np.flatnonzero(begins)[np.cumsum(begins) - 1]
        keep = ((at - at[first]) % 2 == 0) & (n > left[first]) & (n >= right)
        missed = at[~keep]
        at, which = at[keep], which[keep]
        before = base + len(rules)
        taken = np.flatnonzero(np.bincount(which, minlength=len(pairs)))
        asked = pairs[taken]
        place = np.searchsorted(have, asked)
        old = np.r_[have, -1][place] == asked
        names = np.r_[number, 0][place]
        if not old.all():
            new = asked[~old]
            names[~old] = before + np.arange(len(new))
            order = np.argsort(new)
            to = place[~old][order]
            have, number = np.insert(have, to, new[order]), np.insert(number, to, before + order)
            known = np.r_[sizes, 1]  # the last stands for ids
            sizes = np.r_[sizes, known[np.maximum((new >> 32) - base, -1)] + known[np.maximum((new & 0xFFFFFFFF) - base, -1)]]
            rules = np.r_[rules, new]
        symbol = np.zeros(len(pairs), np.int32)
        symbol[taken] = names
        put = symbol[which]
        s[at] = put
        if ask == least:
            touched = at[put >= before]
            again = names[old]
            if len(again):  # rules of earlier rounds that this one used again
                used = np.zeros(before, bool)
                used[again] = True
                touched = np.r_[touched, np.flatnonzero(np.take(used, s, mode="clip") & (s < before))]
            gone = at + 1

            def moved(p: np.ndarray, gone: np.ndarray = gone) -> np.ndarray:
                """Where the places that stay come to lie."""
                k = np.searchsorted(gone, p)
                stay = np.r_[gone, -1][k] != p
                return (p - k)[stay]

            s = _without(s, at)
            near = np.zeros(len(s) + 1, bool)
            touched = moved(touched)
            near[touched] = near[touched - 1] = near[moved(missed)] = True
            look = np.flatnonzero(near[: len(s) - 1])
        else:
            s = _without(s, at)
    return Grammar(base, np.stack([rules >> 32, rules & 0xFFFFFFFF], axis=1), sizes, s)


def _shards(path: str, end: int, shard_ids: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words, tail = TaskContext.get().partitionId(), encoder(path), int(end).to_bytes(4, "little")
        names: list = []
        bodies: list[bytes] = []
        seq = before = held = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(bodies), "<u4")
            g = re_pair(ids, least=least)
            row = (part, seq, before, len(ids), names, [len(b) // 4 for b in bodies], g.base, g.rules.astype("<i4").tobytes(), g.sizes.astype("<i4").tobytes(), g.symbols.astype("<i4").tobytes())
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["part", "seq", "before", "n_ids", "doc_ids", "doc_sizes", "base", "rules", "sizes", "symbols"])

        for b in regroup(batches, 4 << 20):
            for i, ids in zip(b.column(0).to_pylist(), words.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                names.append(i)
                bodies.append(ids + tail)
                held += len(ids) // 4 + 1
                if held >= shard_ids:
                    yield close()
                    seq, before, held, names, bodies = seq + 1, before + held, 0, [], []
        if bodies:
            yield close()

    return run


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS, least: int = LEAST) -> None:
    """Encodes docs and writes them to the folder in the format above, in ascending id order (null ids first; rows of one id by the first characters of their text, by a hash of it, and as they lie, so that several tasks can share them)."""
    spark = ready(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    order = (F.col(f"`{id_col}`").asc_nulls_first(), F.substring(text, 1, 64).asc_nulls_first(), F.xxhash64(text).asc(), F.col("_row").asc())
    rows = pick(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    ranged = pick(rows.repartitionByRange(tasks(spark, docs), *order).sortWithinPartitions(*order), id_col, text_col)
    shards = ranged.mapInArrow(_shards(tokenizer or tokenizer_path(), end_id, shard_ids, least), FORMAT)
    shards.write.option("compression", "zstd").parquet(path)


def grammar(base: int, rules: bytes, sizes: bytes, symbols: bytes) -> Grammar:
    return Grammar(base, np.frombuffer(rules, "<i4").astype(np.int64).reshape(-1, 2), np.frombuffer(sizes, "<i4").astype(np.int64), np.frombuffer(symbols, "<i4"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.to_pylist():
            g = grammar(x["base"], x["rules"], x["sizes"], x["symbols"])
            sizes = np.array(x["doc_sizes"], np.int64)
            starts = np.cumsum(sizes) - sizes
            body = memoryview(g.expand(g.symbols).astype("<u4", copy=False).tobytes())
            crc = [zlib.crc32(body[4 * i : 4 * (i + n)]) for i, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
            yield pa.record_batch([pa.array(x["doc_ids"], pa.int64()), pa.array(x["offset"] + x["before"] + starts), pa.array(sizes), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document, decoded from the files shard by shard; fetch() decodes single ones."""
    ready(spark)
    shards = spark.read.schema(FORMAT).parquet(path)
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each writing task
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))
    out = shards.join(F.broadcast(parts), "part").select("offset", "before", "doc_ids", "doc_sizes", "base", "rules", "sizes", "symbols")
    return out.mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def fetch(spark: SparkSession, path: str, wanted: list[int], id_col: str = "doc_id") -> DataFrame:
    """id, ids (array of long) of the wanted documents: only shards that hold one are read, and of each only the symbols that cover it are opened. A document that was written more than once comes as often; null ids cannot be asked for."""
    ready(spark)
    shards = spark.read.schema(FORMAT).parquet(path)
    held = shards.filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(i) for i in wanted]).cast("array<long>"))) if wanted else shards.filter("false")
    asked = frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                g = grammar(x["base"], x["rules"], x["sizes"], x["symbols"])
                ends, start, out = g.ends(), 0, []
                for i, n in zip(x["doc_ids"], x["doc_sizes"], strict=True):
                    if i in asked:
                        out.append((i, g.slice(start, n, ends).tolist()))
                    start += n
                cols = zip(*out, strict=True)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int64())), strict=True)], names=["id", "ids"])

    return held.select("doc_ids", "doc_sizes", "base", "rules", "sizes", "symbols").mapInArrow(run, "id long, ids array<long>").withColumnRenamed("id", id_col)


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Writes docs to a new folder of the shared one and reads them back.

    Null and empty texts are the end id alone. Repeated rows are written as often as they come. An empty table makes an
    empty folder and no rows. Other columns are ignored.
    """
    path = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, id_col, text_col, **options)
    return read_token_files(docs.sparkSession, path, id_col)
