"""Best-fit packing of token sequences by bin completion.

Only lengths decide how well pieces pack, and a piece has 1 to `room` tokens; so the histogram of lengths (at most `room`
rows however large the table) holds the whole problem, and one branch-and-bound on it packs all documents of all shards
together. A filling found for one bin is used as often as its pieces last, so there are few distinct fillings (a small multiple of `room`).

Bin completion: the largest piece left opens a bin; undominated fillings of its rest (no other piece fits, and none whose
pieces fit into those of one tried before) are tried, those with least waste first, each as often as its pieces last and
then less often; a branch is cut when the waste so far leaves no chance of fewer bins than the incumbent. The first
incumbent is the better of best-fit decreasing and the first dive. The search ends at the lower bound, where all is tried, or after `nodes` steps (null:
never before it is done); `proved` tells whether fewer bins are known to be impossible. Pieces then find their place by
rank within their length, without any group of pieces meeting in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import pick, ready, regroup, written
from lintlake.llm.tokens import encoder, tokenizer_path

ROOM = 2048
#: Steps of the search before it settles for its incumbent: a documented bound, null for none.
NODES: int | None = 100_000
#: Fillings that are looked for first, in order of waste; all others follow.
WIDTH = 8

Filling = tuple[tuple[int, int], ...]  # (length, how often), longest first


def bound(counts: dict[int, int], room: int = ROOM) -> int:
    """Bins that no packing can do without: by total size, and by pieces that cannot share a bin (Martello and Toth's L2)."""
    best = -(-sum(k * n for k, n in counts.items()) // room)
    for low in sorted({min(k, room - k) for k in counts if k} | {0}):
        if low > room // 2:
            continue
        big = sum(n for k, n in counts.items() if k > room - low)
        mid = {k: n for k, n in counts.items() if room / 2 < k <= room - low}
        small = sum(k * n for k, n in counts.items() if low <= k <= room / 2)
        free = sum((room - k) * n for k, n in mid.items())
        best = max(best, big + sum(mid.values()) + max(0, -(-(small - free) // room)))
    return best


def _fits(items: list[int], rooms: list[int]) -> bool:
    """Whether items (longest first) can be put into rooms."""
    if not items:
        return True
    tried = set()
    for i, r in enumerate(rooms):
        if items[0] <= r and r not in tried:
            tried.add(r)
            if _fits(items[1:], [*rooms[:i], r - items[0], *rooms[i + 1 :]]):
                return True
    return False


def fillings(rest: int, left: dict[int, int], sizes: list[int], width: int = WIDTH) -> list[Filling]:
    """A first choice: up to `width` undominated fillings of `rest` with pieces of `left` (sizes: its lengths in ascending order), by waste, then longest pieces first. The empty filling if nothing fits. every_filling() has the others."""
    found: list[tuple[int, ...]] = []
    steps = 0

    def grow(rest: int, top: int, chosen: tuple[int, ...]) -> bool:
        nonlocal steps
        i = bisect_right(sizes, min(rest, top)) - 1
        any_fits, branches = False, 0
        while i >= 0 and steps < 50 * width:
            k = sizes[i]
            i -= 1
            if left[k] <= chosen.count(k):
                continue
            any_fits = True
            most = min(left[k] - chosen.count(k), rest // k)
            for c in {most, max(1, most // 2), 1}:  # equal pieces at once, so that many small ones do not make it deep
                steps += 1
                grow(rest - c * k, k - 1, (*chosen, *[k] * c))
            branches += 1
            if len(found) >= 4 * width or branches >= max(2, width - 2 * len(chosen)):
                break
            gap = bisect_right(sizes, rest - k) - 1  # jump to the piece that leaves no gap, if there is one
            if gap >= 0 and rest - sizes[gap] > k:
                break
        if not any_fits and (chosen or not found):
            small = next((k for k in sizes if left[k] > chosen.count(k)), None)
            if small is None or small > rest:  # maximal: nothing of what is left fits
                found.append(chosen)
        return any_fits

    for k in exact(rest, left, sizes):
        found.append(k)
    grow(rest, rest, ())
    unique = sorted(set(found), key=lambda f: (rest - sum(f), [-k for k in f]))[: 2 * width]
    kept: list[tuple[int, ...]] = []
    for f in unique:
        if len(kept) < width and not any(len(f) <= 8 and len(g) <= 8 and _fits(sorted(f, reverse=True), list(g)) for g in kept):
            kept.append(f)
    return [tuple((k, f.count(k)) for k in sorted(set(f), reverse=True)) for f in kept] or [()]


def exact(rest: int, left: dict[int, int], sizes: list[int]) -> Iterator[tuple[int, ...]]:
    """Fillings without waste of one, two or three pieces, the longest first piece that has any."""
    if left.get(rest, 0):
        yield (rest,)
    have = [k for k in sizes if left[k] and k < rest]
    there = set(have)
    for a in reversed(have):
        b = rest - a
        if a >= b and b in there and (a != b or left[a] > 1):
            yield (a, b)
            return
        if a < b:
            break
    for a in reversed(have[-64:]):
        for b in reversed(have):
            c = rest - a - b
            if b <= a and 0 < c <= b and c in there and all(left[x] >= (a, b, c).count(x) for x in (a, b, c)):
                yield (a, b, c)
                return


def best_fit(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, Filling]]:
    """Best-fit decreasing on a histogram: (bins, filling) pairs."""
    bins: dict[tuple[int, ...], int] = {}
    by_room: dict[int, dict[tuple[int, ...], int]] = {}

    def put(f: tuple[int, ...], n: int) -> None:
        by = by_room.setdefault(room - sum(f), {})
        by[f] = by.get(f, 0) + n

    for k in sorted(counts, reverse=True):
        n = counts[k]
        while n:
            at = min((r for r, by in by_room.items() if r >= k and by), default=None)
            if at is None:
                per = min(n, room // k)
                whole = n // per
                put((k,) * per, whole)
                n -= whole * per
            else:
                f, m = next(iter(by_room[at].items()))
                m = min(n, m)
                by_room[at][f] -= m
                if not by_room[at][f]:
                    del by_room[at][f]
                put((*f, k), m)
                n -= m
    for by in by_room.values():
        for f, n in by.items():
            bins[f] = bins.get(f, 0) + n
    return [(n, tuple((k, f.count(k)) for k in sorted(set(f), reverse=True))) for f, n in bins.items()]


def every_filling(rest: int, left: dict[int, int], sizes: list[int], waste: int) -> Iterator[tuple[int, ...] | None]:
    """All maximal fillings of `rest` that waste at most `waste`, each once, longest pieces first; a null for each step in between."""

    def grow(room: int, at: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...] | None]:
        """Adds pieces of lengths below sizes[at]; as deep as lengths differ (at most 63 of 2,048), not as pieces are many."""
        yield None
        i = min(at, bisect_right(sizes, room)) - 1
        if room <= waste and not any(left[k] > chosen.count(k) for k in sizes[: bisect_right(sizes, room)]):
            yield chosen
        while i >= 0:
            k = sizes[i]
            for c in range(min(left[k], room // k), 0, -1):
                yield from grow(room - c * k, i, (*chosen, *[k] * c))
            i -= 1

    yield from grow(rest, len(sizes), ())


def dive(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, Filling]]:
    """The packing that always takes the first filling, as often as its pieces last."""
    left, out = dict(counts), []
    while sizes := sorted(k for k, n in left.items() if n):
        left[sizes[-1]] -= 1
        first = fillings(room - sizes[-1], left, sizes)[0]
        left[sizes[-1]] += 1
        per = {sizes[-1]: 1}
        for k, c in first:
            per[k] = per.get(k, 0) + c
        m = min(left[k] // c for k, c in per.items())
        for k, c in per.items():
            left[k] -= m * c
        out.append((m, tuple(per.items())))
    return out


class Found(NamedTuple):
    """A packing as (bins, filling) pairs, bins that no packing can do without, and whether the packing is known to need as few as possible."""

    packing: list[tuple[int, Filling]]
    bound: int
    proved: bool


def search(counts: dict[int, int], room: int = ROOM, nodes: int | None = NODES) -> Found:
    """Bin completion on a histogram of lengths (1 to room)."""
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return Found([], 0, True)
    low = bound(counts, room)
    best = best_fit(counts, room)
    fewest = sum(n for n, _ in best)
    if fewest > low:
        best = min(best, dive(counts, room), key=lambda p: sum(n for n, _ in p))
        fewest = sum(n for n, _ in best)
    total = sum(k * n for k, n in counts.items())
    left, path = dict(counts), []
    used = waste = spent = 0

    def slack() -> int:
        """Waste that a better packing may have."""
        return (fewest - 1) * room - total

    def tries(before: int) -> Iterator[tuple[int, Filling] | None]:
        """(times, filling) of the bin that the longest piece left opens."""
        sizes = sorted(k for k, n in left.items() if n)
        top = sizes[-1]
        left[top] -= 1
        first = fillings(room - top, left, sizes)
        left[top] += 1
        seen = {tuple(k for k, c in f for _ in range(c)) for f in first}
        tried = list(seen)

        def often(chosen: tuple[int, ...]) -> Iterator[tuple[int, Filling]]:
            per: dict[int, int] = {}
            for k in (top, *chosen):
                per[k] = per.get(k, 0) + 1
            lost = room - top - sum(chosen)
            for m in range(min(left[k] // c for k, c in per.items()), 0, -1):
                if before + m * lost <= slack():
                    yield m, tuple(per.items())

        for f in first:
            yield from often(tuple(k for k, c in f for _ in range(c)))
        left[top] -= 1
        more = every_filling(room - top, left, sizes, slack() - before)
        while True:
            f = next(more, False)
            left[top] += 1
            if f is False:
                return
            if f is None:
                yield None
            # what fits into a filling tried before needs no try; the test is skipped where it would cost more than the try
            elif f not in seen and not any(len(f) <= 8 and len(g) <= 8 and _fits(sorted(f, reverse=True), list(g)) for g in tried):
                tried.append(f)
                del tried[:-64]
                yield from often(f)
            left[top] -= 1

    # a frame: what is still to be tried, what is in use, waste before it
    stack: list[list] = [[tries(0), None, 0]] if fewest > low else []
    while stack and fewest > low and (nodes is None or spent < nodes):
        frame = stack[-1]
        if frame[1]:
            m, f = frame[1]
            for k, c in f:
                left[k] += m * c
            used -= m
            path.pop()
            frame[1] = None
        spent += 1
        step = next(frame[0], False)
        if step is False:
            stack.pop()
            continue
        if step is None:
            continue
        m, f = step
        waste = frame[2] + m * (room - sum(k * c for k, c in f))
        if waste > slack():
            continue
        for k, c in f:
            left[k] -= m * c
        used += m
        path.append(step)
        frame[1] = step
        if not any(left.values()):
            if used < fewest:
                fewest, best = used, list(path)
        else:
            stack.append([tries(waste), None, waste])
    return Found(best, low, fewest == low or not stack)


def complete(counts: dict[int, int], room: int = ROOM, nodes: int | None = NODES) -> list[tuple[int, Filling]]:
    """The packing that search() finds: (bins, filling) pairs that hold every piece once."""
    return search(counts, room, nodes).packing


def runs(packed: list[tuple[int, Filling]]) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """For each length its runs (first rank, first bin, pieces a bin, offset) in ascending rank, and the number of bins."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for n, f in packed:
        at = 0
        for k, c in f:
            r = ranks.get(k, 0)
            out.setdefault(k, []).append((r, first, c, at))
            ranks[k] = r + n * c
            at += k * c
        first += n
    return out, first


PIECES = "id long, piece int, start long, length long, ids_crc32 long, chunk int, k long"


def _pieces(path: str, end: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, words, tail = TaskContext.get().partitionId(), encoder(path), int(end).to_bytes(4, "little")
        seen = [0] * (room + 1)
        for b in regroup(batches, 4 << 20):
            out = []
            for i, ids in zip(b.column(0).to_pylist(), words.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids += tail
                for p, at in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[at : at + 4 * room]
                    n = len(part) // 4
                    out.append((i, p, at // 4, n, zlib.crc32(part), chunk, seen[n]))
                    seen[n] += 1
            cols = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "piece", "start", "length", "ids_crc32", "chunk", "k"])

    return run


def _assign(sent, whole: int, room: int):
    """Rank within a length -> bin and offset. sent: broadcast arrays of runs; a small multiple of `room` fillings, each of at most 63 distinct lengths, whatever the input size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in sent.value.items()}
        for b in batches:
            length = b.column(3).to_numpy()
            rank = b.column(5).to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length).tolist():
                at = np.flatnonzero(length == k)
                if k == room:
                    seq[at] = rank[at]
                    continue
                first, base, per, offset = by[k]
                r = np.searchsorted(first, rank[at], "right") - 1
                q = rank[at] - first[r]
                seq[at] = whole + base[r] + q // per[r]
                off[at] = offset[r] + q % per[r] * k
            yield pa.record_batch([*(b.column(i) for i in range(5)), pa.array(seq), pa.array(off)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, room: int = ROOM, nodes: int | None = NODES) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, proved (whether no packing needs fewer sequences; false where the search ended after `nodes` steps).

    A document is its ids and the end id; null and empty texts are the end id alone. Documents over `room` ids are cut
    into whole pieces and a rest. Repeated rows and null ids are packed like any other row; an empty table gives none;
    other columns are ignored. Sequences are numbered from 0, those of single whole pieces first.
    """
    spark = ready(docs.sparkSession)
    pieces = written(pick(docs, id_col, text_col).mapInArrow(_pieces(tokenizer or tokenizer_path(), end_id, room), PIECES), "pack-pieces")
    by_chunk = written(pieces.groupBy("chunk", "length").agg(F.count("*").alias("n")), "pack-counts")
    counts = {r["length"]: r["n"] for r in by_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `room` rows
    whole = counts.pop(room, 0)
    found = search(counts, room, nodes)
    placed, _ = runs(found.packing)
    sent = spark.sparkContext.broadcast(placed)
    w = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = by_chunk.select("chunk", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    # chunks times lengths grow with the table, so they are never broadcast; a chunk has as many pieces as a task of the scan
    ranked = pieces.join(before.hint("merge"), ["chunk", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k")).alias("rank"))
    out = ranked.mapInArrow(_assign(sent, whole, room), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col).withColumn("proved", F.lit(found.proved))
