"""SimHash near-dedup by anchor-point covering.

The 64 bits of a fingerprint are cut into three blocks of 22, 21 and 21 bits, each seen as a word of the binary Golay
code's space (23 bits, the rest zero). The code is perfect: every word lies within R = 3 of exactly one codeword, its
home. Two fingerprints that differ in at most 4 bits differ in at most 1 bit in some block (plan "one"), and in at most
2 bits together in some pair of blocks (plan "two"). So a fingerprint is replicated, for each block (or pair), to every
anchor (codeword, or pair of codewords) within R plus that threshold; whoever is at home there is compared with all
others there. No pair is lost. Plan "two" makes more replicas but 4096 times finer anchors; it is for tables whose
groups under plan "one" would be large. Both plans give the same links.

Links within an anchor leave it as a spanning forest, never as all pairs; components follow by alternating large-star
and small-star steps over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import join_hot, pick, ready, regroup, tasks, written

BITS = 4
SHINGLE = 4
SEED = 42
#: The Golay code's generator polynomial; a fixed value of the code, as are its length and covering radius.
GOLAY, LENGTH, RADIUS = 0b110001110101, 23, 3
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Distinct fingerprints beyond which pairs of blocks serve as anchors.
FINE_FROM = 4_000_000
#: Rows of one comparison cell; anchors with more are compared in a grid of cells.
CELL = 16_384
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FOLD = _LOWER.translate(bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256)))


def fingerprint(text: bytes) -> int:
    """SimHash of a text: bit set where over half of the shingles' XXH64 have it; no words: 0."""
    words = text.translate(_FOLD).split(b" ") if text else []
    words = [w for w in words if w]
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return h(b" ".join(words), SEED)
    body = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = len(words) - SHINGLE + 1
    half = np.zeros(64, np.int64)
    at, till = starts[:n].tolist(), ends[SHINGLE - 1 :].tolist()
    for i in range(0, n, 1 << 16):
        hs = np.array([h(body[a:b], SEED) for a, b in zip(at[i : i + (1 << 16)], till[i : i + (1 << 16)], strict=True)], "<u8")
        bits = np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(bits), 128):  # sums of up to 128 ones fit a byte
            half += bits[j : j + 128].sum(axis=0, dtype=np.uint8)
    on = np.flatnonzero(half * 2 > n)
    return int(sum(1 << int(b) for b in on))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in regroup(batches, 16 << 20):
        fp = [fingerprint(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
        yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), b.column(2)], names=["id", "fp", "text_hash"])


def _syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of each word by the generator."""
    v = v.copy()
    for bit in range(LENGTH - 1, 10, -1):
        v ^= np.where(v >> bit & 1, GOLAY << (bit - 11), 0)
    return v


@lru_cache(maxsize=None)
def _patterns(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of weight up to RADIUS + most, by syndrome: offsets, patterns, excess over RADIUS."""
    layers, layer = [np.zeros(1, np.int64)], np.zeros(1, np.int64)
    for _ in range(RADIUS + most):
        grown = (layer[:, None] | (1 << np.arange(LENGTH, dtype=np.int64))[None, :]).ravel()
        layer = np.unique(grown[np.bitwise_count(grown) == len(layers)])
        layers.append(layer)
    e = np.concatenate(layers)
    s = _syndrome(e)
    order = np.lexsort((np.bitwise_count(e), s))
    e, s = e[order], s[order]
    return np.searchsorted(s, np.arange(2049)), e, np.maximum(np.bitwise_count(e).astype(np.int64) - RADIUS, 0)


def anchors_of(block: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: every codeword within RADIUS + most. Returns row, codeword, excess; excess 0 is the home."""
    at, e, over = _patterns(most)
    s = _syndrome(block)
    n = at[s + 1] - at[s]
    row = np.repeat(np.arange(len(block)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[s], n)
    return row, block[row] ^ e[k], over[k]


def _block(fp: np.ndarray, k: int) -> np.ndarray:
    shift, width = BLOCKS[k]
    return (fp >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)


def replicas(fp: np.ndarray, fine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor and whether the anchor is the row's home, for each replica."""
    rows, keys, homes = [], [], []
    if not fine:
        for k in range(3):
            r, c, over = anchors_of(_block(fp, k), BITS // 3)
            rows.append(r), keys.append(k << 46 | c), homes.append(over == 0)
    else:
        most = 2 * BITS // 3
        for n, (j, k) in enumerate(((0, 1), (0, 2), (1, 2))):
            r1, c1, o1 = anchors_of(_block(fp, j), most)
            second = _block(fp, k)
            for left in range(most + 1):  # the second block may use what the first leaves of the threshold
                mine = o1 == left
                r2, c2, o2 = anchors_of(second[r1[mine]], most - left)
                rows.append(r1[mine][r2]), keys.append(n << 46 | c1[mine][r2] << 23 | c2), homes.append((o2 == 0) & (left == 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _replicate(fine: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 20_000):
                fp = b.column(0).slice(i, 20_000).to_numpy(zero_copy_only=False)
                r, a, home = replicas(fp.view(np.uint64), fine)
                yield pa.record_batch([pa.array(a), pa.array(home), pa.array(fp[r])], names=["anchor", "home", "fp"])

    return run


def forest(home: np.ndarray, fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links a cell's fingerprints: its homes against all. Returns (fp, root) for each fp whose component has others; the root is the component's least fp."""
    order = np.argsort(fps, kind="stable")
    fps, home = fps[order], home[order]
    first = np.r_[True, fps[1:] != fps[:-1]]  # a fp may stand here as home and again as a replica
    home = np.logical_or.reduceat(home, np.flatnonzero(first))
    fps = fps[first]
    u, label, here = fps.view(np.uint64), np.arange(len(fps)), np.flatnonzero(home)
    step = max(1, (1 << 21) // max(len(u), 1))
    for i in range(0, len(here), step):
        near = np.bitwise_count(u[here[i : i + step], None] ^ u[None, :]) <= bits
        for row in np.flatnonzero(near.sum(axis=1) > 1):
            found = np.unique(label[near[row]])
            if len(found) > 1:
                label[np.isin(label, found[1:])] = found[0]
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; a cell's rows may span batches."""
    rest: tuple[np.ndarray, ...] | None = None

    def solve(cell: np.ndarray, home: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]
        a, b = [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e - s > 1 and home[s:e].any():
                x, y = forest(home[s:e], fp[s:e])
                a.append(x), b.append(y)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        now = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if rest is not None:
            now = tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last cell may go on in the next batch
        if cut:
            yield solve(*(x[:cut] for x in now))
        rest = tuple(x[cut:] for x in now)
    if rest is not None and len(rest[0]):
        yield solve(*rest)


def links(fps: DataFrame, n: int) -> DataFrame:
    """fps (distinct fp) -> a, b: a spanning set of the links at BITS or fewer differing bits; n is fps' row count."""
    rep = written(fps.select("fp").mapInArrow(_replicate(n > FINE_FROM), "anchor long, home boolean, fp long"), "simhash-replicas")
    big = written(rep.groupBy("anchor").agg(F.count("*").alias("m"), F.sum(F.col("home").cast("long")).alias("h")).filter(F.col("m") > CELL), "simhash-big")
    count = big.count()
    if count:  # a grid of cells: each home meets each replica of its anchor in exactly one of them
        side = big.select(F.col("anchor").alias("_a"), F.ceil(F.col("h") / CELL).cast("int").alias("_h"), F.ceil(F.col("m") / CELL).cast("int").alias("_m"))
        rep = rep.join(F.broadcast(side) if count <= 100_000 else side, F.col("anchor") == F.col("_a"), "left")
        row, col = F.pmod(F.xxhash64("fp"), F.col("_h")).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("_m")).cast("int")
        along = F.transform(F.sequence(F.lit(0), F.col("_m") - 1), lambda c: F.struct((row * F.col("_m") + c).alias("c"), F.lit(True).alias("h")))
        down = F.transform(F.sequence(F.lit(0), F.col("_h") - 1), lambda r: F.struct((r * F.col("_m") + col).alias("c"), F.lit(False).alias("h")))
        cells = F.when(F.col("_a").isNull(), F.array(F.struct(F.lit(0).alias("c"), F.col("home").alias("h")))).when(F.col("home"), F.concat(along, down)).otherwise(down)
        rep = rep.withColumn("_c", F.explode(cells)).select(F.xxhash64("anchor", "_c.c").alias("cell"), F.col("_c.h").alias("home"), "fp")
    else:
        rep = rep.select(F.col("anchor").alias("cell"), "home", "fp")
    rep = rep.repartition(tasks(fps.sparkSession), "cell").sortWithinPartitions("cell")
    return written(rep.mapInArrow(_compare, "a long, b long").distinct(), "simhash-links")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b): the root is the component's least node. Alternating large-star and small-star; each step is a written table, joins are split by Spark where a node is hot."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the least id of its component), component_size, text_hash (XXH64 of the text as it is).

    Words are runs of other than the six white-space characters, A-Z lower-cased; shingles of 4 words count with
    repeats, a shorter text is one shingle, a text without words (null, empty, blank) has fingerprint 0 and is linked
    like any other. Fingerprints within 4 bits are linked, components are their transitive closure. A null id never
    becomes a component_id unless its whole component has null ids. Repeated rows give repeated results; an empty table
    gives none; other columns are ignored.
    """
    ready(docs.sparkSession)
    plain = pick(docs, id_col, text_col).withColumn("_hash", F.xxhash64(F.col(f"`{text_col}`")))
    prints = written(plain.mapInArrow(_prints, "id long, fp long, text_hash long"), "simhash-prints")
    fps = written(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    count, total = fps.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    roots = components(links(fps, count))
    classed = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    grouped = classed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    named = classed.join(grouped, "root").select("fp", "n", "component_id", "component_size")
    out = join_hot(prints, named, "fp", F.col("n"), total, F.coalesce(F.col("id").cast("string"), F.lit("")))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size", "text_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of near copies the row with the smallest id stays (null ids last; of rows that repeat an id the one with the smallest text hash); rows that repeat both stay together, exact dedup is for those."""
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("text_hash").alias("h"))
    found = simhash_dedup(docs, id_col, text_col)
    # a component is known by its least id; components of null ids alone by their fingerprint's
    key = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("f"), "fingerprint"))
    first = found.groupBy(key.alias("k")).agg(F.min(order).alias("first")).select(F.col("first.i").alias("_i"), F.col("first.h").alias("_h"))
    mine = docs[id_col].eqNullSafe(first["_i"]) & (F.xxhash64(docs[text_col]) == first["_h"])
    return docs.join(first, mine, "left_semi")
