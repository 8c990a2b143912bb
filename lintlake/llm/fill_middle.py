"""Fill-in-middle transformation with succinct rank and select over a batch's text.

The bytes of all texts of a batch stand side by side. One bitvector marks the last byte of each unit (a word with the
white space before it, or white space that ends a text), another the first byte of each code point. Both are packed into
64-bit words with a directory of popcounts for blocks of eight words. A text's units are the difference of two ranks; the
cuts of a split are two selects; its lengths in code points are differences of ranks again. So a batch costs a few passes
over its bytes, whatever the lengths of its texts, and texts are cut as bytes without being taken apart.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import pick, ready, regroup

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
#: Percent of texts that are changed, and of these percent with the suffix first.
RATE, SPM_RATE = 50, 80
#: Bytes of text worked on together (a longer text stands alone).
TOGETHER = 4 << 20
IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
WORDS = 8
_IN_BYTE = np.array([[j for j in range(8) if b >> j & 1] + [0] * (8 - bin(b).count("1")) for b in range(256)], np.int64)


class Bits:
    """A packed bitvector with rank and select, both for arrays of questions."""

    def __init__(self, flags: np.ndarray) -> None:
        packed = np.packbits(flags, bitorder="little")
        words = -(-len(packed) // (8 * WORDS)) * WORDS + WORDS  # whole blocks, and one of zeros
        self.words = np.zeros(words, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.r_[0, np.cumsum(self.counts.reshape(-1, WORDS).sum(axis=1))]  # bits set before each block

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Bits set before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        block = word // WORDS
        inside = np.where(np.arange(WORDS) < (word % WORDS)[:, None], self.counts.reshape(-1, WORDS)[block], 0).sum(axis=1)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + inside + np.bitwise_count(low).astype(np.int64)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The position of the nth bit that is set, counted from 1."""
        block = np.searchsorted(self.before, nth, "left") - 1
        left = nth - self.before[block]
        sums = np.cumsum(self.counts.reshape(-1, WORDS)[block], axis=1)
        word = (sums < left[:, None]).sum(axis=1)
        left = left - np.where(word > 0, np.take_along_axis(sums, np.maximum(word - 1, 0)[:, None], axis=1)[:, 0], 0)
        at = block * WORDS + word
        octets = self.words[at].view(np.uint8).reshape(-1, 8)
        sums = np.cumsum(np.bitwise_count(octets).astype(np.int64), axis=1)
        octet = (sums < left[:, None]).sum(axis=1)
        left = left - np.where(octet > 0, np.take_along_axis(sums, np.maximum(octet - 1, 0)[:, None], axis=1)[:, 0], 0)
        return at * 64 + octet * 8 + _IN_BYTE[np.take_along_axis(octets, octet[:, None], axis=1)[:, 0], left - 1]


class Units:
    """Units and code points of a batch's texts (null: empty)."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        raw = texts.buffers()
        cuts = np.frombuffer(raw[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.bytes = np.frombuffer(raw[2], np.uint8)[cuts[0] : cuts[-1]] if raw[2] is not None else np.empty(0, np.uint8)
        self.cuts = cuts - cuts[0]
        space = IS_SPACE[self.bytes]
        ends = np.zeros(len(space), bool)
        ends[:-1] = ~space[:-1] & space[1:]
        ends[self.cuts[1:][np.diff(self.cuts) > 0] - 1] = True
        self.ends, self.heads = Bits(ends), Bits((self.bytes & 0xC0) != 0x80)
        self.first = self.ends.rank(self.cuts[:-1])
        self.n = self.ends.rank(self.cuts[1:]) - self.first

    def cut(self, units: np.ndarray) -> np.ndarray:
        """The byte at which the first `units` units of each text end."""
        at, some = self.cuts[:-1].copy(), units > 0
        at[some] = self.ends.select((self.first + units)[some]) + 1
        return at


def _draws(seed: int, doc: int | None) -> tuple[int, int, int, int]:
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).digest()[:16])


def restore(output: bytes, form: str) -> bytes:
    """The text that an output was made of. Texts with marks of their own are always plain, so the first marks are the output's."""
    if form == "plain":
        return output
    if form == "psm":
        prefix, _, rest = output[len(PREFIX) :].partition(SUFFIX)
        suffix, _, middle = rest.partition(MIDDLE)
    else:
        suffix, _, rest = output[len(SUFFIX) :].partition(PREFIX)
        prefix, _, middle = rest.partition(MIDDLE)
    return prefix + middle + suffix


def _split(rate: int, spm_rate: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in regroup(batches, TOGETHER):
            units, docs = Units(b.column(1)), b.column(0).to_pylist()
            h = np.array([_draws(seed, i) for i in docs], np.int64).reshape(-1, 4)
            one, two = h[:, 0] % (units.n + 1), h[:, 1] % (units.n + 1)
            first, second = units.cut(np.minimum(one, two)), units.cut(np.maximum(one, two))
            before, middle, after = units.heads.rank(units.cuts[:-1]), units.heads.rank(first), units.heads.rank(second)
            spm, changed = h[:, 3] % 100 < spm_rate, h[:, 2] % 100 < rate
            data, form, output = units.bytes.tobytes(), [], []
            for i, (s, p, m, e) in enumerate(zip(units.cuts[:-1].tolist(), first.tolist(), second.tolist(), units.cuts[1:].tolist(), strict=True)):
                if s == e or not changed[i] or any(data.find(mark, s, e) >= 0 for mark in (PREFIX, SUFFIX, MIDDLE)):
                    form.append("plain"), output.append(data[s:e])
                elif spm[i]:
                    form.append("spm"), output.append(b"".join((SUFFIX, data[m:e], PREFIX, data[s:p], MIDDLE, data[p:m])))
                else:
                    form.append("psm"), output.append(b"".join((PREFIX, data[s:p], SUFFIX, data[m:e], MIDDLE, data[p:m])))
            plain = np.array([f == "plain" for f in form], bool)
            cols = [b.column(0), pa.array(units.n), pa.array(form, pa.string()), pa.array(middle - before, mask=plain), pa.array(after - middle, mask=plain), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.record_batch(cols, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def transform(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain), output.

    A unit is a run of other characters with the white space before it, or the white space that ends a text. Two draws
    from the document's id give the cuts, two more whether (`rate` percent) and how it is changed. Empty and null texts
    and texts with a mark of their own stay plain; null gives an empty output. A null id draws as an empty one. Rows that
    repeat fare alike; an empty table gives none; other columns are ignored.
    """
    ready(docs.sparkSession)
    rows = pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_split(rate, spm_rate, seed), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in regroup(batches, TOGETHER):
        output = [o.encode() for o in b.column(5).to_pylist()]
        back = [restore(o, f) for o, f in zip(output, b.column(2).to_pylist(), strict=True)]
        sha = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (output, back)]
        yield pa.record_batch([*b.columns[:5], *sha], names=[*b.schema.names[:5], "output_sha256", "restored_sha256"])


def fill_middle(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """transform() with digests in place of the output: of it and of the text restored from it and its form alone."""
    return transform(docs, rate, spm_rate, seed).mapInArrow(_restored, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def oracle() -> str:
    """SQL for fill_middle() with the default rates and seed."""
    part = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    return rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[ \t\n\v\f\r]*[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+') AS u, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        n AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {part(0)} AS h1, {part(1)} AS h2, {part(2)} AS h3, {part(3)} AS h4 FROM d),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
              CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM n),
        s AS (SELECT *, coalesce(array_to_string(list_slice(u, 1, a), ''), '') AS p, coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') AS m, coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') AS e FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM s"""
