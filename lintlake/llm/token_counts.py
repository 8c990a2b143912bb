"""Token counts by section through character offsets.

A document is encoded once, whole; its tokens' character spans are then interval-joined to its sections (here its lines,
each with its line feed). Rule for a token across a boundary: it counts for the section that holds most of its
characters, of equals for the first; it is counted there as crossing too. So every token counts exactly once, and the
sections' counts add up to the document's.

The byte-level vocabulary keeps white space: a token may begin with a blank, and runs of white space are tokens of
their own. Texts whose white space is only blanks and line feeds are cut before each run of it: a run and the word
behind it are encoded together, as the pre-tokenizer never looks behind and never past the next word's first character.
Such atoms repeat and are encoded once a worker. Texts with other white space are encoded in one piece, as are all texts
where a probe shows that the given tokenizer does not work so.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lintlake.llm.common import pick, ready, regroup
from lintlake.llm.tokens import tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
#: Atoms kept in a worker; longer ones than LONG characters are encoded anew each time.
KEPT, LONG = 500_000, 256
_ATOMS = re.compile("[ \n]*[^ \n]+|[ \n]+").findall
_OTHER_SPACE = re.compile(r"[^\S \n]").search
SPECIAL = "<|"
PROBES = ("Ab, c.\n d-s \xc9t\xe9. Zz 42\xb2 (x)", "  a  b\n\n c \n", "don't 'tis we'll\n\n\n  x", "\n", "\u65e5\u672c \u8a9e\u3002\n1234 56")


class _Store(dict):
    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, atom: str) -> bytes:
        out = self.learn(atom)
        if len(atom) <= LONG:
            self[atom] = out
        return out


class OffsetEncoder:
    """Token spans of whole texts in code points."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.store = _Store(self._learn)
        self.by_atom = all(np.array_equal(_place([*map(self._learn, _ATOMS(t))]), self.whole(t)) for t in PROBES)

    def whole(self, text: str) -> np.ndarray:
        """(tokens, 2) starts and ends; the tokens of one character share its span."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)

    def _learn(self, atom: str) -> bytes:
        spans = self.whole(atom)
        return np.concatenate([[[len(atom), len(spans)]], spans]).astype("<i4").tobytes()

    def spans(self, text: str) -> np.ndarray:
        if not self.by_atom or SPECIAL in text or _OTHER_SPACE(text):
            return self.whole(text)
        if len(self.store) > KEPT:
            for w in [w for w, _ in zip(self.store, range(KEPT // 2), strict=False)]:
                del self.store[w]
        return _place([*map(self.store.__getitem__, _ATOMS(text))])


def _place(atoms: list[bytes]) -> np.ndarray:
    """Atoms, each (its length, its tokens) and its tokens' spans, to spans in the text that they make."""
    got = np.frombuffer(b"".join(atoms), "<i4").reshape(-1, 2)
    sizes = np.fromiter(map(len, atoms), np.int64, len(atoms)) // 8
    heads = np.cumsum(sizes) - sizes
    lengths, tokens = got[heads, 0].astype(np.int64), got[heads, 1].astype(np.int64)
    begin = np.repeat(np.cumsum(lengths) - lengths, tokens)
    mask = np.ones(len(got), bool)
    mask[heads] = False
    return got[mask].astype(np.int64) + begin[:, None]


def allocate(spans: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The interval join. spans: tokens' (start, end) in order; bounds: ascending section starts, and the text's end. Returns tokens and crossing tokens of each section."""
    n = len(bounds) - 1
    s, e = spans[:, 0], spans[:, 1]
    first = np.clip(np.searchsorted(bounds, s, "right") - 1, 0, max(n - 1, 0))
    last = np.clip(np.searchsorted(bounds, np.maximum(e - 1, s), "right") - 1, 0, max(n - 1, 0))
    own = first.copy()
    for t in np.flatnonzero(last > first).tolist():
        parts = range(first[t], last[t] + 1)
        own[t] = max(parts, key=lambda k: (min(e[t], bounds[k + 1]) - max(s[t], bounds[k]), -k))
    return np.bincount(own, minlength=n), np.bincount(own[last > first], minlength=n)


def sections(text: str) -> np.ndarray:
    """Starts of the lines (a line feed ends its line), and the text's end; an empty text has no section."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    if starts[-1] == len(text) and text:
        starts.pop()
    return np.array([*starts, len(text)] if text else [0], np.int64)


@lru_cache(maxsize=1)
def encoder(path: str) -> OffsetEncoder:
    return OffsetEncoder(path)


NAMES = ["id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in regroup(batches, 2 << 20):
            cols: list[list[np.ndarray]] = [[] for _ in NAMES[1:]]
            ids: list = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bounds = sections(t or "")
                n = len(bounds) - 1
                if not n:
                    continue
                spans = enc.spans(t)
                tokens, crossing = allocate(spans, bounds)
                ids += [i] * n
                for c, v in zip(cols, (np.arange(n), bounds[:-1], bounds[1:], tokens, crossing, np.full(n, len(spans))), strict=True):
                    c.append(v)
            yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in cols)], names=NAMES)

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per line of each document: id, section (from 0), start, end (code points), n_tokens, n_crossing, doc_tokens (of its whole document).

    A text that is null or empty has no section and no row. Repeated rows give repeated results; an empty table none;
    other columns are ignored.
    """
    ready(docs.sparkSession)
    schema = "id long, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long"
    return pick(docs, id_col, text_col).mapInArrow(_count(tokenizer or tokenizer_path(TOKENIZER)), schema).withColumnRenamed("id", id_col)
