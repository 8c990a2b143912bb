"""Whole-text encoding with a public tokenizer file, by exact reuse of what repeats.

The tokenizer's pre-tokenizer drops white space and cuts a text into letter runs, digits and runs of other characters;
only its contractions ('s, 't, ...) join an apostrophe to letters. Its normaliser lower-cases, composes (NFC) and
squeezes white space. So:

- texts of Latin-1 characters without apostrophes are lower-cased whole (they are composed already) and cut at white space
  by Arrow, which also numbers the distinct words of about 4 MB of text and trims each to the letter run it begins with and
  what follows; each distinct run is looked up once, and the ids of all words are laid side by side in numpy. A new letter
  run is encoded by the library's model directly and kept in the worker (in bounded memory, those of most texts longest);
  words that begin otherwise or go on with letters are cut into runs one by one;
- any other text is cut at ASCII spaces and line feeds, which no pattern crosses, and its distinct pieces are kept alike;
- a text with the mark of a special token is encoded whole.

Tests hold this against encoding whole texts.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of each sort kept per worker, in two generations; longer pieces than LONG characters are encoded anew each time.
KEPT = 400_000
LONG = 256
#: Letter runs of plain texts kept per worker, and how many of them stay when there are more.
TABLE, STAY = 500_000, 0.8
#: Characters of text whose words are numbered together (a longer text stands alone), and words laid out at a time.
TOGETHER, LAID = 4 << 20, 1 << 18
DEFAULT = "word_bpe_49k.json"
#: Letters and digits of Latin-1, in lower case; runs of the first are words to the pre-tokenizer, the second stand alone.
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_RUNS = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]|[^\\t-\\r \x85\xa0{_LETTERS}{_DIGITS}]+").findall
_LOWER = "".join(re.findall(f"[{_LETTERS}]", "".join(map(chr, range(256)))))
_OTHER = re.sub(f"[{_LETTERS}]", "", "".join(map(chr, range(256))))
_LATIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
# 1c to 1f part words for str.split but are no white space to the pre-tokenizer
_MARKS = ("'", "<|", "\x1c", "\x1d", "\x1e", "\x1f")


def _plain(text: str) -> bool:
    """A Latin-1 text without marks."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return not any(map(text.__contains__, _MARKS))



def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


def tokenizer_path(name: str = DEFAULT) -> str:
    """Where the installed vocabulary files lie; a parameter of every operator that tokenizes."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Store(dict):
    """Ids of pieces; a missing piece is encoded when first asked for. turn() makes a full store the older generation and lets the one before it go; a piece that is asked for again comes back from there, so frequent ones stay."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.older = learn, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = self.learn(piece)
        if len(piece) <= LONG:
            self[piece] = out
        return out

    def turn(self) -> None:
        if len(self) > KEPT // 2:
            self.older = dict(self)
            self.clear()


def places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] places, then those of begin[1], and so on."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class _Table:
    """Ids of runs side by side: the run at place k has size[k] of them from begin[k] on. trim() makes room: long runs go at once, then those that few batches asked for, of equals those not asked for longest; new runs take their places."""

    def __init__(self, learn):
        self.learn, self.place, self.names = learn, {}, []
        self.ids = np.zeros(0, "<u4")
        self.begin, self.size, self.asked, self.last, self.free, self.long = (np.zeros(0, np.int64) for _ in range(6))
        self.batch = 0

    def find(self, runs: list[str]) -> np.ndarray:
        """Places of distinct runs, good until trim(); missing ones are encoded."""
        at = np.fromiter(map(self.place.get, runs, repeat(-1)), np.int64, len(runs))
        if len(new := np.flatnonzero(at < 0)):
            names = [runs[i] for i in new.tolist()]
            found = list(map(self.learn, names))
            if (more := len(new) - len(self.free)) > 0:
                self.free = np.r_[self.free, np.arange(len(self.names), len(self.names) + more)]
                self.names += [""] * more
                self.begin, self.size, self.asked, self.last = (np.r_[x, np.zeros(more, np.int64)] for x in (self.begin, self.size, self.asked, self.last))
            at[new], self.free = self.free[: len(new)], self.free[len(new) :]
            for name, k in zip(names, at[new].tolist(), strict=True):
                self.names[k], self.place[name] = name, k
            size = np.fromiter(map(len, found), np.int64, len(found))
            self.begin[at[new]], self.size[at[new]], self.asked[at[new]] = len(self.ids) + np.cumsum(size) - size, size, 0
            self.ids = np.r_[self.ids, np.fromiter(chain.from_iterable(found), "<u4", int(size.sum()))]
            self.long = at[new[np.fromiter(map(len, names), np.int64, len(names)) > LONG]]
        self.batch += 1
        self.asked[at] += 1
        self.last[at] = self.batch
        return at

    def trim(self, most: int) -> None:
        drop = self.long
        if len(self.place) - len(drop) > most:
            self.asked[drop] = 0
            held = np.flatnonzero(self.asked)
            drop = np.r_[drop, held[np.lexsort((self.last[held], self.asked[held]))[: len(held) - int(most * STAY)]]]
            self.asked = (self.asked + 1) // 2
        if not len(drop):
            return
        for k in drop.tolist():
            del self.place[self.names[k]]
            self.names[k] = ""
        self.size[drop] = self.asked[drop] = 0
        self.ids = self.ids[places(self.begin, self.size)]
        self.begin = np.cumsum(self.size) - self.size
        self.free, self.long = np.r_[self.free, drop], drop[:0]


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.store, self.runs, self.words = _Store(self._learn), _Store(self._raw), _Store(self._model)
        self.table = _Table(self._ids)
        # runs and pieces may be reused only where the pre-tokenizer drops white space, as this kind of vocabulary does
        probe = "Ab, c.\n d-s \xc9t\xe9. Zz 42\xb2 (x)"
        self.by_piece = self._raw(probe) == b"".join(map(self._raw, re.split("[ \n]", probe))) == b"".join(map(self._learn, re.split("[ \n]", probe))) == b"".join(map(self._word, probe.lower().split()))

    def _raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, word: str) -> list[int]:
        """Of a lower-case letter run."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(word)]

    def _model(self, word: str) -> bytes:
        return b"".join([self.packed[i] for i in self._ids(word)])

    def _word(self, word: str) -> bytes:
        """Of what lies between white space in a lower-case Latin-1 text; only its runs are kept."""
        if word.isalpha():
            return self.words[word]
        if len(word) > 1 and word[-1] in ",." and word[:-1].isalpha():
            return self.words[word[:-1]] + self.runs[word[-1]]
        return b"".join([self.words[run] if run[0].isalpha() else self.runs[run] for run in _RUNS(word)])

    def _learn(self, piece: str) -> bytes:
        if _LATIN(piece):
            return self.words[piece.lower()]
        if len(piece) > 1 and piece[-1] in ",." and unicodedata.normalize("NFC", piece[:-1]).lower()[-1].isalpha():  # a mark at the end would join the stop
            return self.store[piece[:-1]] + self.store[piece[-1]]
        return self._raw(piece)

    def _together(self, texts: list[str]) -> list[bytes]:
        """Of lower-case Latin-1 texts without marks."""
        words = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        ends, words = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        distinct, which = words.dictionary, words.indices.to_numpy()
        head, rest = pc.utf8_rtrim(distinct, characters=_OTHER), pc.utf8_ltrim(distinct, characters=_LOWER)
        whole = pc.equal(pc.add(pc.binary_length(head), pc.binary_length(rest)), pc.binary_length(distinct))  # nothing lies between
        head = pc.if_else(whole, head, "").dictionary_encode()
        rest = pc.if_else(whole, rest, distinct).dictionary_encode()
        at = self.table.find(head.dictionary.to_numpy(zero_copy_only=False).tolist())[head.indices.to_numpy()]
        more = list(map(self._word, rest.dictionary.to_pylist()))
        n, m = self.table.size[at], np.fromiter(map(len, more), np.int64, len(more)) // 4
        begin = np.cumsum(m) - m
        last = rest.indices.to_numpy()
        size = n + m[last]
        put = np.cumsum(size) - size
        ids = np.empty(int(size.sum()), "<u4")
        ids[places(put, n)] = self.table.ids[places(self.table.begin[at], n)]
        ids[places(put + n, m[last])] = np.frombuffer(b"".join(more), "<u4")[places(begin[last], m[last])]
        begin = put
        laid = []
        for i in range(0, len(which), LAID):
            w = which[i : i + LAID]
            n = size[w]
            laid.append(ids[places(begin[w], n)].tobytes())
        body = memoryview(b"".join(laid))
        cuts = (4 * np.r_[0, np.cumsum(size[which])][ends - ends[0]]).tolist()
        return [bytes(body[i:j]) for i, j in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return [self._raw(t) for t in texts]
        piece, out = self.store.__getitem__, [b""] * len(texts)
        plain: list[int] = []
        held = 0
        for i, t in enumerate(texts):
            if _plain(t):
                if plain and held + len(t) > TOGETHER:
                    self._fill(out, texts, plain)
                    plain, held = [], 0
                plain.append(i)
                held += len(t)
                continue
            if "<|" in t:
                out[i] = self._raw(t)
            else:
                out[i] = b"".join(map(piece, t.replace("\n", " ").split(" ")))
            self._turn()
        if plain:
            self._fill(out, texts, plain)
        return out

    def _fill(self, out: list[bytes], texts: list[str], at: list[int]) -> None:
        for i, ids in zip(at, self._together([texts[i].lower() for i in at]), strict=True):
            out[i] = ids
        self._turn()

    def _turn(self) -> None:
        for kept in (self.runs, self.words, self.store):
            kept.turn()
        self.table.trim(TABLE)


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder; its store serves all tasks that the worker runs."""
    return WordEncoder(path)
