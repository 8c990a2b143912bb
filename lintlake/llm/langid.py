"""Language identification of words in code-switched text by a linear-chain conditional random field.

A word's features are the hashed 1- to 4-grams of `^word$` (those with ^ or $ are its affixes), the word itself, and for
each language whether its lexicon has the word. Transitions between the languages of neighbouring words are learned with
the weights; training sequences are spliced from stretches of documents in different languages, so switches occur in them.
Marginals come from forward-backward. It runs exactly on texts of any length: chunks of words are first reduced to their
K x K transfer matrices, these are chained, and then each chunk is run from its true entry and exit vectors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import pick, ready, regroup

#: Bounds of the fitting sample: labelled rows for each language, characters of each.
ROWS, CHARS = 200, 2_000
SLOTS = 1 << 17
EPOCHS, RATE, RIDGE = 4, 0.05, 1e-4
STRETCH = 16
CHUNK = 64
#: Pieces and words kept in a worker, and their characters; longer pieces than LONG are cut anew each time.
KEPT, KEPT_CHARS, LONG = 400_000, 32 << 20, 256
#: Numbers in one array of pair scores; more languages are handled in smaller parts.
PAIRS = 1 << 25
UNKNOWN = "und"
_RUNS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; signs that are digits or numbers but no letters (such as ² and ½) part them."""
    out: list[str] = []
    for w in _RUNS(text.lower()):
        if w.isalpha():
            out.append(w)
        else:
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


class _Store(dict):
    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        out = self.learn(piece)
        if len(piece) <= LONG:
            self[piece] = out
        return out


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all words, and where each word's begin."""
    body = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(body))  # characters of the word from here on
    slots, owners, h = [], [], np.zeros(len(body), np.uint32)
    for n in range(1, 5):
        h = h[: len(body) - n + 1] * np.uint32(16777619) ^ body[n - 1 :]
        at = np.flatnonzero(left[: len(h)] >= n)
        slots.append((h[at] * np.uint32(2654435769) + np.uint32(n * 40503)) >> np.uint32(15))
        owners.append(owner[at])
    whole = np.fromiter((hash_word(w) for w in words), np.uint32, len(words))
    slots.append(whole)
    owners.append(np.arange(len(words)))
    slot, own = np.concatenate(slots).astype(np.int64) % SLOTS, np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return slot[order], np.searchsorted(own[order], np.arange(len(words)))


def hash_word(w: str) -> int:
    import zlib

    return zlib.crc32(w.encode("utf-8", "surrogatepass")) >> 15


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # SLOTS x K
    lexicon: dict[str, np.ndarray]  # word -> K flags, bool
    lex_weights: np.ndarray  # K x K: flag of a language -> score of a label
    trans: np.ndarray  # K x K, log

    def emissions(self, words: list[str]) -> np.ndarray:
        slot, at = grams(words)
        out = np.add.reduceat(self.weights[slot], at, axis=0)
        none = np.zeros(len(self.langs), bool)
        return out + np.array([self.lexicon.get(w, none) for w in words], np.float32) @ self.lex_weights


def marginal_sums(e: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Sums of the labels' marginals over each sequence. e: emissions of all words; sizes: words of each sequence (over 0)."""
    k = trans.shape[0]
    tr = np.exp(trans - trans.max())
    x = np.exp(e - e.max(axis=1, keepdims=True))
    per = -(-sizes // CHUNK)
    n = int(per.sum())
    doc = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(n) - np.repeat(np.cumsum(per) - per, per)
    size = np.minimum(sizes[doc] - nth * CHUNK, CHUNK)
    begin = np.repeat(np.cumsum(sizes) - sizes, per) + nth * CHUNK
    pos = np.arange(CHUNK)
    live = pos[:, None] < size[None, :]
    grid = np.where(live[:, :, None], x[np.minimum(begin[None, :] + pos[:, None], len(x) - 1)], 0).astype(np.float64)
    move = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(CHUNK):
        m = live[t]
        if not m.any():
            break
        new = np.matmul(move.reshape(-1, k), tr).reshape(n, k, k) * grid[t][:, None, :]
        new /= np.maximum(new.sum(axis=(1, 2), keepdims=True), 1e-300)
        move = np.where(m[:, None, None], new, move)
    enter, leave = np.full((n, k), 1.0 / k), np.ones((n, k))
    first, last = np.cumsum(per) - per, np.cumsum(per) - 1
    for j in range(1, int(per.max())):
        c = first[per > j] + j
        v = np.einsum("ni,nij->nj", enter[c - 1], move[c - 1])
        enter[c] = v / np.maximum(v.sum(axis=1, keepdims=True), 1e-300)
        c = last[per > j] - j
        v = np.einsum("nij,nj->ni", move[c + 1], leave[c + 1])
        leave[c] = v / np.maximum(v.sum(axis=1, keepdims=True), 1e-300)
    alpha, a = np.empty((CHUNK, n, k)), enter
    for t in range(CHUNK):
        new = (a @ tr) * grid[t]
        new /= np.maximum(new.sum(axis=1, keepdims=True), 1e-300)
        a = np.where(live[t][:, None], new, a)
        alpha[t] = a
    total, b = np.zeros((n, k)), leave
    for t in range(CHUNK - 1, -1, -1):
        m = alpha[t] * b
        m /= np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
        total += np.where(live[t][:, None], m, 0)
        new = (grid[t] * b) @ tr.T
        new /= np.maximum(new.sum(axis=1, keepdims=True), 1e-300)
        b = np.where(live[t][:, None], new, b)
    out = np.zeros((len(sizes), k))
    np.add.at(out, doc, total)
    return out


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """Fits to (language, text) rows; None when they hold no word."""
    docs = [(lang, words) for lang, text in rows if (words := words_of(text))]
    if not docs:
        return None
    langs = sorted({lang for lang, _ in docs})
    k, rng = len(langs), np.random.default_rng(seed)
    counts = {lang: Counter() for lang in langs}
    for lang, words in docs:
        counts[lang].update(words)
    lexicon: dict[str, np.ndarray] = {}
    for y, lang in enumerate(langs):
        for w, n in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0])):
            if n > 1:
                lexicon.setdefault(w, np.zeros(k, bool))[y] = True
    nth = {lang: y for y, lang in enumerate(langs)}
    stretches = [(nth[lang], words[i : i + STRETCH]) for lang, words in docs for i in range(0, len(words), STRETCH)]
    vocab = {w: i for i, w in enumerate(sorted({w for _, s in stretches for w in s}))}
    slot, at = grams(list(vocab))
    n_feat = np.diff(np.r_[at, len(slot)])
    none = np.zeros(k, bool)
    flags = np.array([lexicon.get(w, none) for w in vocab], bool)
    weights, lex, trans = np.zeros((SLOTS, k), np.float32), np.zeros((k, k), np.float32), np.zeros((k, k))
    sq = [np.full_like(weights, 1e-6), np.full_like(lex, 1e-6), np.full_like(trans, 1e-6)]
    length = 4 * STRETCH
    for epoch in range(EPOCHS):
        order = rng.permutation(len(stretches))
        # two sequences in three continue within a language; the third mixes
        by_lang = sorted(order, key=lambda s: stretches[s][0])
        mixed = order[: len(order) // 3]
        taken = set(mixed.tolist())
        plain = [s for s in by_lang if s not in taken]
        ids = [(vocab[w], stretches[s][0]) for s in [*plain, *mixed] for w in stretches[s][1]]
        if len(ids) > length:  # the last sequence is filled from the first, so that no word is left out
            ids += ids[: -len(ids) % length]
        ids = np.array(ids)
        words, gold = ids[:, 0].reshape(-1, min(length, len(ids))), ids[:, 1].reshape(-1, min(length, len(ids)))
        for part in np.array_split(rng.permutation(len(words)), max(1, len(words) // 128)):
            w, y = words[part], gold[part]
            uniq, inv = np.unique(w, return_inverse=True)
            inv = inv.reshape(w.shape)
            spans = [slot[at[u] : at[u] + n_feat[u]] for u in uniq]
            feats, ends = np.concatenate(spans), np.cumsum([len(s) for s in spans])
            starts = np.r_[0, ends[:-1]]
            known = flags[uniq].astype(np.float32)
            e = (np.add.reduceat(weights[feats], starts, axis=0) + known @ lex)[inv].astype(np.float64)
            g_e, g_t = crf_gradient(e, y, trans)
            per = np.zeros((len(uniq), k))
            np.add.at(per, inv.ravel(), g_e.reshape(-1, k))
            spread = np.repeat(per, np.diff(np.r_[starts, len(feats)]), axis=0)
            g_w = np.stack([np.bincount(feats, spread[:, j], SLOTS) for j in range(k)], axis=1).astype(np.float32)
            for x, g, s in ((weights, g_w, sq[0]), (lex, (known.T @ per).astype(np.float32), sq[1]), (trans, g_t, sq[2])):
                s += g * g
                x -= RATE * g / np.sqrt(s) + RATE * RIDGE * x
    return Model(langs, weights, lexicon, lex, trans.astype(np.float64))


def crf_gradient(e: np.ndarray, y: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log-likelihood, by emissions and transitions; the label before the first word is unknown."""
    b, n, k = e.shape
    tr = np.exp(trans)
    x = np.exp(e - e.max(axis=2, keepdims=True))
    alpha, beta = np.empty((n, b, k)), np.empty((n, b, k))
    a = np.full((b, k), 1.0 / k)
    for t in range(n):
        a = (a @ tr) * x[:, t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[t] = a
    v = np.ones((b, k))
    for t in range(n - 1, -1, -1):
        beta[t] = v
        v = (x[:, t] * v) @ tr.T
        v /= v.sum(axis=1, keepdims=True)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    g = post.transpose(1, 0, 2).copy()
    np.put_along_axis(g, y[:, :, None], np.take_along_axis(g, y[:, :, None], 2) - 1, 2)
    g_t, right, part = np.zeros((k, k)), x.transpose(1, 0, 2)[1:] * beta[1:], max(1, PAIRS // (b * k * k))
    for t in range(0, n - 1, part):
        pair = alpha[:-1][t : t + part, :, :, None] * tr[None, None] * right[t : t + part, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        g_t += pair.sum(axis=(0, 1))
    np.add.at(g_t, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
    return g, g_t


class Labeller:
    """Labels texts with a model; emissions of words are kept within bounds."""

    def __init__(self, model: Model):
        self.model, self.store = model, _Store(self._learn)
        self.reset()

    def reset(self) -> None:
        self.store.clear()
        self.words: dict[str, int] = {}
        self.chars = 0
        self.scores = np.zeros((0, len(self.model.langs)), np.float32)
        self.parts: list[np.ndarray] = []

    def _learn(self, piece: str) -> bytes:
        out = b""
        for w in words_of(piece):
            if w not in self.words:
                self.words[w] = len(self.words)
                self.chars += len(w)
            out += self.words[w].to_bytes(4, "little")
        return out

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of marginals, and words, of each text."""
        k = len(self.model.langs)
        if len(self.store) > KEPT or self.chars > KEPT_CHARS or len(self.words) > KEPT * 64 // max(k, 64):
            self.reset()
        get = self.store.__getitem__
        ids = [np.frombuffer(b"".join(map(get, t.replace("\n", " ").split(" "))), "<i4") for t in texts]
        if len(self.words) > len(self.scores):
            new = list(self.words)[len(self.scores) :]
            self.scores = np.concatenate([self.scores, *(self.model.emissions(new[i : i + 20_000]).astype(np.float32) for i in range(0, len(new), 20_000))])
        sizes = np.array([len(x) for x in ids], np.int64)
        out = np.zeros((len(texts), len(self.model.langs)))
        live = np.flatnonzero(sizes)
        part = np.cumsum(-(-sizes[live] // CHUNK)) * k * k // PAIRS
        for p in np.unique(part):
            at = live[part == p]
            out[at] = marginal_sums(self.scores[np.concatenate([ids[i] for i in at])], sizes[at], self.model.trans)
        return out, sizes


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; false where the id is null."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, chars: int = CHARS) -> list[tuple[str, str]]:
    """The fitting sample: `rows` rows of each language (all where it has fewer ids), chosen by a hash of their ids, and of each a stretch of at most `chars` characters, placed by hash. Held-out rows and rows without id or language take no part; an id counts once in a language."""
    i, t, y = (F.col(f"`{c}`") for c in (id_col, text_col, lang_col))
    usable = docs.filter(~held_out(id_col) & i.isNotNull() & y.isNotNull() & t.isNotNull())
    start = F.pmod(F.xxhash64(i, F.lit(1)), F.greatest(F.length(t) - chars + 1, F.lit(1))).cast("int") + 1
    plain = usable.select(y.alias("lang"), F.xxhash64(i).alias("h"), t.substr(start, F.lit(chars)).alias("text"))
    # ids are counted to a few hundredths; the share is wide enough that this and chance leave `rows` of them
    counts = plain.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not counts:
        return []
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1 << 40, int((2 * rows + 50) / max(r["n"], 1) * (1 << 40)))) for r in counts], "lang string, share long")
    few = plain.join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(1 << 40)) < F.col("share"))
    got = few.groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    out, by_lang = [], {}
    for r in got:
        by_lang.setdefault(r["lang"], []).append((r["h"], r["text"]))
    for lang in sorted(by_lang):
        # the lowest of the hash that chose them: a larger share would give the same rows
        out += [(lang, text) for h, text in sorted(by_lang[lang], key=lambda x: (x[0] % (1 << 40), x[0]))[:rows]]
    return out


def predictor(sent):
    """batches, text column -> (batch, predictions, scores); the batches come cut to bounded size."""

    def run(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str], list[float]]]:
        model = sent.value
        labeller = None
        if model:  # one a worker: words learned in one task serve the next
            labeller = model.__dict__.get("labeller") or model.__dict__.setdefault("labeller", Labeller(model))
        for b in regroup(batches, 2 << 20):
            texts = [t or "" for t in b.column(at).to_pylist()]
            if labeller is None:
                yield b, [UNKNOWN] * len(texts), [0.0] * len(texts)
                continue
            sums, sizes = labeller.sums(texts)
            best = sums.argmax(axis=1)
            pred = [model.langs[k] if n else UNKNOWN for k, n in zip(best.tolist(), sizes.tolist(), strict=True)]
            yield b, pred, np.clip(sums.max(axis=1) / np.maximum(sizes, 1), 0, 1).tolist()

    return run


def _predict(sent):
    predict = predictor(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, pred, score in predict(batches, 1):
            yield pa.record_batch([b.column(0).cast(pa.int64()), b.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score.

    The language with the largest sum of its words' marginals, and their mean. A text that is null, empty or without a
    letter is `und` with score 0; so is every text when no labelled row could be learned from. Ties go to the language
    that comes first by name. Repeated rows give repeated results; an empty table none; other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    if model is None:
        rows = sample(docs, id_col, text_col, lang_col)
        model = fit(rows) if rows else None
    sent = spark.sparkContext.broadcast(model)
    plain = pick(docs, id_col, text_col).withColumn("_held", held_out(id_col))
    return plain.mapInArrow(_predict(sent), "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
