"""Personal data in texts: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is small (8 units a direction, coupled input and forget gates, clipped-linear gates), trained in numpy on
labelled spans: base spans in a bounded sample of documents, and spans of the four kinds (also in spellings that the
patterns miss) set into stretches of them. Every character of every text is decoded: texts are cut into overlapping
windows, all windows of a batch step through the network together, each is decoded by Viterbi, and windows are
reconciled into one tag sequence a text by taking each character from the window that has more context around it. A run
of one tag is a span wherever windows were cut. Spans that pass a check of their kind and touch no base span are added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import pick, ready, regroup
from lintlake.llm.langid import crf_gradient

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A whole chain of dotted numbers; tried only where a number begins, so each number is read at most four times.
_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile("[0-9]++")
_DIGIT = re.compile("[0-9]").search

#: Bounds of the fitting sample: documents, and characters of each.
DOCS, CHARS = 400, 2_000
UNITS, EMBED, TAGS = 8, 6, 5
WINDOW, OVERLAP = 384, 48
STEPS, BATCH, SPAN = 500, 192, 72
#: What a span must be worth, in log-odds a character, beyond plain text.
CAUTION = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses without overlap. The part before an @ is the run of its characters that ends there, so each @ is judged alone and no character is read twice on either side."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        low = host.end() if host else at + 1
        at = text.find("@", low)


def byte(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    few = digits.lstrip("0")
    return len(few) < 3 or len(few) == 3 and few <= "255"


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost runs of four dotted numbers without overlap, each number at most 255: a chain of numbers holds one for every four of them."""
    for m in _CHAIN.finditer(text):
        numbers = list(_NUMBER.finditer(text, *m.span()))
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            if all(byte(x[0]) for x in four):
                yield four[0].start(), four[3].end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start; matches that fail their test are dropped without another try. The work grows with the text alone, whatever its runs."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [(0, *x) for x in emails(text)]
    if _DIGIT(text):
        if "." in text:
            out += [(1, *x) for x in addresses(text)]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 40 else ""  # 19 digits and 18 marks at most
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def plausible(kind: int, s: str) -> bool:
    """The exact check behind the network: whether the span can be of its kind at all."""
    digits = re.sub("[^0-9]", "", s)
    if kind == 0:
        return re.search(r"@|\bat\b|\(at\)|\[at\]", s.lower()) is not None and re.search(r"\.[a-z]|\bdot\b", s.lower()) is not None and len(s) >= 7
    if kind == 1:
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and re.fullmatch(r"[0-9. \[\]()]+", s) is not None
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search("[A-Za-z]", s)
    return 10 <= len(digits) <= 15 and re.search("[A-Za-z]", s) is None and re.search(r"[ ().-]", s) is not None and not luhn_like(s, digits)


def luhn_like(s: str, digits: str) -> bool:
    """Whether a would-be telephone number is one plain run of digits in four-digit groups, as cards are written."""
    return re.fullmatch(r"(?:[0-9]{4}[ -]?){3,4}[0-9]*", s) is not None


def codes(text: str) -> np.ndarray:
    """One byte for each code point: ASCII as it is, everything else as `?`."""
    return np.frombuffer(text.encode("ascii", "replace"), np.uint8)


@dataclass
class Net:
    embed: np.ndarray  # EMBED x 128
    fwd: np.ndarray  # 3 UNITS x (EMBED + UNITS + 1): forget, output, candidate
    bwd: np.ndarray
    out: np.ndarray  # TAGS x (2 UNITS + 1)
    trans: np.ndarray  # TAGS x TAGS

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.fwd, self.bwd, self.out, self.trans]


def new_net(rng: np.random.Generator) -> Net:
    cell = lambda: np.concatenate([rng.normal(0, 0.35, (3 * UNITS, EMBED + UNITS)), np.repeat([1.0, 0.0, 0.0], UNITS)[:, None]], axis=1)
    trans = np.full((TAGS, TAGS), -20.0)  # one kind never turns straight into another
    trans[0, :], trans[:, 0] = -1.0, -1.0
    trans[np.arange(TAGS), np.arange(TAGS)] = 1.0
    return Net(rng.normal(0, 0.5, (EMBED, 128)), cell(), cell(), rng.normal(0, 0.3, (TAGS, 2 * UNITS + 1)), trans)


def _run(x: np.ndarray, w: np.ndarray, keep: list | None = None) -> np.ndarray:
    """One direction over x (T, EMBED, B): the hidden states (T, UNITS, B). keep: collects what the backward pass needs."""
    t_all, _, b = x.shape
    u = UNITS
    w = w.astype(np.float32) if keep is None else w
    scaled = w.copy()
    scaled[: 2 * u] *= 0.25
    scaled[: 2 * u, -1] += 0.5
    inp = np.ones((EMBED + u + 1, b), x.dtype)
    inp[EMBED:-1] = 0
    c, hs = np.zeros((u, b), x.dtype), np.empty((t_all, u, b), x.dtype)
    z, d = np.empty((3 * u, b), x.dtype), np.empty((u, b), x.dtype)
    for t in range(t_all):
        inp[:EMBED] = x[t]
        np.matmul(scaled, inp, out=z)
        f, o, g = z[:u], z[u : 2 * u], z[2 * u :]
        if keep is not None:
            before = inp.copy(), c.copy()
        np.clip(z[: 2 * u], 0, 1, out=z[: 2 * u])
        np.clip(g, -1, 1, out=g)
        np.subtract(c, g, out=d)
        np.multiply(d, f, out=d)
        np.add(g, d, out=c)
        h = hs[t]
        np.multiply(o, c, out=h)
        inp[EMBED:-1] = h
        if keep is not None:
            keep.append((*before, f.copy(), o.copy(), g.copy(), c.copy()))
    return hs


def _back(dh_all: np.ndarray, w: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a direction: of its inputs (T, EMBED, B) and its weights."""
    t_all, u, b = dh_all.shape
    dw, dx = np.zeros_like(w), np.empty((t_all, EMBED, b))
    dh, dc = np.zeros((u, b)), np.zeros((u, b))
    for t in range(t_all - 1, -1, -1):
        inp, c_old, f, o, g, c = kept[t]
        dh = dh + dh_all[t]
        dc = dc + dh * o
        dz = np.concatenate([0.25 * dc * (c_old - g) * ((f > 0) & (f < 1)), 0.25 * dh * c * ((o > 0) & (o < 1)), dc * (1 - f) * (np.abs(g) < 1)])
        dw += dz @ inp.T
        di = w.T @ dz
        dx[t], dh, dc = di[:EMBED], di[EMBED:-1], dc * f
    return dx, dw


def train(windows: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = 3) -> Net:
    """Fits to windows (N, T) of character codes with a tag for each character, by Adam on the CRF's likelihood."""
    rng = np.random.default_rng(seed)
    net = new_net(rng)
    m, v = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    allowed = net.trans > -19
    for step in range(1, steps + 1):
        part = rng.integers(0, len(windows), BATCH)
        ids, y = windows[part].T, tags[part]
        x = net.embed[:, ids].transpose(1, 0, 2)
        kf, kb = [], []
        hf, hb = _run(x, net.fwd, kf), _run(x[::-1], net.bwd, kb)[::-1]
        h = np.concatenate([hf, hb, np.ones((len(x), 1, x.shape[2]))], axis=1)
        e = np.einsum("ku,tub->btk", net.out, h)
        g_e, g_t = crf_gradient(e, y, net.trans)
        g_out = np.einsum("btk,tub->ku", g_e, h)
        dh = np.einsum("ku,btk->tub", net.out[:, :-1], g_e)
        dxf, dwf = _back(dh[:, :UNITS], net.fwd, kf)
        dxb, dwb = _back(dh[::-1, UNITS:], net.bwd, kb)
        dx = dxf + dxb[::-1]
        g_emb = np.stack([np.bincount(ids.ravel(), dx[:, j].ravel(), 128) for j in range(EMBED)])
        rate = 0.02 * min(1, step / 20) * (1 - 0.9 * step / steps)
        for k, (p, g) in enumerate(zip(net.params(), (g_emb, dwf, dwb, g_out, g_t * allowed), strict=True)):
            g = g / BATCH
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def _viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (T, B) of emissions (T, TAGS, B); kinds are entered from plain text and left to it."""
    t_all, k, b = e.shape
    stay, enter, leave = (x.astype(np.float32)[:, None] for x in (np.diag(trans)[1:], trans[0, 1:], trans[1:, 0]))
    calm = np.float32(trans[0, 0])
    came = np.empty((t_all, k - 1, b), bool)  # whether a kind was entered here
    left = np.empty((t_all, b), np.int8)  # the tag before, where the tag is plain
    s0, s = e[0, 0].copy(), e[0, 1:].copy()
    for t in range(1, t_all):
        go, on = s0 + enter, s + stay
        out = s + leave
        np.greater(go, on, out=came[t])
        top = out.max(axis=0)
        s0 = s0 + calm
        out_wins = top > s0
        left[t] = 0
        if out_wins.any():
            at = np.flatnonzero(out_wins)
            left[t, at] = out[:, at].argmax(axis=0) + 1
            s0[at] = top[at]
        s0 += e[t, 0]
        s = np.maximum(go, on, out=on)
        s += e[t, 1:]
    tags = np.zeros((t_all, b), np.int8)
    now = np.where(s.max(axis=0) > s0, s.argmax(axis=0) + 1, 0).astype(np.int8)
    cols = np.arange(b)
    for t in range(t_all - 1, -1, -1):
        tags[t] = now
        if t:
            plain = left[t]
            if now.any():
                kind = np.maximum(now - 1, 0)
                now = np.where(now == 0, plain, np.where(came[t, kind, cols], 0, now)).astype(np.int8)
            else:
                now = plain
    return tags


def decode(net: Net, seqs: list[np.ndarray], caution: float = CAUTION) -> list[np.ndarray]:
    """Tags of every character of every sequence, from overlapping windows of all of them at once."""
    stride = WINDOW - OVERLAP
    owner, begin = [], []
    for i, s in enumerate(seqs):
        if len(s):
            n = 1 + max(0, -(-(len(s) - WINDOW) // stride))
            owner += [i] * n
            begin += range(0, n * stride, stride)
    out = [np.zeros(len(s), np.int8) for s in seqs]
    embed = net.embed.astype(np.float32)
    w_out = net.out.astype(np.float32).copy()
    w_out[0, -1] += caution
    for at in range(0, len(owner), 1024):
        own, beg = owner[at : at + 1024], begin[at : at + 1024]
        longest = max(min(WINDOW, len(seqs[i]) - b) for i, b in zip(own, beg, strict=True))
        ids = np.full((len(own), longest), 10, np.uint8)
        for r, (i, b) in enumerate(zip(own, beg, strict=True)):
            part = seqs[i][b : b + WINDOW]
            ids[r, : len(part)] = part
        x = np.empty((longest, EMBED, len(own)), np.float32)
        flat = ids.T
        for j in range(EMBED):
            x[:, j] = embed[j][flat]
        hf, hb = _run(x, net.fwd), _run(x[::-1], net.bwd)[::-1]
        e = np.matmul(w_out[:, :UNITS], hf)
        e += np.matmul(w_out[:, UNITS:-1], hb)
        e += w_out[:, -1:]
        tags = _viterbi(e, net.trans)
        for r in np.unique(np.concatenate([np.flatnonzero(tags.any(axis=0)), np.flatnonzero(np.array(beg) > 0)])).tolist():
            i, b = own[r], beg[r]
            skip = OVERLAP // 2 if b else 0  # this window knows the characters from here on better than the one before
            part = tags[skip : min(longest, len(seqs[i]) - b), r]
            out[i][b + skip : b + skip + len(part)] = part
    return out


def spans_of(tags: np.ndarray, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of a tag as spans that are plausible and touch no base span."""
    at = np.flatnonzero(tags)
    if not len(at):
        return []
    cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(tags[at]) != 0)) + 1
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    furthest = list(accumulate((e for _, e in taken), max))  # end of all base spans up to each
    out = []

    for run in np.split(at, cuts):
        kind, s, e = int(tags[run[0]]) - 1, int(run[0]), int(run[-1]) + 1
        while s < e and not (text[s].isalnum() or text[s] == "(" or text[s] == "+" and kind == 3):
            s += 1
        while e > s and not text[e - 1].isalnum():
            e -= 1
        k = bisect_left(starts, e)
        if e > s and (not k or furthest[k - 1] <= s) and plausible(kind, text[s:e]):
            out.append((kind, s, e))
    return out


def find(net: Net, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and all spans, both by kind, then start."""
    tags = decode(net, [codes(t) for t in texts])
    out = []
    for t, y in zip(texts, tags, strict=True):
        base = base_spans(t)
        out.append((base, sorted(base + spans_of(y, t, base))))
    return out


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(str(d) for d in rng.integers(0, 10, n))


def _make(kind: int, rng: np.random.Generator) -> str:
    """A span of a kind, in one of its spellings."""
    name = lambda lo, hi: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(lo, hi)))
    pick_one = lambda *xs: xs[int(rng.integers(len(xs)))]
    if kind == 0:
        user = name(2, 9) + pick_one("", "", f".{name(2, 7)}", _digits(rng, 2), f".{_digits(rng, 2)}", f"_{name(2, 5)}")
        host, end = name(3, 9) + pick_one("", _digits(rng, 1)), pick_one("com", "org", "net", "de", "fr", "es", "example.com", "co.uk")
        at, dot = pick_one(("@", "."), ("@", "."), ("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."))
        return f"{user}{at}{host}{dot}{end}"
    if kind == 1:
        return pick_one(".", ".", ".", " . ", "[.]", "(.)").join(str(int(n)) for n in rng.integers(0, 256, 4))
    if kind == 2:
        body = _digits(rng, int(pick_one(15, 15, 14)))
        body = pick_one("4", "5", "3", "2", "9", "1") + body[1:]
        full = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        sep = pick_one("", "", " ", "-", ".", " - ")
        return sep.join(full[i : i + 4] for i in range(0, len(full), 4)) if sep else full
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return pick_one(f"+1 ({a}) {b}-{c}", f"+{_digits(rng, 2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{_digits(rng, 2)} {a} {b}{c}", f"+{_digits(rng, 1)}{a}{b}{c}")


def _not(rng: np.random.Generator) -> str:
    """What only looks like personal data."""
    forms = (
        lambda: f"{rng.integers(1, 20)}.{rng.integers(0, 20)}", lambda: f"{rng.integers(1, 20)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}", lambda: f"20{_digits(rng, 2)}-{_digits(rng, 2)}-{_digits(rng, 2)}",
        lambda: 'token = "' + "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, 40)) + '"', lambda: _digits(rng, int(rng.integers(1, 9))), lambda: f"version {rng.integers(1, 9)}.", lambda: "Version 2.0.",
        lambda: "%%%", lambda: f"{_digits(rng, 2)}:{_digits(rng, 2)}", lambda: f"${_digits(rng, 3)},{_digits(rng, 3)}.00", lambda: "CC BY-NC 4.0.", lambda: f"section {rng.integers(1, 9)}.{rng.integers(1, 9)}.{rng.integers(1, 9)}.{rng.integers(300, 999)}",
    )
    return forms[int(rng.integers(len(forms)))]()


def training_windows(carriers: list[str], n: int = 6_000, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows of SPAN characters with tags: stretches of the carriers with their base spans, with a span of a kind, or with what only looks like one."""
    rng = np.random.default_rng(seed)
    texts = [t for t in carriers if len(t) > SPAN] or ["the quick brown fox jumps over the lazy dog and runs away. " * 4]
    based = [(t, base_spans(t)) for t in texts]
    real = [(t, b, s) for t, b in based for s in b]
    windows, tags = np.empty((n, SPAN), np.uint8), np.zeros((n, SPAN), np.int64)
    for i in range(n):
        how = rng.random()
        if how < 0.15 and real:
            t, b, (_, s, e) = real[int(rng.integers(len(real)))]
            at = int(np.clip(s - rng.integers(0, SPAN - 1), 0, len(t) - SPAN))
        else:
            t, b = based[int(rng.integers(len(based)))]
            at = int(rng.integers(0, len(t) - SPAN + 1))
        part, mine = t[at : at + SPAN], np.zeros(SPAN, np.int64)
        for k, s, e in b:
            mine[max(0, s - at) : max(0, e - at)] = k + 1
        if how > 0.35:
            kind = int(rng.integers(4))
            word = _make(kind, rng) if how > 0.6 else _not(rng)
            s = int(rng.integers(0, SPAN - 4))
            lead, tail = [("", " "), (" ", " "), (" ", ". "), (" ", ", "), ("\n", "\n"), (": ", " ")][int(rng.integers(6))]
            if lead == "" and kind != 0:
                lead = " "
            ins = lead + word + tail
            tag = np.zeros(len(ins), np.int64)
            if how > 0.6:
                tag[len(lead) : len(lead) + len(word)] = kind + 1
            part, mine = (part[:s] + ins + part[s:])[:SPAN], np.concatenate([mine[:s], tag, mine[s:]])[:SPAN]
        windows[i], tags[i] = codes(part), mine
    return windows, tags


def sample(docs: DataFrame, id_col: str, text_col: str, rows: int = DOCS, chars: int = CHARS) -> list[str]:
    """The carriers: `rows` documents by a hash of their ids (all where there are fewer), and of each a stretch of at most `chars` characters, placed by hash. The same rows give the same carriers, in whatever order they lie."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    total = docs.select(id_col).count()
    few = docs.filter(t.isNotNull() & (F.pmod(F.xxhash64(i), F.lit(1_000_003)) < min(1.0, 2 * rows / max(total, 1)) * 1_000_003))
    start = F.pmod(F.xxhash64(i, F.lit(1)), F.greatest(F.length(t) - chars + 1, F.lit(1))).cast("int") + 1
    chosen = few.select(F.pmod(F.xxhash64(i), F.lit(1_000_003)).alias("m"), F.xxhash64(i).alias("h"), t.substr(start, F.lit(chars)).alias("text"))
    return [r["text"] for r in chosen.orderBy("m", "h", "text").limit(rows).collect()]


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def finder(sent):
    """batches, text column -> (batch, texts, (base spans, all spans) of each); the batches come cut to bounded size."""

    def run(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str], list]]:
        for b in regroup(batches, 1 << 20):
            texts = [t or "" for t in b.column(at).to_pylist()]
            yield b, texts, find(sent.value, texts)

    return run


def _spans(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, found in finder(sent)(batches, 1):
            rows = [(*[sum(k == j for k, _, _ in base) for j in range(4)], hashlib.sha256(_written(base).encode()).hexdigest(), _written(every)) for base, every in found]
            cols = list(zip(*rows, strict=True))
            yield pa.record_batch([b.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Net:
    return train(*training_windows(sample(docs, id_col, text_col)))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Net | None = None) -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (kind:start:end of all spans, by kind, then start; code points, end exclusive).

    Null counts as empty and has no span. Repeated rows give repeated results; an empty table none; other columns are
    ignored.
    """
    spark = ready(docs.sparkSession)
    sent = spark.sparkContext.broadcast(net or fitted(docs, id_col, text_col))
    out = pick(docs, id_col, text_col).mapInArrow(_spans(sent), "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span as <KIND>; of overlapping spans the union is replaced, under the first one's kind."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:] if spans else text
