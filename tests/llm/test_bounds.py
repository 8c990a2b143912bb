"""What the corpus operators hold in memory, and letters beside signs that are none."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lintlake.llm import ann, exact_dedup, langid, pieces, token_counts, token_files

SCHEMA = "doc_id long, text string, lang string"


# --- 1


def folded_copies(n, body):
    """Batches as an owner gets them: one text, folded n times, each row with the text it carries."""
    names = ["fold", "key", "body", "chars", "id", "n", "handle", "c0", "c1"]
    for i in range(n):
        cols = [pa.array([v], t) for v, t in ((i, pa.int64()), (5, pa.int64()), (body, pa.binary()), (len(body), pa.int64()), (n - i, pa.int64()), (3, pa.int64()), (i, pa.int64()), (n - i, pa.int64()), (body.decode(), pa.string()))]
        yield pa.record_batch(cols, names=names)


@pytest.mark.parametrize("payload", [True, False])
def test_owner_of_a_hot_text_holds_one_row(monkeypatch, payload):
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()))
    body, peaks = b"x" * 100_000, []
    for n in (20, 400):
        before = pa.total_allocated_bytes()
        seen = []

        def watched(n=n, before=before, seen=seen):
            for b in folded_copies(n, body):
                seen.append(pa.total_allocated_bytes() - before)
                yield b

        out = list(exact_dedup._own(1, 64, payload)(watched()))
        peaks.append(max(seen))
        if payload:
            assert [b.num_rows for b in out] == [1] and out[0].column(0).to_pylist() == [1]
        else:
            assert sum(len(x) for b in out for x in b.column(11).to_pylist()) == n
    assert peaks[1] < peaks[0] + 2_000_000


def test_keep_one_with_hot_texts(spark):
    rng = random.Random(3)
    rows = [(i, "hot " * 50 + " " * rng.randrange(9), "en") for i in range(3_000)] + [(i, f"t{i % 700}" + " " * (i % 5), "de") for i in range(3_000, 6_000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(24)
    kept = sorted(tuple(r) for r in exact_dedup.keep_one(docs).collect())
    best = {}
    for r in rows:
        k = r[1].replace(" ", "")
        best[k] = min(best.get(k, r), r, key=lambda x: (-len(x[1]), x[0]))
    assert kept == sorted(best.values())


# --- 4


def test_token_files_of_one_id(spark):
    rng = random.Random(4)
    rows = [(None if i % 2 else 7, " ".join(rng.choice(("ab", "cd", "ef")) for _ in range(rng.randrange(30))), "en") for i in range(900)]
    got = token_files.token_files(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert len(got) == 900
    nulls, sevens = [r for r in got if r["doc_id"] is None], [r for r in got if r["doc_id"] == 7]
    assert len(nulls) == 450 == len(sevens) and max(r["start"] for r in nulls) < min(r["start"] for r in sevens)
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


# --- 6, 7, 10


def long_texts(n, size):
    rng = random.Random(6)
    return ["".join(rng.choice("abcdefgh\u65e5\u672c") for _ in range(size)) for _ in range(n)]


def test_stores_hold_no_long_pieces():
    from lintlake.llm.tokens import tokenizer_path

    texts = long_texts(4, 20_000)
    enc = token_counts.OffsetEncoder(tokenizer_path(token_counts.TOKENIZER))
    for t in texts:
        assert np.array_equal(enc.spans(t), enc.whole(t))
    assert all(len(x) <= token_counts.LONG for x in enc.store)
    piece = pieces.PieceEncoder(tokenizer_path(pieces.MODEL))
    first = piece.encode([*texts, "short words here"])
    assert all(len(x) <= pieces.LONG for x in piece.store) and piece.encode([*texts, "short words here"]) == first
    model = langid.fit([("en", "the cat and the dog"), ("de", "der hund und die katze")] * 3)
    lab = langid.Labeller(model)
    lab.sums(texts)
    assert all(len(x) <= langid.LONG for x in lab.store)


def test_language_words_are_forgotten_by_characters(monkeypatch):
    model = langid.fit([("en", "the cat and the dog"), ("de", "der hund und die katze")] * 3)
    monkeypatch.setattr(langid, "KEPT_CHARS", 50_000)
    lab = langid.Labeller(model)
    texts = long_texts(6, 20_000)
    one = [lab.sums([t])[0] for t in texts]
    assert lab.chars <= 70_000
    assert np.allclose(np.concatenate(one), langid.Labeller(model).sums(texts)[0])


def test_letters_beside_other_signs(spark):
    model = langid.fit([("en", "the cat and the dog"), ("de", "der hund und die katze")] * 3)
    assert langid.words_of("x\xb2 m\xb2 ab\xbdcd \u2167 7a \u65e5_b") == ["x", "m", "ab", "cd", "a", "\u65e5", "b"]
    texts = ["x\xb2", "m\xb2 ab\xbd", "\xb2\xb3", "\u2167", "\xaa", "12 34", "_", None, "", "\u00bd\xe9", "7x7"]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA), model=model).collect()}
    for i, t in enumerate(texts):
        letter = any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] != "und") == letter and (got[i]["score"] > 0) == letter, t


# --- 8


def test_nearest_centres_in_blocks(monkeypatch):
    rng = np.random.default_rng(8)
    u, c = ann.unit(rng.normal(size=(300, 6))), ann.unit(rng.normal(size=(20, 6)))
    whole = np.argsort(-(u @ c.T), axis=1, kind="stable")
    monkeypatch.setattr(ann, "SCORES", 100)
    assert (ann.near(u, c)[:, 0] == whole[:, 0]).all() and (ann.near(u, c, 4) == whole[:, :4]).all()
