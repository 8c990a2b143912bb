"""The corpus operators against brute force, libraries and round trips, and on tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.dataset as ds
import pytest
import xxhash
from pyspark.sql import functions as F

from lintlake.llm import ann, common, exact_dedup, langid, license_scan, packing, pieces, pii, queries, simhash, token_counts, token_files, tokens

SF = "/root/testdata/sf0.001"
#: Columns of the same names as the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, sha string, key string, chunk int, kept boolean, _id string, _k string"
LONG = "Das ist ein sehr langer Text und der geht weiter. " * 6000
TEXTS = [
    (1, "Hello  world\nfoo"), (2, "Helloworld foo"), (3, None), (4, ""), (5, "  \t\n"), (6, "Hello world foo"), (6, "Hello world foo"), (None, "Hello world foo"), (None, None), (7, LONG), (8, LONG + " "),
    (9, "mail a.b@c-d.example.org, ip 1.2.3.4 and 300.1.1.1, card 4111 1111 1111 1111, call +49 (030) 123-4567."), (10, "日本語のテスト。"), (11, "12345 %%%"), (12, "Released under the MIT License."), (13, "<|endoftext|> x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), 7, 7, "sha", "key", 1, False, "x", "y") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return ds.dataset(f"{SF}/documents.parquet").to_table().to_pylist()


def rows(df):
    return [tuple(r) for r in df.collect()]


OPERATORS = [exact_dedup.exact_dedup, license_scan.license_scan, simhash.simhash_dedup, token_files.token_files, pii.personal_data, token_counts.token_counts, pieces.piece_ids, packing.pack, langid.identify]


@pytest.mark.parametrize("op", OPERATORS, ids=lambda f: f.__name__)
def test_empty_table(op, none):
    assert rows(op(none)) == []


# --- 1 exact dedup


def test_exact_dedup_odd_rows(odd):
    got = rows(exact_dedup.exact_dedup(odd))
    assert len(got) == len(TEXTS)
    by = {}
    for i, keep, size, kept, sha in got:
        by.setdefault(sha, []).append((i, keep, size, kept))
    for sha, members in by.items():
        same = [(i, t) for i, t in TEXTS if hashlib.sha256((t or "").encode().translate(None, b" \t\n\x0b\x0c\r")).hexdigest() == sha]
        best = min(same, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        assert len(members) == len(same) == members[0][2] and {m[1] for m in members} == {best[0]}
        assert sum(m[3] for m in members) == 1


def test_exact_dedup_keeps_whole_rows(odd):
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({(t or "").translate(str.maketrans("", "", " \t\n\v\f\r")) for _, t in TEXTS})


def test_extendible_hash_splits_and_chains():
    index, rng = exact_dedup.ExtendibleHash(4), random.Random(1)
    keys = [rng.getrandbits(64) for _ in range(500)]
    for k in keys:
        index.put(k, b"%d" % k)
    second = index.put(keys[0], b"second")
    assert index.put(keys[0], b"second") is second is index.find(keys[0], b"second") and index.find(1, b"") is None
    assert all(index.find(k, b"%d" % k).body == b"%d" % k for k in keys) and index.find(keys[1], b"second") is None
    assert len(index.directory) == 1 << index.depth and max(len(b.chains) for b in index.directory) <= 4
    for b in set(index.directory):
        slots = [i for i, x in enumerate(index.directory) if x is b]
        assert len({k >> (64 - b.depth) for k in b.chains} if b.depth else ()) <= 1 and len(slots) == 1 << (index.depth - b.depth) and b.first == slots[0] << (64 - index.depth)


def test_buckets_complete_as_keys_ascend():
    index, rng = exact_dedup.ExtendibleHash(4), random.Random(2)
    keys, got, most = sorted(rng.getrandbits(64) for _ in range(2000)), [], 0
    for k in keys:
        index.put(k, b"")
        got += [x for b in index.completed(k) for x in b.chains]
        most = max(most, sum(len(b.chains) for b in set(index.directory) if b))
    got += [x for b in index.completed(None) for x in b.chains]
    assert got == keys and most <= 8  # one open bucket, and what a split left beside it


def owned(cols, **options):
    import pyarrow as pa
    from unittest import mock

    names = ["fold", "key", "body", "chars", "id", "n", "handle"]
    with mock.patch("pyspark.TaskContext.get") as ctx:
        ctx.return_value.partitionId.return_value = 0
        return [r for b in exact_dedup._own(1, 512, False)(iter([pa.record_batch([pa.array(c) for c in cols], names=names)])) for r in b.to_pylist()]


def test_colliding_keys_stay_apart():
    got = owned([[10, 11, 12], [5, 5, 5], [b"a", b"b", b"a"], [1, 2, 3], [1, 2, 3], [1, 1, 4], [7, 8, 9]])
    assert [(r["key"], r["chain"], r["keep_id"], r["group_size"], r["folds"]) for r in got] == [(5, 0, 3, 5, [10, 12]), (5, 1, 2, 1, [11])]


def test_an_entry_of_many_folds_has_many_rows(monkeypatch):
    monkeypatch.setattr(exact_dedup, "NAMED", 2)
    got = owned([list(range(5)), [5] * 5, [b"a"] * 5, [1] * 5, [3, 1, 2, None, 1], [1] * 5, list(range(5))])
    assert [(r["part"], r["keep_id"], r["keep_handle"], r["group_size"], r["folds"]) for r in got] == [(0, 1, 1, 5, [0, 1]), (1, 1, 1, 5, [2, 3]), (2, 1, 1, 5, [4])]


@pytest.mark.parametrize("small", [False, True])
def test_exact_dedup_equals_grouping(spark, monkeypatch, small):
    if small:  # many buckets, folds and owners
        monkeypatch.setattr(exact_dedup, "FOLD_BYTES", 2000)
        monkeypatch.setattr(exact_dedup, "FOLD_ROWS", 5)
        monkeypatch.setattr(exact_dedup, "OWNER_BYTES", 5000)
    rng = random.Random(4)
    data = [(rng.choice([None, *range(60)]), "".join(rng.choices("ab \t\u00e9", k=rng.randrange(6)))) for _ in range(600)] + [(7, "hot")] * 300
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    strip = lambda t: re.sub("[ \t\n\v\f\r]", "", t)
    groups = {}
    for i, t in data:
        groups.setdefault(strip(t), []).append((-len(t), i is None, i or 0))
    best = {hashlib.sha256(k.encode()).hexdigest(): (min(v), len(v)) for k, v in groups.items()}
    got = exact_dedup.exact_dedup(df, capacity=4 if small else 512).collect()
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(got) == len(data) and sorted(kept) == sorted(best)
    for r in got:
        (_, none, i), n = best[r.text_sha256]
        assert (r.keep_id, r.group_size) == (None if none else i, n) and (not r.kept or r.doc_id == r.keep_id)
    whole = exact_dedup.keep_one(df, capacity=4 if small else 512).collect()
    assert sorted((hashlib.sha256(strip(r.text).encode()).hexdigest(), -len(r.text), r.doc_id is None, r.doc_id or 0) for r in whole) == sorted((k, *b) for k, (b, _) in best.items())


# --- 2 licences


def test_license_scan_normalises(spark):
    mit = dict((k, t) for k, t in license_scan.KNOWN)["MIT"]
    variants = [mit.upper().replace(",", " ; "), "Copyright (c) 2020 Somebody\n\n" + mit.replace("\n", "\n\n  "), mit + "\nAll rights reserved.", mit.replace("sublicense", "sublicence"), mit + " extra", "x\nRELEASED under the  mit licence!\ny", None, "", "(c) 1999 only"]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(variants)), "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(9)] == ["MIT"] * 4 + [None] * 5
    assert got[5].line_licenses == "MIT" and got[5].n_license_lines == 1 and all(got[i].text_digest is None for i in (6, 7, 8))


def test_licence_form_of_neighbours_and_copyright_lines(spark):
    rows_in = ["licence licence licences", "copyright notice and this permission", "Copyright (c) 2020 A\nx", "Copyright 2020 A\nx", "(c) You must retain\nx", "Copyright [yyyy] [name]\nx", "\u00a9 A\nx", "copyright by A\nx", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows_in)], "i int, t string")
    got = [r.f for r in df.select("i", license_scan.canonical(F.col("t")).alias("f")).orderBy("i").collect()]
    assert got == ["license license licenses", "copyright notice and this permission", "x", "x", "c you must retain x", "x", "x", "x", None, ""]


def test_isc_in_its_published_wrapping(spark):
    text = """ISC License

Copyright (c) 2020 Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
    got = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert got[0].license == "ISC"


def test_license_scan_odd_rows(odd):
    got = license_scan.license_scan(odd).collect()
    assert len(got) == len(TEXTS) and [r.line_licenses for r in got if r.doc_id == 12] == ["MIT"] and all(r.text_digest is None for r in got if r.doc_id in (3, 4, 5))


def test_whole_licence_files(spark):
    from lintlake.llm import license_texts as t

    mit = dict(license_scan.KNOWN)["MIT"]
    apache, gpl = t.APACHE.replace("[yyyy] [name of copyright owner]", "2020 Somebody"), t.GPL
    files = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + mit), ("Apache-2.0", apache), ("Apache-2.0", apache[: apache.index("   APPENDIX")]), ("GPL-3.0", gpl),
        ("ISC", "ISC License\n\nCopyright (c) 2020 Somebody\n\n" + t._GRANT.format("/or") + t._KEEP + t._AS_IS), ("0BSD", t._GRANT.format("/or") + ".\n" + t._AS_IS),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, Somebody\nAll rights reserved.\n\n" + t._BSD + t._BSD_NAMES + t._BSD_END), (None, apache[:-40]),
    ]
    got = {r.doc_id: r.license for r in license_scan.license_scan(spark.createDataFrame([(i, x) for i, (_, x) in enumerate(files)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(files))] == [x for x, _ in files]


# --- 3 near dedup


def slow_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprints(docs):
    for t in [d["text"] for d in docs[:60]] + [t for _, t in TEXTS[:7]] + ["a b c d e", "Ünï ÀB c\x0bd\x0ce f"]:
        assert simhash.fingerprint((t or "").encode()) == slow_print(t)


@pytest.mark.parametrize("fine", [False, True])
def test_every_close_pair_meets_at_a_home(fine):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    u = np.unique(np.r_[base, *[[b ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, False).astype(np.uint64)) for b in base] for k in range(1, 6)]].astype(np.uint64))
    r, a, h = simhash.replicas(u, fine)
    there, homes = {}, {}
    for x, k, z in zip(r.tolist(), a.tolist(), h.tolist(), strict=True):
        there.setdefault(k, set()).add(x)
        if z:
            homes.setdefault(k, set()).add(x)
    met = {(min(x, y), max(x, y)) for k, hs in homes.items() for x in hs for y in there[k]}
    close = {(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if int(u[i] ^ u[j]).bit_count() <= 4}
    assert close and close <= met


def brute_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash_components(spark, docs, monkeypatch):
    rng = random.Random(3)
    texts = [d["text"] for d in docs[:60]]
    for t in texts[:25]:
        w = t.split(" ")
        for _ in range(3):
            v = list(w)
            for _ in range(max(1, len(v) // 60)):
                v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += [None, "", "one"]
    prints = [slow_print(t) for t in texts]
    comp = brute_components(prints)
    least = {c: min(i for i, x in enumerate(comp) if x == c) for c in comp}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for cell, fine in ((simhash.CELL, simhash.FINE_FROM), (8, simhash.FINE_FROM), (simhash.CELL, 0)):  # plain, in grids, by pairs of blocks
        monkeypatch.setattr(simhash, "CELL", cell)
        monkeypatch.setattr(simhash, "FINE_FROM", fine)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_dedup(df).collect()}
        assert got == {i: (f"{p:016x}", least[c]) for i, (p, c) in enumerate(zip(prints, comp, strict=True))}


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(df).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


def test_simhash_odd_rows(odd):
    got = rows(simhash.simhash_dedup(odd))
    assert len(got) == len(TEXTS) and all(r[2] is not None for r in got)
    assert simhash.keep_one(odd).columns == odd.columns


# --- 4 and 9 tokens


def library_ids(texts, name=tokens.DEFAULT):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


ODD_TEXTS = ["", " ", "a\tb,c", "The<|endoftext|>End", "é ́x É,É. İstanbul, ΑΣ. ΣΑΣ, don't, it's. 's. x', 1,2. 3. a b ,. .., a.) (b., \x1c a\x1cb\r\n ǅ. ａ, ²,", "日本語。テスト, \U0001f600.\U0001f600, K. ﬁ, Å", "x" * 500, "\n\n\n  a  b\n \n\n\nc", "  \r\n\tmixed  white space "]


def test_piecewise_encoding_is_whole_encoding(docs):
    texts = [d["text"] for d in docs[:80]] + ODD_TEXTS
    got = tokens.WordEncoder(tokens.tokenizer_path()).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == library_ids(texts)


def test_piecewise_encoding_with_full_stores(docs, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 20)
    texts = [d["text"] for d in docs[:20]] + ODD_TEXTS
    e = tokens.WordEncoder(tokens.tokenizer_path())
    assert [np.frombuffer(g, "<u4").tolist() for g in e.encode(texts)] == library_ids(texts)
    assert len(e.store.older) > 10


def test_runs_are_kept_and_given_up_by_use(docs, monkeypatch):
    monkeypatch.setattr(tokens, "TABLE", 50, raising=False)
    e = tokens.WordEncoder(tokens.tokenizer_path())
    asked, split = [], []
    model, word = e.model, e._word
    monkeypatch.setattr(e, "model", type("Model", (), {"tokenize": lambda self, w: (asked.append(w), model.tokenize(w))[1]})())
    monkeypatch.setattr(e, "_word", lambda w: (split.append(w), word(w))[1])
    for i in range(30):  # each batch has runs that all have, and its own
        texts = ["often seen, often. seen$$$ often,,", " ".join(f"{w}{a}{b}," for w in (chr(97 + i % 26) * 3, "zq" + chr(97 + i // 26)) for a in "bcd" for b in "xyz"), "x" * 300 + f"{chr(97 + i % 26)}. 12ab-c d2, "]
        assert [np.frombuffer(g, "<u4").tolist() for g in e.encode(texts)] == library_ids(texts)
        assert len(e.table.place) <= 50
        assert max(map(len, e.table.place)) <= tokens.LONG
    assert asked.count("often") == asked.count("seen") == 1
    assert not {"seen,", "often.", "seen$$$", "often,,"} & set(split)  # marks are trimmed by Arrow, not word by word


def test_piecewise_encoding_of_random_characters():
    rng = random.Random(9)
    latin = [chr(c) for c in range(1, 256) if not 0xD8 <= c >> 8 <= 0xDF]
    wide = [*"abc .,'", "́", "İ", "ﬁ", "中", "　", "\u2028", "Å", "٣", "Ⅷ", "ª", "ǅ"]
    texts = ["".join(rng.choices(chars, k=rng.randrange(1, 30))) for chars in (latin, wide, [*"aB \n.,'s1|<"]) for _ in range(400)]
    got = tokens.WordEncoder(tokens.tokenizer_path()).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == library_ids(texts)


@pytest.mark.parametrize("least", [2, 5, 50])
def test_re_pair_round_trip_and_slices(least):
    rng = np.random.default_rng(least)
    for ids in (np.zeros(0, np.uint32), np.array([3], np.uint32), np.full(33, 7, np.uint32), np.tile([1, 2, 3], 400).astype(np.uint32), rng.zipf(1.5, 5000).clip(0, 40_000).astype(np.uint32)):
        g = token_files.re_pair(ids, least=least)
        h = token_files.grammar(g.base, g.rules.astype("<i4").tobytes(), g.sizes.astype("<i4").tobytes(), g.symbols.astype("<i4").tobytes())
        assert (h.expand(h.symbols) == ids).all()
        for _ in range(20):
            s = int(rng.integers(0, len(ids) + 1))
            n = int(rng.integers(0, len(ids) - s + 1))
            assert (h.slice(s, n) == ids[s : s + n]).all()
    assert len(token_files.re_pair(np.tile([1, 2], 2000).astype(np.uint32), least=2).symbols) < 40


def test_re_pair_groups_no_pairs_that_are_surely_rare(monkeypatch):
    ids = np.random.default_rng(4).zipf(1.3, 300_000).clip(0, 40_000).astype(np.uint32)
    grouped, array = [], token_files.pa.array
    monkeypatch.setattr(token_files.pa, "array", lambda x, *more: (grouped.append(len(x)), array(x, *more))[1])
    g = token_files.re_pair(ids)
    assert (g.expand(g.symbols) == ids).all()
    assert sum(grouped) < 0.7 * len(ids)


def test_token_files_odd_rows(odd):
    got = rows(token_files.token_files(odd, shard_ids=64, least=2))
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    want, at = [], 0
    for (i, _), ids in zip(order, library_ids([t for _, t in order]), strict=True):
        ids = np.array([*ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_re_pair_goes_on_to_the_end():
    rng = np.random.default_rng(8)
    for _ in range(40):
        ids = rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(0, 500))).astype(np.uint32)
        least = int(rng.integers(2, 6))
        g = token_files.re_pair(ids, least=least)
        assert (g.expand(g.symbols) == ids).all()
        pairs = g.symbols[:-1].astype(np.int64) << 32 | g.symbols[1:]
        assert not len(pairs) or np.unique(pairs, return_counts=True)[1].max() < least
    with pytest.raises(ValueError):
        token_files.re_pair(np.array([token_files.BASE], np.uint32))


def test_fetch_decodes_single_documents(spark, odd):
    path = f"{common.shared_dir(spark)}/fetch-test-{random.getrandbits(64):x}"
    token_files.write_token_files(odd, path, shard_ids=64)
    got = sorted((r.doc_id, r.ids) for r in token_files.fetch(spark, path, [9, 6, 3, 99]).collect())
    texts = dict(TEXTS)
    assert got == sorted((i, [*ids, 2]) for i, ids in zip((9, 6, 6, 3), library_ids([texts[9], texts[6], texts[6], None]), strict=True))
    assert token_files.fetch(spark, path, []).count() == 0


def packed_right(got, texts, room, end):
    want = sorted((i, p, s, len(ids[s : s + room]), zlib.crc32(np.array(ids[s : s + room], "<u4").tobytes())) for (i, _), raw in zip(texts, library_ids([t for _, t in texts]), strict=True) for ids in [[*raw, end]] for p, s in enumerate(range(0, len(ids), room)) if i is not None)
    assert sorted(r[:5] for r in got if r[0] is not None) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r[5], []).append((r[6], r[3]))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= room
    return len(seqs)


def test_packing_odd_rows(odd):
    got = rows(packing.pack(odd, room=64))
    lengths = [r[3] for r in got]
    assert packed_right(got, TEXTS, 64, 0) >= -(-sum(lengths) // 64)


def optimum(lengths, room):
    """Fewest bins by exhaustive search."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for r in {b for b in bins if b >= lengths[i]}:
            k = bins.index(r)
            go(i + 1, [*bins[:k], r - lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, room - lengths[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(3, 20) for _ in range(11)), reverse=True)
    counts = {k: lengths.count(k) for k in lengths}
    found = packing.complete(counts, 20)
    held = {}
    for n, f in found:
        assert sum(k * c for k, c in f) <= 20
        for k, c in f:
            held[k] = held.get(k, 0) + n * c
    assert held == counts and packing.bound(counts, 20) <= optimum(lengths, 20)
    assert sum(n for n, _ in found) == optimum(lengths, 20)


@pytest.mark.parametrize("seed", range(25))
def test_search_without_bound_proves_the_optimum(seed):
    rng = random.Random(100 + seed)
    lengths = [rng.randint(*rng.choice([(2, 9), (5, 14), (9, 20)])) for _ in range(rng.randint(3, 10))]
    found = packing.search({k: lengths.count(k) for k in lengths}, 20, None)
    assert found.proved and sum(n for n, _ in found.packing) == optimum(sorted(lengths, reverse=True), 20) >= found.bound


def test_planted_perfect_packings():
    rng, hit = random.Random(5), 0
    for _ in range(20):
        lengths = []
        for _ in range(6):
            a = rng.randint(20, 50)
            b = rng.randint(10, 90 - a)
            lengths += [a, b, 100 - a - b]
        found = packing.search({k: lengths.count(k) for k in lengths}, 100)
        hit += sum(n for n, _ in found.packing) == 6 and found.proved
    assert hit == 20


def test_a_cut_search_says_so():
    rng = random.Random(1)
    lengths = [rng.randint(400, 1100) for _ in range(300)]
    counts = {k: lengths.count(k) for k in lengths}
    found = packing.search(counts, 2048, 1)
    assert not found.proved and found.bound < sum(n for n, _ in found.packing) and packing.search({2048: 3}, 2048, 1).proved
    assert sum(n * k * c for n, f in found.packing for k, c in f) == sum(lengths)


def test_every_filling_is_every_maximal_one():
    import itertools

    left = {3: 2, 5: 1, 7: 2, 9: 1}
    sizes = sorted(left)
    got = [f for f in packing.every_filling(17, left, sizes, 17) if f is not None]
    items = [k for k, n in left.items() for _ in range(n)]
    every = {tuple(sorted(c, reverse=True)) for r in range(len(items) + 1) for c in itertools.combinations(items, r) if sum(c) <= 17}
    maximal = {f for f in every if not any(f.count(k) < n and sum(f) + k <= 17 for k, n in left.items())}
    assert len(got) == len(set(got)) and set(got) == maximal


def test_bin_completion_beats_best_fit():
    counts = {44: 2, 24: 2, 32: 2, 43: 1, 30: 1, 27: 1}  # three exact triples; best-fit decreasing needs a fourth bin
    assert sum(n for n, _ in packing.complete(counts, 100)) == 3 < sum(n for n, _ in packing.best_fit(counts, 100))


# --- 5 personal data


def base_by_pattern(t):
    luhn = lambda d: sum((n * 2 - 9 * (n > 4)) if i % 2 else n for i, n in enumerate(int(c) for c in reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0])]


@pytest.fixture(scope="module")
def net(docs):
    return pii.train(*pii.training_windows([d["text"][:2000] for d in docs], 2500), steps=250)


def test_base_spans(docs):
    for t in [d["text"] for d in docs] + [t or "" for _, t in TEXTS] + ["0001.2.3.4 1.2.3.4.5 +1234567890123456 ++49 30 1234567 a@b a@b.c@d.e 4111-1111-1111-1111"]:
        assert pii.base_spans(t) == base_by_pattern(t)


def test_base_spans_of_random_texts():
    rng = random.Random(12)
    for _ in range(20_000):
        t = "".join(rng.choices("a1@..+- %_(\n92560", k=rng.randrange(1, 28)))
        assert pii.base_spans(t) == base_by_pattern(t), t


def test_long_runs_take_linear_time():
    import time

    n = 5_000_000
    began = time.time()
    for text, count in (("0" * 5000 + "1.2.3.4", 1), ("1" * n + ".", 0), ("0" * n, 0), ("a" * n + "@", 0), ("a" * n + "@b." + "c" * n, 1), ("+1" + "(" * n, 0), ("1 " * (n // 2), 0), ("@" * n, 0), ("+1" * (n // 2), 0)):
        assert len(pii.base_spans(text)) == count
    assert time.time() - began < 60  # the patterns tried at each place took hours


def test_added_spans_touch_no_base_span():
    text = "1.2.3.4 and 4.3.2.1 " * 20_000
    base, tags = pii.base_spans(text), np.zeros(len(text), np.int8)
    tags[2::20] = 2
    assert len(base) == 40_000 and pii.spans_of(tags, text, base) == []
    tags[:] = 0
    mine = "x a.b@c.de and (at) q (at) r.com"
    tags = np.zeros(len(mine), np.int8)
    tags[mine.index("q (at)") :] = 1
    assert pii.spans_of(tags, mine, pii.base_spans(mine)) == [(0, mine.index("q (at)"), len(mine))]


def test_carriers_do_not_depend_on_row_order(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    a, b = pii.sample(df.repartition(7), "doc_id", "text", rows=50), pii.sample(df.coalesce(1), "doc_id", "text", rows=50)
    assert a == b and len(a) == 50


def test_network_learns_and_windows_agree(net, docs):
    w, y = pii.training_windows([d["text"][:2000] for d in docs], 300, 77)
    tags = np.array(pii.decode(net, list(w)))
    assert (tags == y)[y > 0].mean() > 0.8 and (tags == y)[y == 0].mean() > 0.97
    text = "the of and " * 31 + "write to jane.doe7@mail9.example.com now " + "and so on " * 200  # a span across a window's edge
    (tags,) = pii.decode(net, [pii.codes(text)])
    s = text.index("jane")
    assert (tags[s + 2 : s + 26] == 1).mean() > 0.8


def test_viterbi_equals_exhaustive():
    import itertools

    rng = np.random.default_rng(4)
    trans = rng.normal(size=(5, 5))
    for a in range(1, 5):
        for b in range(1, 5):
            if a != b:
                trans[a, b] = -1e9
    e = rng.normal(size=(5, 5, 3)).astype(np.float32)
    got = pii._viterbi(e, trans)
    for r in range(3):
        score = lambda p: sum(e[t, k, r] for t, k in enumerate(p)) + sum(trans[a, b] for a, b in itertools.pairwise(p))  # noqa: E731, B023
        assert tuple(got[:, r]) == max(itertools.product(range(5), repeat=5), key=score)


def test_personal_data_odd_rows(odd, net):
    got = rows(pii.personal_data(odd, net=net))
    assert len(got) == len(TEXTS)
    for r in got:
        text = next(t for i, t in TEXTS if i == r[0]) or ""
        base = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base_by_pattern(text)]
        assert r[5] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r[6].split(","))
    assert next(r[1:5] for r in got if r[0] == 9) == (1, 1, 1, 1)


def test_redaction():
    assert pii.redacted("a b@c.de x", [(0, 2, 8)]) == "a <EMAIL> x" and pii.redacted("abc", []) == "abc"


# --- 6 token counts


def test_offsets_are_the_librarys(docs):
    enc = token_counts.OffsetEncoder(tokens.tokenizer_path(token_counts.TOKENIZER))
    for t in [d["text"] for d in docs[:60]] + ODD_TEXTS[1:]:
        assert enc.spans(t).tolist() == enc.whole(t).tolist()


def test_allocation_rule():
    spans, bounds = np.array([[0, 2], [2, 6], [6, 8], [8, 12]]), np.array([0, 4, 9, 12])
    n, crossing = token_counts.allocate(spans, bounds)  # 2-6 is half and half: the first; 8-12 lies mostly in the last
    assert n.tolist() == [2, 1, 1] and crossing.tolist() == [1, 0, 1]


def test_counts_equal_brute_force(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.tokenizer_path(token_counts.TOKENIZER))
    texts = [d["text"] for d in docs[:40]] + ODD_TEXTS + ["a\n\n\n\nb", "\n", "x\n", "\n\n \n  y", "tab\tx\n\n\ty"]
    want = []
    for i, t in enumerate(texts):
        lines, at = [], 0
        for line in t.split("\n"):
            end = min(at + len(line) + 1, len(t))
            if end > at:
                lines.append((at, end))
            at = end
        offsets = library.encode(t, add_special_tokens=False).offsets
        n, crossing = [0] * len(lines), [0] * len(lines)
        for s, e in offsets:
            held = [max(0, min(e, b) - max(s, a)) for a, b in lines]
            k = max(range(len(lines)), key=lambda x: (held[x], -x)) if e > s else next(x for x, (a, b) in enumerate(lines) if a <= s < b)
            n[k] += 1
            crossing[k] += sum(h > 0 for h in held) > 1
        want += [(i, k, a, b, n[k], crossing[k], len(offsets)) for k, (a, b) in enumerate(lines)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(rows(token_counts.token_counts(df))) == want


def test_another_tokenizer_is_not_cut(docs):
    enc = token_counts.OffsetEncoder(tokens.tokenizer_path())  # this one drops white space
    for t in [d["text"] for d in docs[:5]] + ODD_TEXTS[1:]:
        assert enc.spans(t).tolist() == enc.whole(t).tolist()


def test_token_counts_add_up(odd):
    got = token_counts.token_counts(odd).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    want = dict(zip([i for i, _ in TEXTS], library_ids([t for _, t in TEXTS], token_counts.TOKENIZER), strict=True))
    for i in (1, 9, 10, 7):
        assert sum(r.n_tokens for r in by[i]) == by[i][0].doc_tokens == len(want[i])
    assert 3 not in by and 4 not in by


# --- 7 pieces


def test_pieces_equal_the_library(docs):
    enc = pieces.PieceEncoder(tokens.tokenizer_path(pieces.MODEL))
    texts = [d["text"] for d in docs[:80]] + ODD_TEXTS + ["a▁b", "<s></s><unk><0x0A>", "the the the" * 50, "x" * 3000, "abcdefgh" * 500, "日本語のテキスト。" * 200, "".join(random.Random(8).choices("thearing", k=5000)), " " * 700]
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        ids = np.frombuffer(ids, "<i4")
        assert ids.tolist() == enc.model.sp.encode(t), t[:60]
        if "▁" not in t:
            assert enc.model.decode(ids) == t


def test_suffix_index_finds_every_occurrence():
    text = "abracadabra\0"
    body = np.array([ord(c) for c in text], np.int64)
    index = pieces.SuffixIndex(body, 3)
    for w in ("a", "ab", "abr", "bra", "zz", "ca"):
        lo, hi = index.ranges(np.array([[ord(c) for c in w]], np.int64))
        assert sorted(index.order[lo[0] : hi[0]].tolist()) == [m.start() for m in re.finditer(f"(?={w})", text)]


def test_piece_ids_odd_rows(odd):
    got = {r.doc_id: r for r in pieces.piece_ids(odd).collect()}
    assert len(pieces.piece_ids(odd).collect()) == len(TEXTS) and got[3].n_pieces == 0 and all(r.round_trip for i, r in got.items() if i is not None and i != 3)


# --- 8 neighbours


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24)).astype("f4")
    x[700:800] = x[3]  # a hundred equal vectors
    data = [(i, v.tolist(), "z") for i, v in enumerate(x)]
    bad = [(5000, None, "z"), (5050, [0.0] * 24, "z"), (5100, [float("nan")] * 24, "z"), (5150, [1.0, 2.0], "z"), (5200, [None] * 24, "z"), (None, [1.0] * 24, "z")]
    got = ann.nearest(spark.createDataFrame(data + bad, "vec_id long, embedding array<float>, vec string")).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    by, hit = {}, 0
    for r in got:
        by.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(by) == set(range(0, 1500, 50))
    for q, found in by.items():
        s = u @ u[q]
        s[q] = -9
        want = np.lexsort((np.arange(1500), -s.round(12)))[:5]
        assert sorted(found) == [1, 2, 3, 4, 5] and all(abs(s[v] - score) < 1e-9 for v, score in found.values())
        hit += len(set(want.tolist()) & {v for v, _ in found.values()})
    assert hit / (5 * len(by)) >= 0.9
    assert [by[750][k][0] for k in range(1, 6)] == [3, 700, 701, 702, 703]


def test_equal_cosines_go_to_the_smallest_ids(spark):
    rng = random.Random(3)
    base = [0.5, -1.25, 2.0, 0.75]
    data = []
    for i in range(1, 400):
        f = 2.0 ** rng.randrange(-9, 9)
        data.append((i, [v * f for v in base]))
    rng.shuffle(data)
    for parts in (1, 7):
        got = ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(parts)).collect()
        by = {}
        for r in got:
            by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(by) == set(range(50, 400, 50)) and all([x[:2] for x in sorted(v)] == [(n, n) for n in range(1, 6)] and len({x[2] for x in v}) == 1 for v in by.values())


def test_many_queries_of_one_direction(spark):
    data = [(i, [float(1 + i % 64), float(1 + i % 64)]) for i in range(3000)] + [(None, [1.0, 1.0]), (3000, None)]
    df = spark.createDataFrame([(i, v, i, i, 1, "x") for i, v in data * 2], "vec_id long, embedding array<double>, id long, query long, list int, vec string")
    got = ann.nearest(df).collect()  # each id twice, and columns of the names that the search uses itself
    for q in range(0, 3000, 50):
        found = sorted((r["rank"], r.score, r.vec_id) for r in got if r.query_id == q)
        assert [x[0] for x in found] == [1, 2, 3, 4, 5] and len({x[2] for x in found}) == 5
        assert all(a[1] > b[1] or a[1] == b[1] and a[2] < b[2] for a, b in zip(found, found[1:], strict=False))


def test_few_vectors(spark):
    got = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)}
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


# --- 10 languages


def test_marginals_over_chunks_are_exact():
    rng = np.random.default_rng(6)
    sizes, trans = np.array([3, 1, 200, 64, 65]), rng.normal(size=(3, 3))
    e = rng.normal(size=(int(sizes.sum()), 3))
    got, at = langid.marginal_sums(e, sizes, trans), 0
    for row, n in zip(got, sizes, strict=True):
        x, tr = np.exp(e[at : at + n]), np.exp(trans)
        a, b, v = np.zeros((n, 3)), np.zeros((n, 3)), np.full(3, 1 / 3)
        for t in range(n):
            v = (v @ tr) * x[t]
            v /= v.sum()
            a[t] = v
        v = np.ones(3)
        for t in range(n - 1, -1, -1):
            b[t] = v
            v = tr @ (x[t] * v)
            v /= v.sum()
        m = a * b
        assert np.allclose((m / m.sum(axis=1, keepdims=True)).sum(axis=0), row)
        at += n


def test_gradient_is_the_likelihoods():
    rng = np.random.default_rng(7)
    e, y, trans = rng.normal(size=(2, 5, 3)), rng.integers(0, 3, (2, 5)), rng.normal(size=(3, 3))

    def loss(e, trans):
        out = 0.0
        for b in range(2):
            v = np.full(3, 1 / 3)
            for t in range(5):
                v = (v @ np.exp(trans)) * np.exp(e[b, t])
            gold = sum(e[b, t, y[b, t]] for t in range(5)) + sum(trans[y[b, t - 1], y[b, t]] for t in range(1, 5))
            out += np.log(v.sum()) - gold
        return out

    g, g_t = langid.crf_gradient(e, y, trans)
    for b, t, k in ((0, 2, 1), (1, 4, 0)):
        d = np.zeros_like(e)
        d[b, t, k] = 1e-5
        assert abs((loss(e + d, trans) - loss(e - d, trans)) / 2e-5 - g[b, t, k]) < 1e-5
    assert g_t.shape == (3, 3)


def test_held_out_accuracy(spark):
    got = queries.op10_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {d["doc_id"]: d["lang"] for d in ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table().to_pylist()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_languages_odd_rows(odd):
    got = rows(langid.identify(odd))
    assert len(got) == len(TEXTS)
    for i, _, pred, score in got:
        text = next((t for j, t in TEXTS if j == i and i is not None), None)
        if i is not None and not any(c.isalpha() for c in text or ""):
            assert (pred, score) == ("und", 0.0)


def test_language_sample_is_whole(spark):
    text, lang = F.lit("a b c"), F.when(F.col("id") < 99_900, "aa").otherwise("zz")
    got = langid.sample(spark.range(0, 100_000, 1, 40).select(F.col("id").alias("doc_id"), lang.alias("lang"), text.alias("text")), rows=1)
    assert [y for y, _ in got] == ["aa", "zz"]  # a table in the order of its languages
    many = langid.sample(spark.range(1_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % 90).alias("lang"), text.alias("text")))
    assert len({y for y, _ in many}) == 90


def test_short_texts_are_learned():
    a, b = "der die das und nicht ist ein wir sie haben werden auf mit von zu im".split(), "the and not is one we they have will on with from to in at by".split()
    short = [("en", " ".join(b[i : i + 4])) for i in range(0, 16, 4)] * 10
    model = langid.fit([("de", " ".join(a * 4))] * 10 + short)
    sums, _ = langid.Labeller(model).sums([" ".join(b), " ".join(a)])
    assert [model.langs[k] for k in sums.argmax(axis=1)] == ["en", "de"]


# --- pipeline


def test_pipeline_stages(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["language", "exact", "near", "personal", "packing"]
    extra = [(1000, docs[0]["text"] + " \n", "xx", "s", 1), (1001, "%%% 123", "en", "s", 7), (1002, None, None, None, None), (1003, docs[1]["text"].replace(" the ", " thee ", 1), "en", "s", 1), (1004, "Der Brief ging an karl.may@winnetou.example.org und der kam an.", "de", "s", 1)]
    rows_in = [(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"]) for d in docs[:40]] + extra
    df = spark.createDataFrame(rows_in, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.by_language(spark, df, SF)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == df.columns and {1001, 1002} & ids == set() and {d["doc_id"] for d in docs[:40]} <= ids
    exact = pipeline.by_exact_copy(spark, kept, SF)
    texts = {}
    for i, t, *_ in rows_in:
        if i in ids:
            texts.setdefault(re.sub("[ \t\n\v\f\r]", "", t), []).append((-len(t), i))
    want = {min(v)[1] for v in texts.values()}
    assert {r.doc_id for r in exact.collect()} == want
    near = pipeline.by_near_copy(spark, exact, SF)
    order = sorted(want)
    comp = brute_components([slow_print(next(t for j, t, *_ in rows_in if j == i)) for i in order])
    assert {r.doc_id for r in near.collect()} == {min(order[k] for k, x in enumerate(comp) if x == c) for c in comp}
    clean = pipeline.without_personal_data(spark, df.filter("doc_id IN (1002, 1003, 1004)"), SF)
    got = {r.doc_id: r for r in clean.collect()}
    assert got[1002].text is None and "<EMAIL>" in got[1004].text and got[1004].n_chars == len(got[1004].text) and got[1003].text == extra[3][1]


def run_pipeline(spark, tmp_path, data, schema):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "documents.parquet"))
    return pipeline.run(spark, str(tmp_path))


def test_whole_pipeline_on_odd_rows(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(pii, "STEPS", 60)
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, kept boolean, sha string, c0 string, fold long"
    plain = [(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"], 1, False, "s", "c", 2) for d in docs[:30]]
    long = " ".join(d["text"] for d in docs[:40]) * 3
    tail = (None, "s", 1, 1, False, "s", "c", 2)
    odd = [(900, None, *tail), (901, "", *tail), (902, "%%% 1", *tail), (903, long, *tail), (None, long + " ", *tail), (None, "Der Hund und die Katze gehen in das Haus.", *tail), (None, "Der Hund und die Katze gehen in das Haus.", *tail)]
    got = run_pipeline(spark, tmp_path, plain + plain[:5] + odd, schema).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert not {900, 901, 902, 903} & set(by) and {r.length for r in got} and sorted(x.start for x in by[None])[0] == 0
    assert all(sorted(r.piece for r in by[i]) == list(range(len(by[i]))) for i in by if i is not None)  # none comes twice
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_pipeline_without_rows_or_languages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert run_pipeline(spark, tmp_path, [], schema).collect() == []
    df = spark.createDataFrame([(1, "abc def", None, "s", 7), (2, "12 3", None, "s", 4), (3, None, None, None, None)], schema)
    assert [tuple(r) for r in pipeline.by_language(spark, df, "").collect()] == [(1, "abc def", None, "s", 7)]
    assert pipeline.sure(4) == pytest.approx(0.3) and pipeline.sure(1) == 0 and pipeline.sure(10) < 0.17


def test_sweep_deletes_only_old_stage_tables(spark):
    kept = common.written(spark.range(3).toDF("id"), "sweep-test")
    assert common.sweep(spark, 24) == 0 and kept.count() == 3
    assert common.sweep(spark, -1) >= 1


def test_words_numbered_together_equal_whole_texts(monkeypatch):
    """Texts in several groups, with marks between, without words, with long words, and of every Latin-1 character."""
    from lintlake.llm import tokens

    monkeypatch.setattr(tokens, "TOGETHER", 40)
    monkeypatch.setattr(tokens, "LAID", 3)
    words = tokens.WordEncoder(tokens.tokenizer_path())
    some = ["", " \n", "One two, two. One", "it's here", "naïve Été x\x85y", "a" * 700 + " " + "b" * 257 + "###", "日本 one", "x <|endoftext|> y", "p\x1cq r", "".join(map(chr, range(256)))]
    some += [f"a{chr(c)}b {chr(c)}" for c in range(256)]
    assert words.encode(some) == [words._raw(t) for t in some]
    assert words.encode([]) == []
    assert max(map(len, words.words)) <= tokens.LONG
