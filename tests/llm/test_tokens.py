"""Packing, token files, byte-level BPE and fingerprints against the plain way."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from lociframe.llm import bpe, fingerprints, packing, tokenfiles, wordbpe

WORD = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = [(3, "Hello, the world's end."), (1, None), (2, ""), (7, "a" * 3000), (7, "a" * 3000), (5, "é́ İ ſ <|endoftext|> x"), (9, "one two three four five six " * 900)]


def table(spark, rows=ODD):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, ids string")


def library_ids(text):
    return Tokenizer.from_file(WORD).encode(text or "", add_special_tokens=False).ids


def test_word_ids_are_the_librarys():
    lib, own = Tokenizer.from_file(WORD), wordbpe.tokenizer(WORD)
    random.seed(3)
    letters = [*"aAbéÉ'sStdmlvre0123 \t\n\x1c\x1f\x85\xa0 .,!ß́̈İſKΣςσ<|>-½²ª×÷µÿ", "<|endoftext|>", "'ll", "'S"]
    texts = ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(800)]
    for t, ids in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, ascii(t)


def test_byte_bpe_is_tiktokens():
    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    random.seed(4)
    texts = ["", "a" * 3000, "\U0001f600" * 50, "abc" * 800, " \n\n x", *("".join(random.choices("abcdef éß\n019'!", k=random.randint(1, 200))) for _ in range(300))]
    for t, ids in zip(texts, c.encode_all(texts), strict=True):
        want = plain.encode_ordinary(t)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert c.decode(ids) == t.encode()
        assert sum((bpe.merge(p.encode(), c.ranks) for p in c.cut.findall(t)), []) == want


def test_byte_bpe_query(spark):
    got = {r.doc_id: r for r in bpe.op8_byte_bpe(spark, SF).collect()}
    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array(plain.encode_ordinary(r.text or ""), "<u4").tobytes()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert bpe.encode(table(spark, []), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("values", [[7], [0, 2**32 - 1, 5], list(range(100)), [3] * 64 + [40000], [1] * 1000 + [2**31] * 40])
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    assert tokenfiles.unpack(tokenfiles.pack(ids)).tolist() == values


def test_crc_of_parts():
    random.seed(1)
    for n in (0, 1, 7, 4096, 100_001):
        a, b = random.randbytes(33), random.randbytes(n)
        assert tokenfiles.crc32_joined(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK", 1000)
    tokenfiles.write(table(spark), str(tmp_path / "t"), WORD)
    want = [np.array([*library_ids(t), 2], np.uint32) for _, t in sorted(ODD, key=lambda x: x[0])]
    whole = np.concatenate(want)
    assert tokenfiles.read_range(spark, str(tmp_path / "t"), 0, len(whole)).tolist() == whole.tolist()
    assert tokenfiles.read_range(spark, str(tmp_path / "t"), 990, 30).tolist() == whole[990:1020].tolist()
    tokenfiles.write(table(spark, []), str(tmp_path / "e"), WORD)
    assert tokenfiles.read_documents(spark, str(tmp_path / "e")).count() == 0


def test_token_file_query(spark):
    at = 0
    got = {r.doc_id: r for r in tokenfiles.op6_token_files(spark, SF).collect()}
    lib = Tokenizer.from_file(WORD)
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_and_fits(seed):
    random.seed(seed)
    counts = Counter(random.randint(1, 40) for _ in range(random.randint(1, 60)))
    got = packing.plan(counts, 40)
    assert all(sum(k * m for k, m in p) <= 40 for p, _ in got)
    cover = Counter()
    for p, n in got:
        for k, m in p:
            cover[k] += m * n
    assert cover == counts
    assert packing.lower_bound(counts, 40) <= sum(n for _, n in got) <= sum(n for _, n in packing.best_fit_decreasing(counts, 40))


def test_plan_beats_best_fit():
    counts = {6: 1, 5: 2, 4: 1, 3: 4, 2: 1}  # 34 in 10s: best fit decreasing may need more than 4
    assert sum(n for _, n in packing.plan(counts, 10)) == 4


@pytest.mark.parametrize("seed", range(60))
def test_search_equals_brute_force(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 40, 60])
    items = sorted((rng.randint(1, capacity) if seed % 2 else rng.randint(capacity // 5, capacity * 3 // 5) for _ in range(rng.randint(1, 12))), reverse=True)
    least = [len(items)]

    def go(i, rooms):
        if len(rooms) >= least[0]:
            return
        if i == len(items):
            least[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                go(i + 1, sorted(_replaced(rooms, room, room - items[i])))
        go(i + 1, sorted([*rooms, capacity - items[i]]))

    go(0, [])
    counts = Counter(items)
    found = packing.search(counts, capacity)
    assert found.proved and found.size == least[0] >= found.bound
    alone = [(((k, 1),), n) for k, n in counts.items()]
    whole = packing._Search(dict(counts), capacity, alone, found.bound, 100_000)  # without a good start
    assert whole.run() and whole.size == least[0]


def _replaced(rooms, old, new):
    at = rooms.index(old)
    return [*rooms[:at], new, *rooms[at + 1 :]]


@pytest.mark.parametrize("seed", range(10))
def test_full_sequences_are_found_or_the_gap_is_told(seed):
    rng = random.Random(seed)
    capacity, n = ((1000, 60), (4096, 300))[seed % 2]
    counts = Counter()
    for _ in range(n):
        a, b = sorted(rng.sample(range(1, capacity), 2))
        counts.update([a, b - a, capacity - b])
    found = packing.search(counts, capacity)
    assert found.bound == n and (found.size == n) == found.proved and found.size <= n + 1
    cover = Counter()
    for p, times in found.patterns:
        assert sum(k * m for k, m in p) <= capacity
        cover.update({k: m * times for k, m in p})
    assert cover == counts


def test_pack_keeps_columns_of_any_name(spark):
    rows = [(i, 3 + i % 5, "s", i * 2, "r") for i in range(40)] + [(None, 4, "s", 1, None), (None, 4, "s", 1, None)]
    pieces = spark.createDataFrame(rows, "doc_id long, length long, _slice string, _rank long, k0 string")
    got = packing.pack(pieces, 10, ["doc_id"])
    assert got.columns == [*pieces.columns, "sequence_id", "offset", "sequences_least", "proved"]
    assert sorted(map(tuple, got.select(*pieces.columns).collect()), key=str) == sorted(rows, key=str)
    assert {r.proved for r in got.collect()} == {True} and got.select("sequence_id").distinct().count() == got.first().sequences_least


def test_dominance():
    assert packing.dominated((3, 2), (5,)) and packing.dominated((3,), (4, 1)) and not packing.dominated((4, 4), (5, 3))


def check_packed(rows, want, capacity):
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark):
    for rows in (ODD, []):
        want = []
        for d, t in rows:
            ids = np.array([*library_ids(t), 1], "<u4")
            want += [(d, i, a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes())) for i, a in enumerate(range(0, len(ids), 512))]
        got = packing.packed_documents(table(spark, rows), 512).collect()
        check_packed(got, want, 512)


def test_packing_query(spark):
    got = packing.op5_packing(spark, SF).collect()
    n = len({r.sequence_id for r in got})
    assert n == packing.lower_bound(Counter(r.length for r in got), 4096)
    check_packed(got, [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], 4096)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seqs = packing.sequences(docs, packing.packed_documents(docs), WORD, 4096).collect()
    assert len(seqs) == n and all(len(s.ids) <= 4 * 4096 for s in seqs)


def test_fingerprint_rate_is_generalised_jaccard():
    s = fingerprints.Sampler(4000)
    rng = np.random.default_rng(0)
    terms = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = rng.integers(0, 6, 300), rng.integers(0, 6, 300)
    one = s._least(terms[a > 0], a[a > 0], np.array([0]))[0]
    two = s._least(terms[b > 0], b[b > 0], np.array([0]))[0]
    assert abs(fingerprints.likeness(one, two) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_fingerprints(spark):
    got = fingerprints.compare_with_edits(table(spark)).orderBy("doc_id").collect()
    docs = sorted(((d, t or "") for d, t in ODD), key=lambda x: x[0])
    assert len(got) == len(docs)
    for r, (d, t), (_, u) in zip(got, docs, docs[1:] + docs[:1], strict=True):
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (d, len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.near_next == 1) == (t.lower().split() == u.lower().split())
    assert fingerprints.compare_with_edits(table(spark, [])).count() == 0
    assert fingerprints.compare_with_edits(table(spark, [(1, "a b")])).count() == 1


def test_fingerprint_query(spark):
    got = fingerprints.op7_fingerprints(spark, SF).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    s = fingerprints.Sampler()
    own = s.signatures([d.text for d in docs])
    for i, (r, d) in enumerate(zip(got, docs, strict=True)):
        u = docs[(i + 1) % len(docs)]
        e = d.text[: len(d.text) - len(d.text) // 2] + u.text[: len(d.text) // 2]
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.fingerprint == fingerprints.written(own[i])
        assert r.near_next == fingerprints.likeness(own[i], own[(i + 1) % len(docs)])
    assert np.mean([r.near_edited for r in got]) > 0.2 > np.mean([r.near_next for r in got])


def test_the_last_document_is_followed_by_one_without_id(spark):
    rows = [(None, "first text of all " * 4), (1, "another one " * 5), (2, "the last text " * 3)]
    got = {r.doc_id: r for r in fingerprints.compare_with_edits(table(spark, rows)).collect()}
    texts = [t for _, t in rows]
    for (doc, t), after in zip(rows, texts[1:] + texts[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert fingerprints.compare_with_edits(table(spark, [])).collect() == []
