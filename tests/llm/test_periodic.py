"""Periodic runs against plain loops over all periods and places."""

import hashlib
import random
import re
import zlib

import numpy as np

from lociframe.llm import periodic

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """Maximal stretches of each period q, kept where q is their least period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - (i - q) >= max(6, 4 * q):
                found.setdefault((i - q, j), q)  # the least comes first
            i = j
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_equal_plain_loops():
    rng = random.Random(7)
    for k in range(1500):
        words = []
        while len(words) < rng.randrange(1, 70):
            unit = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 6))]
            words += unit * rng.choice([1, 1, 2, 4, 5, 8])
        assert periodic.runs_of(words, np.array(words, np.uint64)) == plain_runs(words), words


def test_every_repetition_is_a_square():
    """Without the cuts: each run of two periods or more is found from some square."""
    rng = random.Random(11)
    for _ in range(400):
        words = [rng.randrange(2) for _ in range(rng.randrange(1, 40))]
        seen = set(periodic.squares(words, 2))
        assert all(words[e - d + 1 : e + 1] == words[e - 2 * d + 1 : e - d + 1] for e, d in seen)
        for s, length, q in plain_runs(words):
            assert any(d == q and s + 2 * q - 1 <= e < s + length for e, d in seen)


def test_automaton_has_all_substrings():
    rng = random.Random(2)
    for _ in range(60):
        words = [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
        a = periodic.Automaton(words, 3)
        texts = {tuple(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
        assert sum(a.length[i] - a.length[a.link[i]] for i in range(1, len(a.length))) == len(texts)


def test_ends_in_blocks(monkeypatch):
    monkeypatch.setattr(periodic.Ends, "BLOCK", 4)
    rng = random.Random(3)
    some = rng.sample(range(1000), 200)
    ends, have = periodic.Ends(some[0]), {some[0]}
    for x in some[1:]:
        assert ends.insert(x) == (max((y for y in have if y < x), default=None), min((y for y in have if y > x), default=None))
        have.add(x)
    assert list(ends) == sorted(have)


def test_query_equals_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in periodic.op13_periodic_runs(spark, SF).collect()]
    assert sorted(rows) == sorted(plain_row(*r) for r in docs)
    assert sum(r[1] > 0 for r in rows) > 5


def test_odd_rows(spark, tmp_path):
    long = "x " * 200_000 + "y z " * 50_000
    rows = [(None, "a a a a a a"), (1, None), (2, ""), (3, " \t\n"), (4, "b b b b b"), (5, "a b " * 5 + "c"), (5, "a b " * 5 + "c"), (12, "same same same same same same"), (7, long)]
    spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, runs string, period int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic.op13_periodic_runs(spark, str(tmp_path)).collect()]
    plain = [plain_row(*r) for r in rows if r[1] is not long]
    assert sorted((r for r in got if r[0] != 7), key=str) == sorted(plain, key=str)
    assert [r[1:6] for r in got if r[0] == 7] == [(2, 0, 200_000, 1, 200_000_000)]
    empty = spark.createDataFrame([], "doc_id long, text string, runs string")
    assert periodic.periodic_runs(empty).collect() == []
    carried = periodic.periodic_runs(spark.createDataFrame([(1, "q q q q q q", "mine")], "doc_id long, text string, other string")).collect()[0]
    assert carried.other == "mine" and carried.collapsed == "q" and [tuple(r) for r in carried.runs] == [(0, 6, 1)]
