"""Spelling variants against plain loops, the automata against sorted lists."""

import random
import re
import zlib
from collections import Counter

from lociframe.llm import spelling

SF = "/root/testdata/sf0.001"
LETTERS = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]


def plain_counts(rows, edited=True):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if edited and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def plain_near(words):
    """By making every word at a distance of one."""
    out = {}
    for w in words:
        made = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in LETTERS for k in (0, 1)}
        out[w] = (made - {w}) & words.keys()
    return out


def plain_rows(words):
    near, form = plain_near(words), {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(rows)


def test_numbers_are_places_and_states_are_least():
    rng = random.Random(4)
    for _ in range(200):
        words = sorted({"".join(rng.choices("abc\xe9", k=rng.randrange(1, 7))) for _ in range(rng.randrange(1, 60))})
        a = spelling.Automaton(words)
        assert [a.follow(a.root, 0, w) for w in words] == list(range(len(words)))
        assert a.follow(a.root, 0, "abcabcabc") == -1 and a.count[a.root] == len(words)
        prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
        assert len(a.go) == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})


def test_near_within_a_stretch():
    rng = random.Random(6)
    for _ in range(300):
        words = sorted({"".join(rng.choices("ab", k=rng.choice([4, 5]))) for _ in range(20)})
        a = spelling.Automaton(words)
        w = rng.choice([x for x in words if len(x) == 4] or ["abab"])
        lo = rng.randrange(4)
        hi = rng.randrange(lo + 1, 5)
        made = {w[:i] + c + w[i + 1 :] for i in range(lo, hi) for c in "ab"} - {w}
        kept = {w[:i] + c + w[i:] for i in range(lo, hi + 1) for c in "ab" if c != w[i : i + 1]}
        assert {words[m] for m in a.near(w, lo, hi)} == (made | kept) & set(words)


def test_query_equals_plain_loops(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in spelling.op12_spelling_variants(spark, SF).collect())
    assert got == plain_rows(plain_counts(docs))
    assert sum(r[4] > 0 for r in got) > 100


def test_chains_ties_and_crowded_groups(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 5)
    rng = random.Random(8)
    words = {"abcdefg": 2, "abcdefgh": 30, "abcdefghi": 400, "abcdefghij": 5000, "xbcdefgh": 30, "tttttttt": 3, "ttttttt": 3, "ttttttttt": 3}
    stem = "presque"
    while len(words) < 300:
        words.setdefault(stem[: rng.randrange(5, 8)] + "".join(rng.choices("ab\xe9", k=rng.randrange(2, 6))), rng.choice([2, 3, 25, 26, 400]))
    words = {w: n for w, n in words.items() if len(w) >= 7}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = plain_rows(words)
    for crowded in (50_000, 6):
        assert sorted(tuple(r) for r in spelling.variants(df, crowded=crowded).collect()) == want
    assert [r[2] for r in want if r[0] == "abcdefg"] == ["abcdefghij"]


def test_odd_rows(spark, tmp_path):
    rows = [(None, "Windows windows"), (1, None), (2, ""), (3, "Étérétat étérétat ÉTérétat ×÷×÷×÷×"), (4, "repeated words"), (4, "repeated words"), (5, "x" * 100_000 + " " + "x" * 100_000)]
    spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, n int, word string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in spelling.op12_spelling_variants(spark, str(tmp_path)).collect()) == plain_rows_of_long(plain_counts(rows))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert spelling.op12_spelling_variants(spark, f"{tmp_path}/empty").collect() == []


def plain_rows_of_long(words):
    assert all(abs(len(a) - len(b)) > 1 or sum(x != y for x, y in zip(a, b, strict=False)) > 1 for a in words for b in words if a < b)  # no near words here
    return sorted((w, None, w, n, 0, None) for w, n in words.items())
