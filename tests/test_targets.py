"""Target stretches against the one-pass model, over several widths of buckets."""

import random

from lociframe.operators import targets as T


def plain(kinds, enter, scores):
    """Half-open stretches on target by one pass and its backtracking."""
    off, on, back = 0, 0, []
    for k in kinds:
        back.append((not off > on, not off - enter > on))
        off, on = max(off, on), max(off - enter, on) + scores[k]
    state, path = not off > on, [False] * len(kinds)
    for i in range(len(kinds) - 1, 0, -1):
        path[i] = state
        state = back[i][state]
    out, start = [], None
    for i, x in enumerate([*path, False]):
        if x and start is None:
            start = i
        if not x and start is not None:
            out.append((start, i))
            start = None
    return out


def table(spark, seqs):
    sites = [(t, i, k) for t, kinds in seqs.items() for i, k in enumerate(kinds) if k]
    lengths = [(t, len(kinds)) for t, kinds in seqs.items()]
    return spark.createDataFrame(sites, "tid long, place long, kind int"), spark.createDataFrame(lengths, "tid long, length long")


def test_equals_one_pass(spark, monkeypatch):
    rng = random.Random(12)
    seqs = {}
    for t in range(40):
        kinds = []
        while len(kinds) < rng.randrange(1, 120):
            kinds += [rng.choice([0, 0, 1, 2, 2])] * rng.randrange(1, 15)
        seqs[t] = kinds
    seqs[40], seqs[41] = [0] * 50, [2] * 64
    for width, enter in ((8, 20), (1000, 20), (8, 0), (16, 7)):
        monkeypatch.setattr(T, "WIDTH", width)
        got = {}
        for r in T.targets(*table(spark, seqs), enter=enter).collect():
            got.setdefault(r.tid, []).append((r.start, r.end))
        for t, kinds in seqs.items():
            assert sorted(got.get(t, [])) == plain(kinds, enter, (-4, 1, 6)), (t, width, enter)


def test_odd_sites(spark):
    sites, lengths = table(spark, {1: [2] * 30})
    more = sites.unionByName(spark.createDataFrame([(1, 99, 2), (1, -1, 2), (7, 0, 2)], "tid long, place long, kind int"))
    assert [tuple(r) for r in T.targets(more, lengths, enter=20).collect()] == [(1, 1, 30)]
    assert T.targets(sites.limit(0), lengths, enter=20).collect() == []
    assert T.targets(sites, lengths.limit(0), enter=20).collect() == []


def test_consensus(spark):
    rows = [(1, 5, "A", 0, 30, 60)] * 4 + [(1, 5, "c", 1, 30, 60), (1, 6, "G", 0, 12, 60), (1, 7, "N", 0, 30, 60), (1, 8, "T", 0, 30, 2), (1, 8, "T", 1, 40, 255)]
    got = {r.place: (r.letter, r.quality > 0, r.kind) for r in T.consensus(spark.createDataFrame(rows, "tid long, place long, base string, rev int, q int, mapq int")).collect()}
    assert got == {5: ("A", True, 2), 8: ("T", True, 2)}
