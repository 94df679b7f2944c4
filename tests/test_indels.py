"""Indel calling: scores against the whole model in plain loops, planted genotypes, helpers by hand."""

import math
import random

import numpy as np

from lociframe.operators import indels, realign
from lociframe.plans import record_queries as Q

SF = "/root/testdata/sf0.001"


def plain_score(ref, query, quals, band, d, e):
    """Forward over the whole matrix, unscaled."""
    n, places = len(query), len(ref)
    bw = max(min(max(places, n), band), abs(places - n))
    s = 1 / (2 * n + 2)
    f = {}
    g = lambda *key: f.get(key, 0.0)
    for i in range(1, n + 1):
        for k in range(max(1, i - bw), min(places, i + bw) + 1):
            a, b, w = ref[k - 1], query[i - 1], 10 ** (-quals[i - 1] / 10)
            emit = 1.0 if "N" in (a, b) else 1 - w if a == b else w * 0.33333333333
            if i == 1:
                f[i, k, "M"], f[i, k, "I"] = emit * (1 - d) / places, 0.25 * d / places
            else:
                f[i, k, "M"] = emit * ((1 - 2 * d) * (1 - s) * g(i - 1, k - 1, "M") + (1 - e) * (1 - s) * g(i - 1, k - 1, "I") + (1 - e) * g(i - 1, k - 1, "D"))
                f[i, k, "I"] = 0.25 * (d * (1 - s) * g(i - 1, k, "M") + e * (1 - s) * g(i - 1, k, "I"))
                f[i, k, "D"] = d * (1 - s) * g(i, k - 1, "M") + e * g(i, k - 1, "D")
    total = sum((g(n, k, "M") + g(n, k, "I")) * s for k in range(1, places + 1))
    return -4.343 * math.log(total * places * n)


def test_scores_equal_the_plain_model():
    rng = random.Random(21)
    for _ in range(80):
        ref = "".join(rng.choices("ACGTN", [8, 8, 8, 8, 1], k=rng.randrange(3, 30)))
        query = "".join(rng.choices("ACGT", k=rng.randrange(1, 25))) if rng.random() < 0.3 else (ref[1:-1] or ref).replace("N", "A")
        quals, band = [rng.randrange(7, 31) for _ in query], rng.choice([3, 5, 9])
        for gap, on in (indels.LOOSE, indels.TIGHT):
            got = realign.scores(realign.codes(ref)[None], realign.codes(query)[None], 10.0 ** (-np.array([quals]) / 10), band, gap, on)
            assert abs(got[0] - plain_score(ref, query, quals, band, gap, on)) < 1e-6


def test_helpers():
    ops = indels.parsed("2S4M2D3M1I5M")
    assert ops == [("S", 2), ("M", 4), ("D", 2), ("M", 3), ("I", 1), ("M", 5)]
    assert [indels.gap_at(10, ops, p)[0] for p in range(10, 20)] == [0, 0, 0, -2, 0, 0, 0, 0, 1, 0]
    assert indels.gap_at(10, ops, 18)[1] == 8 and indels.gap_at(10, ops, 14) == (0, -1)
    assert indels.query_place(10, ops, 5, False) == (2, 10) and indels.query_place(10, ops, 12, False) == (4, 12)
    assert indels.query_place(10, ops, 14, True) == (6, 14) and indels.query_place(10, ops, 14, False) == (6, 16)
    assert indels.query_place(10, ops, 99, True) == (15, 24)
    assert indels.homopolymer("ACCCCG", 0) == 4 and indels.homopolymer("ACCCCG", 2) == 4 and indels.homopolymer("ANA", 0) == 1 and indels.homopolymer("AC", 1) == 1
    assert indels.sequence_quality(1, 2) == 40 and indels.sequence_quality(-3, 2) == 80 and indels.sequence_quality(1, 5) == 20


def test_masks():
    read = lambda pos, seq: {"pos": pos, "seq": seq, "ops": [("M", len(seq))]}
    assert indels._masked("ACGTACGT", 0, 0, 8, [read(0, "ACTTACGT")] * 2 + [read(0, "ACGTACGT")]) == "ACNTACGT"
    assert indels._masked("ACGTACGT", 0, 2, 6, [read(0, "ACGTAC")] * 7 + [read(0, "ACGAAC")] * 2) == "GTAC"  # most agree


def test_planted_genotypes_are_found(spark):
    rows = Q.indel_likelihoods(spark, SF).collect()
    sites = {(r.tid, r.place) for r in rows}
    assert len(sites) > 15 and all(p % 97 == 50 for _, p in sites)
    right = total = 0
    for r in rows:
        nth = r.place // 97
        assert r.alts.split(",")[0] == ("-2" if nth % 2 == 0 else "+3GAT")
        if r.dp >= 8:
            pl = [int(x) for x in r.pl.split(",")][:3]
            total += 1
            right += pl.index(min(pl)) == (nth + int(r.sample)) % 3
    assert total > 15 and right >= 0.9 * total


def test_odd_reads(spark):
    ref = "ACGTTGCAAGGCTTAACCGATCGATTACGGCATCGGATCCATGCAAGTCTAGC" * 3
    seqs = spark.createDataFrame([("c", ref)], "name string, seq string")
    cut = ref[10:30] + ref[32:60]
    row = lambda flag, cigar, seq, qual: ("c", 10, flag, 60, cigar, seq, qual, "s")
    rows = [row(0, "20M2D28M", cut, "I" * 48)] * 6 + [row(16, "50M", ref[10:60], "I" * 50)] * 5
    rows += [row(4, "20M2D28M", cut, "I" * 48), row(0, "20M2D28M", None, None), row(0, "10M5N10M", "A" * 20, "I" * 20), row(0, None, "A", "I"), row(0, "20M2D28M", cut, None)]
    df = spark.createDataFrame(rows, "rname string, pos long, flag int, mapq int, cigar string, seq string, qual string, sample string")
    pieces = realign.pieces_of(seqs, 64, 1200)
    got = indels.indel_records(indels.gap_letters(df, pieces, 64)).collect()
    assert [(r.place, r.alts, r.samples[0].dp, r.samples[0].dv) for r in got] == [(29, "-2", 11, 6)]
    assert got[0].samples[0].pl[1] == 0
    assert indels.indel_records(indels.gap_letters(df, pieces, 64, deepest=3)).collect() == []
    assert indels.indel_records(indels.gap_letters(df.limit(0), pieces, 64)).collect() == []


def test_places_are_scored_together(spark, monkeypatch):
    """Places of a task share a round of scores, and get what they get alone."""
    from lociframe.plans import record_queries as Q

    calls, plain = [], indels._scores
    monkeypatch.setattr(indels, "_scores", lambda jobs, gaps: calls.append(len(jobs)) or plain(jobs, gaps))
    reads = [{"pos": 5 + i, "ops": [("M", 20), ("D", 2), ("M", 20)] if i % 2 else [("M", 40)], "seq": "ACGTTGCAAC" * 4, "quals": np.full(40, 30), "sample": i % 3} for i in range(6)]
    ref = "ACGGTTACGATCGATTACGA" * 20
    alone = [indels.site_calls(p, ref, 0, reads) for p in (24, 25, 26, 27)]
    n = len(calls)
    together = indels.scored_together([indels._site_steps(p, ref, 0, reads) for p in (24, 25, 26, 27)])
    assert together == alone and any(a[0] for a in alone)
    assert len(calls) - n <= 6 < n
