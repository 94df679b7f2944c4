"""Pileup over a few records worked out by hand."""

from lociframe.operators import pileup as P

ROWS = [("a", 0, "r", 2, "3M1D2M", "ACGTT", "IIIII"), ("b", 16, "r", 3, "1S2M2I1M", "NCGAAC", "!!I!II"), ("c", 4, "r", 2, "3M", "AAA", "III"), ("d", 0, "r", 4, "1M3N1M", "GT", None)]


def table(spark):
    return spark.createDataFrame(ROWS, "qname string, flag int, rname string, pos long, cigar string, seq string, qual string")


def test_rows(spark):
    got = {(r.place, r.qname): r.base for r in P.pileup(table(spark)).collect()}
    assert got == {(2, "a"): "A", (3, "a"): "C", (4, "a"): "G", (5, "a"): "*", (6, "a"): "T", (7, "a"): "T", (3, "b"): "c", (4, "b"): "g", (5, "b"): "c", (4, "d"): "G", (8, "d"): "T"}


def test_columns_and_consensus(spark):
    p = P.pileup(table(spark))
    got = {r.place: (r.depth, r.bases) for r in P.columns(p).collect()}
    assert got[4] == (3, "GgG") and got[3] == (1, "C") and got[5] == (2, "*c")
    assert {r.place: r.base for r in P.consensus(p).collect()}[4] == "G"
    assert P.columns(p.limit(0)).count() == 0


def test_indels_and_mismatches(spark):
    assert {(r.place, r.kind, r.len, r.reads) for r in P.indels(table(spark)).collect()} == {(4, "D", 1, 1), (4, "I", 2, 1)}
    seqs = spark.createDataFrame([("r", "AAACGATTT")], "name string, seq string")
    assert {r.qname: r.nm for r in P.mismatches(table(spark), seqs).collect()} == {"a": 1, "b": 3, "c": 2, "d": 0}
