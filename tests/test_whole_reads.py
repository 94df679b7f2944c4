"""Queries over all reads of a name and all lines of a sample against plain loops."""

import math
from collections import Counter
from itertools import groupby

import pytest

from lociframe.plans import alignment_queries as A
from lociframe.plans import reads as R
from lociframe.plans import variant_queries as V

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reads(spark):
    rows = sorted(R.reads(spark, SF).collect(), key=lambda r: (r.qname, r.ord))
    return [list(g) for _, g in groupby(rows, key=lambda r: r.qname)]


def test_fixmate_all(spark, reads):
    want = []
    for rows in reads:
        main = [r for r in rows if not r.flag & 256]
        pairs = {}
        for a, b in zip(main[::2], main[1::2], strict=False):
            pairs[a.ord], pairs[b.ord] = b, a
        five = lambda r: r.end_pos + 1 if r.rev else r.pos
        for r in rows:
            m = pairs.get(r.ord)
            same = m is not None and m.tid == r.tid and not (m.flag | r.flag) & 12
            want.append((r.qname, r.ord, *((m.tid, m.pos, m.rev) if m else (None,) * 3), five(m) - five(r) if same else 0))
    got = sorted(((r.qname, r.ord, r.mate_tid, r.mate_pos, r.mate_rev, r.isize) for r in A.fixmate_all(spark, SF).collect()), key=lambda r: r[:2])
    assert got == want and any(r[1] > 2 and r[2] is not None for r in got)


def test_insert_histogram_all(spark, reads):
    pairs = [r for rows in reads for r in rows if r.mtid == r.tid]
    got = Counter()
    for r in A.insert_histogram_all(spark, SF).collect():
        got[r.size] += r.n
    assert got == Counter(min(abs(r.mpos - r.pos), 7999) for r in pairs) and 7999 in got


def test_compare_aligners_all(spark, reads):
    got = A.compare_aligners_all(spark, SF).collect()
    both = [(a, b) for rows in reads for a, b in zip(rows[::2], rows[1::2], strict=False)]
    agree = sum(a.tid == b.tid and a.rev == b.rev and abs(a.pos - b.pos) < 100 for a, b in both)
    n = Counter()
    for r in got:
        n[r.kind] += r.n
    assert n == +Counter(agree=agree, differ=len(both) - agree, first=sum(len(rows) % 2 for rows in reads))


def test_linkage_em_combines_lines(spark):
    lines = spark.createDataFrame([(1, 1, 0, 10), (1, 1, 1, 20), (1, 2, 2, 10)], "site long, s long, gt int, gq int")
    got = {r.s: r.l for r in V.sample_likelihoods(lines).collect()}
    like = lambda gt, gq: [1 - 10 ** (-gq / 10) if g == gt else 10 ** (-gq / 10) / 2 for g in range(3)]
    both = [a * b for a, b in zip(like(0, 10), like(1, 20), strict=True)]
    assert all(math.isclose(x, y / max(both)) for x, y in zip(got[1], both, strict=True))
    assert all(math.isclose(x, y / 0.9) for x, y in zip(got[2], like(2, 10), strict=True))
    assert all(-1.001 <= r.r <= 1.001 for r in V.linkage_em(spark, SF).collect())
