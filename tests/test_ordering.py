"""The contig graph: cycles and orders against plain searches, a published example, invariants, odd input."""

import random

from lociframe.operators import ordering as O
from lociframe.operators.storage import writer
from lociframe.plans import ordering_queries as Q

SF = "/root/testdata/sf0.001"


def tables(spark, scaffolds, links):
    """scaffolds: lists of (length, gap behind); links: (a, ea, b, eb)."""
    rows, cid = [], 0
    for s, parts in enumerate(scaffolds):
        at = 0
        for length, gap in parts:
            rows.append((cid, s, at, at + length - 1))
            at, cid = at + length + gap, cid + 1
    return spark.createDataFrame(rows, "cid long, scaffold long, start long, end long"), spark.createDataFrame([(*x, i) for i, x in enumerate(links)], "a long, ea int, b long, eb int, nth long")


def order(spark, scaffolds, links, **more):
    out = {}
    for r in sorted(O.ordered_contigs(*tables(spark, scaffolds, links), writer(spark), **more).collect(), key=lambda r: (r.scaffold, r.place)):
        out.setdefault(r.scaffold, []).append((r.cid, r.way, r.gap))
    return out


def ways(found):
    return {k: "".join(f"{w}{c}" for c, w, _ in v) for k, v in found.items()}


def test_two_scaffolds_become_one(spark):
    # the end of one joined with the end of another that is turned
    got = order(spark, [[(963, 20), (500, 0)], [(956, 0)], [(70, 0)]], [(1, 1, 2, 1)])
    assert got == {0: [(0, "+", 0), (1, "+", 20), (2, "-", 17)], 3: [(3, "+", 0)]}


def test_a_small_scaffold_goes_into_a_gap_with_room(spark):
    scaffolds, links = [[(1000, 400), (1000, 50), (1000, 0)], [(300, 0)], [(900, 0)]], [(0, 1, 3, 0), (1, 1, 4, 0)]
    assert ways(order(spark, scaffolds, links)) == {0: "+0+3+1+2", 4: "+4"}  # 900 letters don't fit into 50 + 100
    assert ways(order(spark, scaffolds, links, ignore_gaps=True)) == {0: "+0+3+1+4+2"}
    assert ways(order(spark, [[(1000, 400), (1000, 0)], [(300, 0)]], [(2, 1, 1, 0)])) == {0: "+0+2+1"}  # hangs before 1


def test_a_bridge_replaces_a_gap(spark):
    # 0 and 1 follow each other; 2 is linked with both
    assert ways(order(spark, [[(1000, 400), (1000, 0)], [(300, 0)]], [(0, 1, 2, 1), (2, 0, 1, 0)])) == {0: "+0-2+1"}


def test_cycles_lose_their_connections(spark):
    scaffolds, links = [[(500, 10), (500, 10), (500, 0)], [(80, 0)]], [(2, 1, 0, 0), (2, 1, 3, 0)]
    c, e = tables(spark, scaffolds, links)
    assert sorted(r.cid for r in O.cyclic_contigs(c, e, writer(spark)).collect()) == [0, 1, 2]
    assert O.acyclic_links(c, e, writer(spark)).collect() == []
    assert ways(order(spark, scaffolds, links)) == {0: "+0+1+2", 3: "+3"}


def test_turned_contigs_lose_their_connections(spark):
    # 3 would have to be both ways round between 0 and 1: it is entered by its left end from either side
    assert ways(order(spark, [[(500, 400), (500, 0)], [(80, 0)], [(60, 0)]], [(0, 1, 2, 0), (1, 0, 2, 0), (2, 1, 3, 0)])) == {0: "+0+1", 2: "+2", 3: "+3"}


def plain_cyclic(n, near):
    """Contigs on some simple way through opposite ends that comes back, by trying all."""
    found = set()

    def go(start, node, entered, path):
        for v, e in near.get((node, 1 - entered), ()):
            if v == start:
                found.update(path)
            elif v not in path:
                go(start, v, e, [*path, v])

    for s in range(n):
        for entered in (0, 1):
            go(s, s, entered, [s])
    return found


def test_random_graphs(spark):
    """Many small graphs in one table: runs of contigs change nothing, each contig is there once, marked ones lie on cycles and none is left without their connections."""
    rng = random.Random(31)
    scaffolds, links, graphs = [], [], []
    for _ in range(60):
        own = [[(rng.randrange(50, 900), rng.randrange(5, 600)) for _ in range(rng.randrange(1, 7))] for _ in range(rng.randrange(2, 6))]
        n, first = sum(map(len, own)), sum(map(len, scaffolds))
        ends = [(first + rng.randrange(n), rng.randrange(2), first + rng.randrange(n), rng.randrange(2)) for _ in range(rng.randrange(0, 5))]
        graphs.append((first, own, [x for x in ends if x[0] != x[2]]))
        scaffolds += own
        links += graphs[-1][2]
    got, alone = order(spark, scaffolds, links), order(spark, scaffolds, links, merge=False)
    assert got == alone
    c, e = tables(spark, scaffolds, links)
    cyclic = {r.cid for r in O.cyclic_contigs(c, e, writer(spark)).collect()}
    cids = [c for v in got.values() for c, _, _ in v]
    assert len(cids) == len(set(cids)) and all(k == v[0][0] for k, v in got.items())
    changed = 0
    for first, own, some in graphs:
        raw, nth = {}, 0
        for parts in own:
            for i in range(len(parts)):
                if i:
                    raw.setdefault((nth - 1, 1), []).append((nth, 0))
                    raw.setdefault((nth, 0), []).append((nth - 1, 1))
                nth += 1

        def linked(ends):
            near = {k: list(v) for k, v in raw.items()}  # noqa: B023
            for a, ea, b, eb in ends:
                near.setdefault((a - first, ea), []).append((b - first, eb))  # noqa: B023
                near.setdefault((b - first, eb), []).append((a - first, ea))  # noqa: B023
            return near

        marked = {x - first for x in cyclic if first <= x < first + nth}
        every = plain_cyclic(nth, linked(some))
        assert marked <= every and bool(marked) == bool(every)
        assert not plain_cyclic(nth, linked([x for x in some if x[0] - first not in marked and x[2] - first not in marked]))
        at, starts = first, []
        for parts in own:
            starts.append(at)
            at += len(parts)
        untouched = {k: [c for c, _, _ in got[k]] for k in starts if k in got}
        if not some:
            assert all(untouched[k] == list(range(k, k + len(p))) for k, p in zip(starts, own, strict=True))
        changed += any(k not in got for k in starts)
    assert changed > 15


def test_odd_input(spark):
    assert order(spark, [[(5, 1), (6, 0)]], []) == {0: [(0, "+", 0), (1, "+", 1)]}
    assert order(spark, [[(5, 1), (6, 0)]], [(1, 1, 99, 0), (0, 1, 1, 0), (0, 1, 1, 0)]) == {0: [(0, "+", 0), (1, "+", 1)]}
    c, e = tables(spark, [[(5, 0)]], [])
    assert O.ordered_contigs(c.limit(0), e, writer(spark)).collect() == [] == O.cyclic_contigs(c, e, writer(spark)).collect()


def test_queries_cover_all_contigs(spark):
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    rows = Q.ordered_contigs(spark, SF).collect()
    assert len({r.cid for r in rows}) == len(rows) == n
    cyclic = {r.cid for r in Q.cyclic_contigs(spark, SF).collect()}
    left = Q.acyclic_links(spark, SF).collect()
    assert left and all(r.a not in cyclic and r.b not in cyclic for r in left if abs(r.a - r.b) > 1)
    assert any(len({r.cid // 8 for r in rows if r.scaffold == s}) > 1 for s in {r.scaffold for r in rows})
