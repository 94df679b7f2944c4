"""Mate edges between gene blocks against plain loops."""

import random
from collections import Counter

from lociframe.operators import graph
from lociframe.operators.storage import writer
from lociframe.plans import graph_queries as GQ
from lociframe.plans import interval_queries as Q
from lociframe.plans import reads as R
from lociframe.plans import registry

SF = "/root/testdata/sf0.001"


def plain_edges(reads, exons, limit):
    blocks = {}
    for e in sorted(exons):
        blocks.setdefault(e[:2], []).append(e[2:])

    def find(tid, pos):
        return next(((t, g, i) for (t, g), es in blocks.items() if t == tid for i, e in enumerate(es) if e[0] <= pos <= e[1]), None)

    def beyond(at, rev):
        es = blocks[at[:2]]
        return sum((e[1] if e[3] is None else e[3]) - (e[0] if e[2] is None else e[2]) + 1 for e in (es[: at[2]] if rev else es[at[2] + 1 :]))

    found = Counter()
    for tid, pos, rev, mtid, mpos, mrev in reads:
        a, b = find(tid, pos), find(mtid, mpos)
        if a and b and a[:2] != b[:2] and (limit is None or beyond(a, rev) + beyond(b, mrev) <= limit):
            found[(a[0] << 40) + a[1], (b[0] << 40) + b[1], 2 * rev + mrev] += 1
    return found


def test_mate_graph(spark):
    exons = [(0, 1, 100, 200, None, 180), (0, 1, 300, 400, 310, None), (0, 1001, 25_100_000, 25_100_500, None, None), (1, 1, 25, 90, None, None), (1, 2, 200, 300, None, None), (1, 2, 900, 999, 910, 990)]
    reads = [(0, 150, r, t, p, m) for r in (0, 1) for m in (0, 1) for t, p in ((1, 50), (1, 250), (1, 950), (0, 25_100_100), (0, 350), (0, 250))] + [(0, 25_100_100, 1, 1, 50, 1), (1, 50, 0, 1, 60, 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in reads], "tid long, pos long, rev int, mtid long, mpos long, mrev int, nh int, nm int")
    ex = spark.createDataFrame(exons, "tid long, gid long, start long, end long, left_splice long, right_splice long")
    for limit in (None, 100, 50):
        got = graph.mate_graph(df, ex, spark.createDataFrame([(limit,)], "residual long")).collect()
        want = plain_edges(reads, exons, limit)
        assert {(r.u, r.v, r.dir): r.n for r in got} == want and len(want) > 4
        assert all(r.uniq == r.n and r.nm_sum == 2 * r.n for r in got)


def test_gene_mate_edges_of_reads(spark, monkeypatch):
    exons = GQ.block_exons(spark, SF).cache()  # its rounds of labels run once
    monkeypatch.setattr(GQ, "block_exons", lambda *_: exons)
    reads = [tuple(r) for r in R.reads(spark, SF).where(R.admitted()).where("mtid is not null").select("tid", "pos", "rev", "mtid", "mpos", "mrev").collect()]
    rows = [tuple(r) for r in exons.select("tid", "gid", "start", "end", "left_splice", "right_splice").collect()]
    f = [r.f for r in Q.inner_pairs(spark, SF).select("f").collect()]
    limit = None
    if f:
        mean = sum(f) // len(f)
        limit = mean + 2 * int(max(sum(x * x for x in f) / len(f) - mean * mean, 0) ** 0.5)
    edges = GQ.edges_of_blocks(spark, SF)
    got = {(r.u, r.v, r.dir): r.n for r in edges.collect()}
    assert got == plain_edges(reads, rows, limit) and got
    nodes = {r.tid * graph.NUMBERS + r.gid for r in GQ.gene_blocks(spark, SF).select("tid", "gid").collect()}
    best = GQ.edge_orientation(spark, SF, edges=lambda *_: edges).collect()
    assert {r.u for r in best} | {r.v for r in best} <= nodes
    assert {"gene_mate_edges", "gene_reachability", "gene_path_layers", "gene_greedy_paths"} <= set(registry.queries())


def test_gene_queries_on_loci(spark):
    """Every query over gene blocks has rows on the table of loci, and they say what plain loops over the edges say."""
    folder = GQ.genes(spark, SF)
    assert spark.read.parquet(f"{folder}/lineitem.parquet").count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    exons, edges = GQ.gene_exons(spark, SF), GQ.gene_mate_edges(spark, SF)
    rows = edges.collect()
    reads = [tuple(r) for r in R.reads(spark, folder).where(R.admitted()).where("mtid is not null").select("tid", "pos", "rev", "mtid", "mpos", "mrev").collect()]
    found = [tuple(r) for r in exons.select("tid", "gid", "start", "end", "left_splice", "right_splice").collect()]
    got = {(r.u, r.v, r.dir): r.n for r in rows}
    unlimited = plain_edges(reads, found, None)
    assert got and all(unlimited[k] >= n for k, n in got.items())
    given = lambda *_: edges
    best = {(r.u, r.v): r.best for r in GQ.edge_orientation(spark, SF, edges=given).collect()}
    turn = lambda d: d >> 1 | (d & 1) << 1
    kept = {(u, v, d) for (u, v), d in best.items() if d >= 0 and best.get((v, u), -1) == turn(d)}
    assert {(r.u, r.v, r.dir) for r in GQ.reciprocal_edges(spark, SF, given).collect()} == kept and len(kept) > 20
    assert {(r.u, r.v) for r in GQ.one_way_edges(spark, SF, given).collect()} == {k for k, d in best.items() if d >= 0} - {(u, v) for u, v, _ in kept}
    sides = {}
    for u, _, d in kept:
        sides.setdefault(u, [0, 0])[d >> 1] += 1
    assert {(r.node, r["left"], r["right"]) for r in GQ.terminal_nodes(spark, SF, given).collect()} == {(u, b, a) for u, (a, b) in sides.items() if not a or not b}
    up = {(u, v) for u, v, _ in kept if u < v}
    layers = {r.node: r.layer for r in GQ.path_layers(spark, SF, given).collect()}
    assert layers.keys() == {x for e in up for x in e} and all(layers[u] < layers[v] for u, v in up)
    paths = {}
    for r in GQ.greedy_paths(spark, SF, given).collect():
        paths.setdefault((r.root, r.path), []).append((r.place, r.node))
    nodes = [n for p in paths.values() for _, n in p]
    assert len(nodes) == len(set(nodes)) and all((min(a, b), max(a, b)) in up for p in paths.values() for (_, a), (_, b) in zip(sorted(p), sorted(p)[1:], strict=False))
    order = GQ.scaffold_order(spark, SF, given).collect()
    assert len(order) == len(paths) and [r.support for r in order] == sorted((r.support for r in order), reverse=True)
    reach = {(r.seed, r.node) for r in GQ.reachability(spark, SF, given, graph.NUMBERS).collect()}
    want = set()
    for s in {min(u for u, _ in up if u // graph.NUMBERS == t) for t in {u // graph.NUMBERS for u, _ in up}}:
        front = {s}
        while front:
            want |= {(s, x) for x in front}
            front = {v for u, v in up if u in front} - {x for t, x in want if t == s}
    assert reach == want
    tops = {(r.u, r.side): r.n for r in GQ.end_assignment(spark, SF, given).collect()}
    counts = {}
    for u, v, d in kept:
        counts.setdefault((u, 0 if d >= 2 else 1), []).append(max(n for (a, b, _), n in got.items() if (a, b) == (u, v)))
    assert tops == {k: max(v) for k, v in counts.items()}
    assert GQ.ambiguous_sides(spark, SF, given).count() > 0 and GQ.strand_consistency(spark, SF, given, GQ._gene_votes).count() == sum(d >= 0 for d in best.values())


def plain_circles(paths, contig):
    """Contigs to which a search from some block, along paths and within other contigs, comes back at another block."""
    near = {}
    for u, v in paths:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    found = set()

    def search(start, at, seen):
        seen.add(at)
        for n in near.get(at, ()):
            if n in seen:
                continue
            if contig[at] != contig[start] and contig[n] == contig[start]:
                return True
            if search(start, n, seen):
                return True
        if contig[at] != contig[start]:
            for n in contig:
                if contig[n] == contig[at] and n not in seen and search(start, n, seen):
                    return True
        return False

    for s in contig:
        if search(s, s, set()):
            found.add(contig[s])
    return found


def test_misassembled_contigs(spark):
    rng = random.Random(19)
    edges, blocks, want = [], {}, set()
    for g in range(80):
        n, parts = rng.randrange(3, 12), rng.randrange(2, 6)
        contig = {100 * g + i: 10 * g + rng.randrange(parts) for i in range(n)}
        order = rng.sample(sorted(contig), n)
        paths = [(a, b) for a, b in zip(order, order[1:], strict=False) if rng.random() < 0.6]
        want |= plain_circles(paths, contig)
        edges += paths
        blocks |= contig
    got = graph.misassembled(spark.createDataFrame(edges, "u long, v long"), spark.createDataFrame(list(blocks.items()), "node long, contig long"), writer(spark)).collect()
    assert {r.contig for r in got} == want and 10 < len(want) < len(set(blocks.values()))
    assert all(blocks[r.u] == blocks[r.v] == r.contig and r.u < r.v for r in got)


def test_repeats_and_clipped_reads(spark):
    exons = spark.createDataFrame([(0, 1, 100, 199, None, None), (0, 1, 300, 399, None, None), (0, 2, 600, 699, None, None), (1, 1, 100, 199, None, None), (2, 1, 100, 199, None, None)], "tid long, gid long, start long, end long, left_splice long, right_splice long")
    node = lambda t, g: t * graph.NUMBERS + g
    seconds = [(0, 150, 1, 120)] * 3 + [(1, 110, 2, 199)] * 2 + [(0, 650, 0, 150)] * 3 + [(0, 250, 1, 120)] * 5
    classes = {r.node: r.root for r in graph.repeat_classes(spark.createDataFrame(seconds, "tid long, pos long, ctid long, cpos long"), exons, 3, writer(spark)).collect()}
    assert classes == {node(0, 1): 1, node(1, 1): 1, node(0, 2): 1}
    kind = "rid long, tid long, pos long, rev int, first long, mtid long, mpos long, mrev int, supplementary boolean, hits array<struct<tid: long, pos: long, rev: int, len: int>>"
    rows = [
        (1, 0, 150, 0, 50, 1, 120, 1, False, [(2, 150, 0, 90)]),  # the mate is elsewhere: own place
        (2, 0, 150, 0, 50, 0, 320, 1, False, [(2, 150, 0, 20), (0, 120, 0, 90), (2, 160, 1, 90), (1, 150, 0, 90)]),  # own block: first long hit in another
        (3, 0, 150, 0, 50, 0, 320, 1, True, [(2, 160, 1, 90)]),  # supplementary
        (4, 0, 150, 1, 50, 0, 650, 0, False, [(0, 150, 0, 90), (1, 150, 0, 90)]),  # another block of its sequence: a hit on another one
        (5, 0, 150, 0, 34, 1, 120, 1, False, []), (6, 0, 250, 0, 50, 1, 120, 1, False, []), (7, 0, 150, 0, 50, 0, 250, 1, False, [(1, 150, 0, 90)]),
    ]
    reads = spark.createDataFrame(rows, kind)
    got = lambda limit: {(r.u, r.v, r.dir): r.n for r in graph.clipped_graph(reads, exons, spark.createDataFrame([(limit,)], "residual long"), 34).collect()}
    assert got(None) == {(node(0, 1), node(1, 1), 1): 1, (node(0, 1), node(2, 1), 0): 1, (node(0, 2), node(1, 1), 3): 1}
    assert got(99) == {(node(0, 2), node(1, 1), 3): 1}
    edges = spark.createDataFrame([(node(0, 1), node(1, 1), 1), (node(0, 1), node(2, 1), 2)], "u long, v long, dir int")
    assert [tuple(r) for r in graph.family_edges(edges, graph.repeat_classes(spark.createDataFrame(seconds, "tid long, pos long, ctid long, cpos long"), exons, 3, writer(spark))).collect()] == [(node(0, 1), node(1, 1), 1)]


def test_gene_queries_of_repeats(spark):
    assert GQ.gene_misassembled(spark, SF).count() > 0
    clipped = GQ.gene_clipped_edges(spark, SF).collect()
    assert clipped and all(r.u != r.v and 0 <= r.dir <= 3 for r in clipped)
    assert GQ.gene_repeat_classes(spark, SF).count() > 10


def test_classes_of_islands_and_their_validity(spark):
    """By plain union of the edges, and by counting."""
    pairs = [((r.tid, r.u), (r.tid, r.v)) for r in Q.splice_edges(spark, SF).unionByName(Q.mate_edges_within(spark, SF)).collect()]
    good = {(r.tid, r.bid): r.good for r in Q.support_quality(spark, SF).select("tid", "bid", "good").collect()}
    label = {x: x for x in good}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    classes = {}
    for x in good:
        classes.setdefault(root(x), []).append(good[x])
    want = {t * 10_000_000 + b: (len(g), sum(g), sum(g) >= 1 and sum(g) >= 0.2 * len(g)) for (t, b), g in classes.items()}
    assert {r.root: (r.n, r.good, r.valid) for r in GQ.component_validity(spark, SF).collect()} == want and len(want) < len(good)


def test_components_shrink_from_round_to_round(spark):
    """All rounds together write little more than the edges, whatever the numbers are; self-loops and repeated edges count once."""
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(1500)]
    names = rng.sample(range(10**6), 1501)
    mixed = [(names[a], names[b]) for a, b in path]
    star = [(5000, i) for i in range(4000, 4900)]
    for edges in (path, mixed, star, [(7, 7), (9, 8), (8, 9)], []):
        write, rows = writer(spark), []

        def counted(df, name, write=write, rows=rows):
            kept = write(df, name)
            rows.append(kept.count())
            return kept

        out = graph.components(spark.createDataFrame(edges, "u long, v long"), counted).collect()
        got = {r.node: r.root for r in out}
        assert len(got) == len(out)
        root = {x: x for e in edges for x in e}

        def top(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        assert got == {x: top(x) for x in root}
        assert sum(rows) <= 9 * len(edges) + 10


def test_islands_are_made_once(spark, monkeypatch):
    made, whole = [], Q.exon_blocks
    monkeypatch.setattr(Q, "exon_blocks", lambda *a: (made.append(a), whole(*a))[1])
    GQ.block_exons(spark, SF)
    assert len(made) == 1


def test_first_of_several_hits(spark):
    """A hit that lies in no exon doesn't count; the first that does is taken, whether or not a read has others."""
    exons = spark.createDataFrame([(0, 1, 0, 99, None, None), (0, 2, 200, 299, None, None), (1, 1, 0, 99, None, None), (1, 2, 200, 299, None, None)], "tid long, gid long, start long, end long, left_splice long, right_splice long")
    hit = lambda tid, pos, n=40: (tid, pos, 0, n)
    rows = [(1, [hit(1, 10)]), (2, [hit(1, 150), hit(1, 210), hit(1, 10)]), (3, [hit(1, 210, 20), hit(1, 10)]), (4, []), (5, [hit(1, 150)])]
    df = spark.createDataFrame([(i, 0, 10, 0, 50, 0, 210, 1, False, h) for i, h in rows], "rid long, tid long, pos long, rev int, first long, mtid long, mpos long, mrev int, supplementary boolean, hits array<struct<tid: bigint, pos: bigint, rev: int, len: int>>")
    got = {(r.u, r.v): r.n for r in graph.clipped_graph(df, exons, spark.createDataFrame([(None,)], "residual long"), 34).collect()}
    n = graph.NUMBERS
    assert got == {(2, n + 1): 2, (2, n + 2): 1}
