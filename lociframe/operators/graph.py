"""Graph operators on edge DataFrames: orientation, reciprocity, components, reachability, path covers."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.support import rates_differ
from .intervals import point_join


def swapped(dir_: Column) -> Column:
    """Orientation of an edge seen from its other end: the two bits change places."""
    return F.shiftright(dir_, 1).bitwiseOR(F.shiftleft(dir_.bitwiseAND(1), 1))


#: Nodes are sequence * NUMBERS + number of the block along it, so that no two sequences share a node.
NUMBERS = 1 << 40


def mate_graph(reads: DataFrame, exons: DataFrame, limit: DataFrame) -> DataFrame:
    """Edges between gene blocks by the places of a read and its mate: u, v, dir (bit 1: read is reverse, bit 0: mate is), with support.

    reads(tid, pos, rev, mtid, mpos, mrev, nh, nm), exons(tid, gid, start, end, left_splice, right_splice; disjoint),
    limit(residual: one row). Both places lie in exons, of different blocks, and the exons beyond them on the way that
    each strand points, trimmed at splices, come to at most the limit; a limit of null, as of no pairs to estimate it from, keeps all.
    """
    length = F.coalesce("right_splice", "end") - F.coalesce("left_splice", "start") + 1
    w = Window.partitionBy("tid", "gid").orderBy("start")
    side = lambda *rows: F.coalesce(F.sum(length).over(w.rowsBetween(*rows)), F.lit(0))
    e = exons.withColumns({"_after": side(1, Window.unboundedFollowing), "_before": side(Window.unboundedPreceding, -1)})
    node = F.col("tid") * NUMBERS + F.col("gid")
    ends = lambda x, tid: e.select(F.col("tid").alias(tid), node.alias(x), F.col("start").alias(f"_{x}s"), F.col("end").alias(f"_{x}e"), F.col("_after").alias(f"_{x}after"), F.col("_before").alias(f"_{x}before"))
    r = point_join(reads.select("tid", "pos", "rev", "mtid", "mpos", "mrev", "nh", "nm"), "pos", ends("u", "tid"), "_us", "_ue", "tid")
    r = point_join(r, "mpos", ends("v", "mtid"), "_vs", "_ve", "mtid").where("u <> v")
    residual = F.when(F.col("rev") == 1, F.col("_ubefore")).otherwise(F.col("_uafter")) + F.when(F.col("mrev") == 1, F.col("_vbefore")).otherwise(F.col("_vafter"))
    r = r.crossJoin(F.broadcast(limit.select("residual"))).where(F.coalesce(residual <= F.col("residual"), F.lit(True)))
    r = r.withColumn("dir", (2 * F.col("rev") + F.col("mrev")).cast("int"))
    return r.groupBy("u", "v", "dir").agg(F.count("*").alias("n"), F.sum(F.when(F.col("nh") <= 1, 1).otherwise(0)).alias("uniq"), F.sum("nm").alias("nm_sum"), F.min("pos").alias("left_pos"), F.max("mpos").alias("right_pos"), F.countDistinct("pos").alias("coords"))


def repeat_classes(reads: DataFrame, exons: DataFrame, least: int, write) -> DataFrame:
    """(node, root): classes of gene blocks that at least `least` reads place in both: reads(tid, pos, ctid, cpos) have a second place, exons as in mate_graph."""
    node = F.col("tid") * NUMBERS + F.col("gid")
    ends = lambda x, tid: exons.select(F.col("tid").alias(tid), node.alias(x), F.col("start").alias(f"_{x}s"), F.col("end").alias(f"_{x}e"))
    r = point_join(reads.select("tid", "pos", "ctid", "cpos"), "pos", ends("u", "tid"), "_us", "_ue", "tid")
    r = point_join(r, "cpos", ends("v", "ctid"), "_vs", "_ve", "ctid").where("u <> v")
    return components(r.groupBy("u", "v").agg(F.count("*").alias("n")).where(F.col("n") >= least), write)


def clipped_graph(reads: DataFrame, exons: DataFrame, limit: DataFrame, shortest: int) -> DataFrame:
    """Edges (u, v, dir, n) that other hits of clipped reads tell of.

    reads(rid, tid, pos, rev, first, mtid, mpos, mrev, supplementary, hits): first is the length of the first segment,
    hits an array of (tid, pos, rev, len) in order. Reads whose first segment is longer than `shortest` count, if they
    lie in an exon and their mate does. Where the mate lies on another sequence than the read, the read's own place
    counts. Else the first hit of at least `shortest` letters takes its place: one of another block than the read's, if
    the mate lies in that one (supplementary reads don't count then), or one on another sequence than the mate; it has
    to lie in an exon, and the read and its mate change their roles. exons and limit are as in mate_graph.
    """
    length = F.coalesce("right_splice", "end") - F.coalesce("left_splice", "start") + 1
    w = Window.partitionBy("tid", "gid").orderBy("start")
    side = lambda *rows: F.coalesce(F.sum(length).over(w.rowsBetween(*rows)), F.lit(0))
    e = exons.withColumns({"_after": side(1, Window.unboundedFollowing), "_before": side(Window.unboundedPreceding, -1), "_node": F.col("tid") * NUMBERS + F.col("gid")})
    ends = lambda x, tid: e.select(F.col("tid").alias(tid), F.col("_node").alias(x), F.col("start").alias(f"_{x}s"), F.col("end").alias(f"_{x}e"), F.col("_after").alias(f"{x}_after"), F.col("_before").alias(f"{x}_before"))
    r = point_join(reads.where(F.col("first") > shortest), "pos", ends("u", "tid"), "_us", "_ue", "tid").drop("_us", "_ue")
    r = point_join(r, "mpos", ends("v", "mtid"), "_vs", "_ve", "mtid").drop("_vs", "_ve")
    far = F.col("tid") != F.col("mtid")
    beyond = lambda x, rev: F.when(F.col(rev) == 1, F.col(f"{x}_before")).otherwise(F.col(f"{x}_after"))
    own = r.where(far).select("u", "v", (2 * F.col("rev") + F.col("mrev")).alias("dir"), (beyond("u", "rev") + beyond("v", "mrev")).alias("room"))
    long = r.where(~far & ~((F.col("u") == F.col("v")) & F.col("supplementary"))).withColumn("hits", F.filter("hits", lambda h: h["len"] >= shortest))
    hit = long.select("rid", "u", "v", "mtid", "mrev", "v_after", "v_before", (F.size("hits") == 1).alias("_only"), F.posexplode("hits").alias("_nth", "_h"))
    hit = hit.select("rid", "u", "v", "mtid", "mrev", "v_after", "v_before", "_only", "_nth", F.col("_h.tid").alias("htid"), F.col("_h.pos").alias("hpos"), F.col("_h.rev").alias("hrev"), F.col("_h.len").alias("hlen"))
    hit = point_join(hit, "hpos", ends("h", "htid"), "_hs", "_he", "htid").where(F.when(F.col("u") == F.col("v"), F.col("h") != F.col("u")).otherwise(F.col("htid") != F.col("mtid")))
    # only reads with several such hits have to be brought together to find the first
    first = hit.where(~F.col("_only")).withColumn("_r", F.row_number().over(Window.partitionBy("rid").orderBy("_nth"))).where("_r = 1").drop("_r").unionByName(hit.where("_only"))
    moved = first.select(F.col("v").alias("u"), F.col("h").alias("v"), (2 * F.col("hrev") + F.col("mrev")).bitwiseXOR(F.lit(3)).alias("dir"), (beyond("h", "hrev") + beyond("v", "mrev")).alias("room"))
    both = own.unionByName(moved).where("u <> v").crossJoin(F.broadcast(limit.select("residual"))).where(F.coalesce(F.col("room") <= F.col("residual"), F.lit(True)))
    return both.groupBy("u", "v", F.col("dir").cast("int").alias("dir")).agg(F.count("*").alias("n"))


def family_edges(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """edges(u, v, ...) whose ends lie in one class of repeats."""
    of = lambda x: classes.select(F.col("node").alias(x), F.col("root").alias(f"_{x}"))
    return edges.join(of("u"), "u").join(of("v"), "v").where("_u = _v").select(*edges.columns)


def misassembled(paths: DataFrame, contigs: DataFrame, write) -> DataFrame:
    """(contig, u, v): contigs that a way leaves from one block, u, and comes back to at another, v, along path edges(u, v) between blocks and from block to block within other contigs (contigs: node, contig).

    Such a way exists just where two edges of a ring of contigs meet a contig at different blocks: two edges lie on one
    ring if they are in one biconnected part of the graph of contigs. Components are found by joins; the parts of a
    component, as large as its paths, in one task. u and v are the least pair.
    """
    import pandas as pd

    of = lambda x: contigs.select(F.col("node").alias(x), F.col("contig").alias(f"c{x}"))
    edges = write(paths.select("u", "v").join(of("u"), "u").join(of("v"), "v").where("cu <> cv"), "between-contigs")
    labels = components(edges.select(F.col("cu").alias("u"), F.col("cv").alias("v")), write)

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf[["u", "v", "cu", "cv"]].drop_duplicates().itertuples(index=False, name=None))
        near: dict = {}
        for i, (_, _, a, b) in enumerate(rows):
            near.setdefault(a, []).append((b, i))
            near.setdefault(b, []).append((a, i))
        found: dict = {}
        depth: dict = {}
        low: dict = {}
        open_edges: list[int] = []
        seen: set[int] = set()
        for root in sorted(near):
            if root in depth:
                continue
            depth[root] = low[root] = 0
            stack = [(root, iter(near[root]), 0)]  # with the number of edges that were open when the contig was entered
            while stack:
                at, rest, opened = stack[-1]
                for b, i in rest:
                    if i in seen:
                        continue
                    seen.add(i)
                    open_edges.append(i)
                    if b in depth:
                        low[at] = min(low[at], depth[b])
                        continue
                    depth[b] = low[b] = depth[at] + 1
                    stack.append((b, iter(near[b]), len(open_edges) - 1))
                    break
                else:
                    stack.pop()
                    if not stack:
                        continue
                    above = stack[-1][0]
                    low[above] = min(low[above], low[at])
                    if low[at] >= depth[above]:  # the edges since the one that led here are a part
                        part: dict = {}
                        for i in open_edges[opened:]:
                            for block, contig in ((rows[i][0], rows[i][2]), (rows[i][1], rows[i][3])):
                                part.setdefault(contig, set()).add(block)
                        del open_edges[opened:]
                        for contig, blocks in part.items():
                            if len(blocks) > 1:
                                pair = tuple(sorted(blocks)[:2])
                                found[contig] = min(found.get(contig, pair), pair)
        return pd.DataFrame([(c, *p) for c, p in sorted(found.items())], columns=["contig", "u", "v"], dtype="int64")

    rooted = edges.join(labels.select(F.col("node").alias("cu"), "root"), "cu")
    return rooted.groupBy("root").applyInPandas(parts, "contig long, u long, v long")


def best_orientation(edges: DataFrame, length: int) -> DataFrame:
    """edges(u, v, dir, n): u, v, best dir or -1 if the second is too near, and both counts. Ties go to the lower dir."""
    w = Window.partitionBy("u", "v").orderBy(F.desc("n"), "dir")
    top = edges.withColumns({"_r": F.row_number().over(w), "n_second": F.coalesce(F.lead("n").over(w), F.lit(0))}).where("_r = 1")
    near = ((F.col("n_second") == 1) & (F.col("n") == 2)) | ((F.col("n_second") > 1) & ~rates_differ(F.col("n"), F.lit(length), F.col("n_second"), F.lit(length)))
    return top.select("u", "v", F.when(near, -1).otherwise(F.col("dir")).alias("best"), "n", "n_second")


def reciprocal(edges: DataFrame, dir_: str = "dir") -> DataFrame:
    """Edges whose reverse is there with its bits swapped."""
    back = edges.select(F.col("v").alias("_u"), F.col("u").alias("_v"), swapped(F.col(dir_)).alias("_d"))
    return edges.join(back, (F.col("u") == F.col("_u")) & (F.col("v") == F.col("_v")) & (F.col(dir_) == F.col("_d")), "left_semi")


def components(edges: DataFrame, write, a: str = "u", b: str = "v") -> DataFrame:
    """(node, root): the least node that edges lead to, found by contraction.

    In each round every node goes to the neighbour that comes first in an order drawn for the round, if that comes
    before itself, four such steps are taken at once, and the edges between what is left go on. As the order is drawn,
    ways to its first nodes are short and at most half of the nodes are such, whatever their numbers are; the edges
    shrink with them, so all rounds together cost a few times the first. `write(df, name)` keeps a round's tables in
    storage that survives executors and gives them back.
    """
    every = write(edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct(), "edges")
    rest, rounds = every.where("x < y"), []
    to = lambda table, node, up: table.select(F.col("node").alias(node), F.col("up").alias(up))
    for i in count():  # ends, as an edge's later end always goes
        drawn = lambda c, i=i: F.struct(F.xxhash64(F.lit(i), F.col(c)).alias("h"), F.col(c).alias("node"))
        both = rest.select(F.col("x").alias("node"), drawn("y").alias("to")).unionByName(rest.select(F.col("y").alias("node"), drawn("x").alias("to")))
        first = both.groupBy("node").agg(F.min("to").alias("to")).where(F.col("to") < drawn("node"))
        up = write(first.select("node", F.col("to.node").alias("up")), f"first-{i}")
        if up.isEmpty():
            break
        for _ in range(2):
            up = up.join(to(up, "up", "_up"), "up", "left").select("node", F.coalesce("_up", "up").alias("up"))
        up = write(up, f"up-{i}")
        rounds.append(up)
        moved = rest.join(to(up, "x", "_x"), "x", "left").join(to(up, "y", "_y"), "y", "left").select(F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y")).where("x <> y")
        rest = write(moved.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), f"edges-{i}")
    found = every.select(F.col("x").alias("node")).unionByName(every.select(F.col("y").alias("node"))).distinct()
    if not rounds:
        return found.select("node", F.col("node").alias("root"))
    ends = rounds.pop()
    for i, up in enumerate(reversed(rounds)):  # a node that has gone in a round may still name others in the next
        ends = write(up.join(to(ends, "up", "_up"), "up", "left").select("node", F.coalesce("_up", "up").alias("up")).unionByName(ends.join(up, "node", "left_anti")), f"ends-{i}")
    found = write(found.join(ends, "node", "left").select("node", F.coalesce("up", "node").alias("up")), "ends")
    return found.join(found.groupBy("up").agg(F.min("node").alias("root")), "up").select("node", "root")


def reachable(edges: DataFrame, seeds: DataFrame, write) -> DataFrame:
    """(seed, node) pairs: all nodes that directed edges(u, v) lead to from each seed(node). The frontier is joined with the edges until it adds nothing."""
    seen = write(seeds.select(F.col("node").alias("seed"), "node").distinct(), "seen-0")
    front = seen
    for i in count(1):  # ends, as a pair is new once
        new = front.join(edges.select(F.col("u").alias("node"), "v"), "node").select("seed", F.col("v").alias("node")).distinct()
        front = write(new.join(seen, ["seed", "node"], "left_anti"), f"front-{i}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if i % 8 == 0:
            seen = write(seen, f"seen-{i}")
    return seen


def chains(links: DataFrame, order: list[str], least: int) -> DataFrame:
    """links(chain, ord, support of the link to the next; null at the end): pieces of chains cut where support is below `least`; pieces of one go."""
    w = Window.partitionBy("chain").orderBy(*order)
    cut = F.coalesce(F.lag("support").over(w) < least, F.lit(False)).cast("int")
    pieces = links.withColumn("_cut", cut).withColumn("piece", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")
    return pieces.withColumn("size", F.count("*").over(Window.partitionBy("chain", "piece"))).where("size > 1")


def greedy_paths(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Path cover of each component: edges(u, du, v, dv, n) join end du of u with end dv of v; labels(node, root).

    Edges are taken by support; one whose nodes are both unused starts a path, which grows at either end over the
    best edge out of the node's other end, while its support is at least a fiftieth of the one before. A component
    is one sequential problem and goes to one task. Result: root, path, place, node, way (1: left to right), support.
    """
    import pandas as pd

    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf[["u", "du", "v", "dv", "n"]].itertuples(index=False, name=None))
        out_of: dict = {}
        for u, du, v, dv, n in rows:
            out_of.setdefault((u, du), []).append((n, v, dv))
            out_of.setdefault((v, dv), []).append((n, u, du))
        used: set = set()
        out = []

        def grow(node, end, n) -> list:
            path = []
            while True:
                best = max((e for e in out_of.get((node, end), []) if e[1] not in used), key=lambda e: (e[0], -e[1], -e[2]), default=None)
                if best is None or best[0] < n // 50:
                    return path
                n, node, entered = best
                used.add(node)
                path.append((node, entered, n))
                end = 1 - entered

        number = 0
        for u, du, v, dv, n in sorted(rows, key=lambda r: (-r[4], r[0], r[2], r[1], r[3])):
            if u in used or v in used or u == v:
                continue
            used |= {u, v}
            left, right = grow(u, 1 - du, n), grow(v, 1 - dv, n)
            path = [(x, int(e == 1)) for x, e, _ in left[::-1]] + [(u, int(du == 1)), (v, int(dv == 0))] + [(x, int(e == 0)) for x, e, _ in right]
            support = min([n, *(s for _, _, s in left), *(s for _, _, s in right)])
            out += [(pdf["root"].iloc[0], number, i, x, way, support) for i, (x, way) in enumerate(path)]
            number += 1
        return pd.DataFrame(out, columns=["root", "path", "place", "node", "way", "support"])

    rooted = edges.join(labels.select(F.col("node").alias("u"), "root"), "u")
    return rooted.groupBy("root").applyInPandas(cover, "root long, path long, place long, node long, way int, support long")


def path_order(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Layers of a directed graph within components, by taking away nodes without predecessors; nodes on cycles get -1. Result: node, layer."""
    import pandas as pd

    def layers(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict = {}
        waiting: dict = {}
        for u, v in set(zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True)):
            after.setdefault(u, []).append(v)
            waiting[v] = waiting.get(v, 0) + 1
            waiting.setdefault(u, 0)
        layer, now = {}, [x for x, n in waiting.items() if not n]
        depth = 0
        while now:
            new = []
            for x in now:
                layer[x] = depth
                for y in after.get(x, []):
                    waiting[y] -= 1
                    if not waiting[y]:
                        new.append(y)
            now, depth = new, depth + 1
        return pd.DataFrame({"node": list(waiting), "layer": [layer.get(x, -1) for x in waiting]})

    rooted = edges.join(labels.select(F.col("node").alias("u"), "root"), "u")
    return rooted.groupBy("root").applyInPandas(layers, "node long, layer long")
