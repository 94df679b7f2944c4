"""Contigs in the order that connections between them suggest: cycles are cut, branches merged, loose ends put into gaps.

A contig has a left (0) and a right (1) end. Neighbours along a raw scaffold are linked right to left, connections link
any two ends. Runs of contigs without connections are one node, so a component's graph is as large as its connections;
finding the runs, the components and the contigs behind the result is work for joins and windows. Ordering a component
is sequential (a contig taken by a longer scaffold is gone for the others) and is within one group. Components without
connections never go there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components

End = tuple[int, int]
#: Letters between contigs of different scaffolds; room that a gap need not have.
UNKNOWN_GAP, SLACK = 17, 100


class Graph:
    """Links between ends of nodes, the youngest first, as they are looked at."""

    def __init__(self, nodes: dict[int, tuple[int, ...]]):
        self.nodes = nodes  # node: scaffold, first and last contig, length, gap behind it (-1: none), length of the scaffold
        self.near: dict[End, list[End]] = {}
        self.raw: set[tuple[End, End]] = set()

    def link(self, a: End, b: End, raw: bool = False) -> None:
        if b in self.near.get(a, ()):
            return
        self.near.setdefault(a, []).insert(0, b)
        self.near.setdefault(b, []).insert(0, a)
        if raw:
            self.raw |= {(a, b), (b, a)}

    def without_connections(self, marked: set[int]) -> None:
        """Connections of marked nodes go, raw links stay."""
        for (n, e), ends in list(self.near.items()):
            self.near[n, e] = [x for x in ends if ((n, e), x) in self.raw or (n not in marked and x[0] not in marked)]

    def out(self, node: int, entered: int) -> list[End]:
        return self.near.get((node, 1 - entered), [])

    def walk(self, node: int, entered: int, stop: Callable[[int, int], bool] = lambda n, e: False) -> dict[int, int]:
        """Nodes that a way through opposite ends leads to, with the end that each is first entered by; ways end at a node where stop says so."""
        seen = {node: entered}
        stack = [] if stop(node, entered) else [iter(self.out(node, entered))]
        while stack:
            for n, e in stack[-1]:
                if n not in seen:
                    seen[n] = e
                    if not stop(n, e):
                        stack.append(iter(self.out(n, e)))
                        break
            else:
                stack.pop()
        return seen

    def cycle_through(self, node: int) -> list[int]:
        """Nodes of a way that leaves by an end and comes back to the node, passing through each other one's opposite ends; none: empty."""
        for entered in (0, 1):
            seen, path, stack = {node}, [node], [iter(self.out(node, entered))]
            while stack:
                for n, e in stack[-1]:
                    if n == node:
                        return path
                    if n not in seen:
                        seen.add(n)
                        path.append(n)
                        stack.append(iter(self.out(n, e)))
                        break
                else:
                    stack.pop()
                    path.pop()
        return []

    def cyclic(self) -> set[int]:
        found: set[int] = set()
        for n in sorted(self.nodes):
            if n not in found:
                found.update(self.cycle_through(n))
        return found

    def scaffolds(self) -> list[tuple[int, int, int]]:
        """(scaffold, first node, last node), longest first, equals by number."""
        by: dict[int, list[int]] = {}
        for n in sorted(self.nodes):
            by.setdefault(self.nodes[n][0], []).append(n)
        return [(s, ns[0], ns[-1]) for s, ns in sorted(by.items(), key=lambda kv: (-self.nodes[kv[1][0]][5], kv[0]))]

    def turned(self) -> set[int]:
        """Nodes that are entered by the same end on ways from a scaffold's beginning and from its end: there the orientation contradicts itself."""
        found: set[int] = set()
        for _, first, last in self.scaffolds():
            ahead = self.walk(first, 0)
            met = lambda n, e: ahead.get(n) == e  # noqa: E731, B023
            found.update(n for n, e in self.walk(last, 1, met).items() if met(n, e))
        return found


class Ordering:
    """Scaffolds built from a graph: each end of a node has at most one neighbour here."""

    def __init__(self, graph: Graph, ignore_gaps: bool = False):
        self.graph, self.ignore_gaps = graph, ignore_gaps
        self.next: dict[End, End] = {}
        self.used: set[int] = set()
        self.gap = {n: x[4] for n, x in graph.nodes.items()}
        for scaffold, first, last in graph.scaffolds():
            self.place(scaffold, first, last)

    def join(self, a: End, b: End) -> None:
        self.next[a], self.next[b] = b, a

    def insert(self, a: End, b: End) -> None:
        """Puts b's node between a and what a was joined with."""
        old = self.next.get(a)
        self.join(a, b)
        if old is not None:
            self.join((b[0], 1 - b[1]), old)

    def place(self, scaffold: int, first: int, last: int) -> None:
        queue, before, after, first_new = self.layers(first, last)
        if first_new is None:
            return
        g, own = self.graph, None
        of = lambda n: g.nodes[n][0]
        for n, _ in queue[:-1]:
            if of(n) == scaffold:
                own = n
            elif own is not None:
                self.gap[own] -= g.nodes[n][3]
        end = len(queue) - 1
        for j in range(end, -1, -1):
            if before[j] is None:
                break
            n, e = queue[before[j]]
            self.hang(queue[j][0], queue[j][1], 0 < j < end, next(k for k, _ in queue[j::-1] if of(k) == scaffold) if j < end else None, (n, 1 - e))
        for j in range(end + 1):
            at = first_new if before[j] is None or j <= first_new else j if before[j] == j else after[before[j]]
            if at is None:
                break
            self.hang(queue[j][0], 1 - queue[j][1], 0 < j < end, next(k for k, _ in queue[j - 1 :: -1] if of(k) == scaffold) if j else None, queue[at])

    def layers(self, first: int, last: int) -> tuple[list[End], list[int | None], list[int | None], int | None]:
        """Nodes on ways from the first to the last, in layers; for each the latest one that was new when it came and the next new one after it; and the first new one."""
        g = self.graph
        ahead, back = g.walk(first, 0), g.walk(last, 1)
        both = [n for n in back if n in ahead]
        inner = Graph({n: g.nodes[n] for n in both})
        for n in both:
            for e in (0, 1):
                for other in g.near.get((n, e), []):
                    if other[0] in inner.nodes:
                        inner.link((n, e), other)
        waiting = {end: len(x) for end, x in inner.near.items()}
        queue: list[End] = [(first, 0)]
        queued, before, after = {first}, [], []
        head, newest, first_new = 0, None, None
        single = lambda graph, end: len(graph.near.get(end, [])) == 1
        while head < len(queue):
            for j in range(head, len(queue)):
                n, e = queue[j]
                after.append(None)
                if n not in self.used:
                    self.used.add(n)
                    if newest is None:
                        first_new = j
                    else:
                        self.join((queue[newest][0], 1 - queue[newest][1]), (n, e))
                        after[newest] = j
                    newest = j
                before.append(newest)
                for x in inner.out(n, e):
                    waiting[x] -= 1
                    if waiting[x] or x[0] in queued:
                        continue
                    while True:  # a run without branches comes as a whole
                        queued.add(x[0])
                        queue.append(x)
                        way = (x[0], 1 - x[1])
                        if not (single(g, way) and single(inner, way)):
                            break
                        x = inner.near[way][0]
                        if x[0] in queued or not (single(g, x) and single(inner, x)):
                            break
                head = j + 1
        return queue, before, after, first_new

    def hang(self, node: int, entered: int, within: bool, own: int | None, at: End) -> None:
        """Puts the loose branch behind a node next to `at`, if it has room there: within a scaffold only as far as the last change of scaffolds."""
        branch = self.branch(node, entered)
        of = lambda i: self.graph.nodes[branch[i][0]][0]
        if within and branch:
            branch = branch[: max((i for i in range(1, len(branch)) if of(i) != of(i - 1)), default=0) + 1]
        length = sum(self.graph.nodes[n][3] for n, _ in branch)
        if own is not None:
            if not self.ignore_gaps and length >= self.gap[own] + SLACK:
                return
            self.gap[own] -= length
        for end in reversed(branch):
            self.used.add(end[0])
            self.insert(at, end)

    def branch(self, node: int, entered: int) -> list[End]:
        """Unused nodes one after the other: to another scaffold if there is a way, else to the nearest contig."""
        out, seen = [], {node}
        while True:
            s, first, last = self.graph.nodes[node][:3]
            free = [x for x in self.graph.out(node, entered) if x[0] not in self.used]
            other = [x for x in free if self.graph.nodes[x[0]][0] != s]
            contig = lambda x: self.graph.nodes[x[0]][1 + x[1]]
            if not free:
                return out
            here, sign = (first, -1) if entered == 1 else (last, 1)
            x = other[0] if other else min(free, key=lambda x: sign * (contig(x) - here))  # noqa: B023
            if x[0] in seen:
                return out
            seen.add(x[0])
            out.append(x)
            node, entered = x

    def paths(self) -> Iterator[list[End]]:
        """Each scaffold from the end of lesser contig: nodes with the end that comes first; nodes on rings aren't reported."""
        nodes, seen = self.graph.nodes, set()
        ends = sorted((nodes[n][1 + e], e, n) for n in nodes for e in (0, 1) if (n, e) not in self.next)
        for _, e, n in ends:
            if n in seen:
                continue
            path = [(n, e)]
            while (x := self.next.get((path[-1][0], 1 - path[-1][1]))) is not None:
                path.append(x)
            seen.update(n for n, _ in path)
            yield path


def runs_of_contigs(contigs: DataFrame, links: DataFrame, merge: bool = True) -> DataFrame:
    """contigs(cid, scaffold, start, end; cid one after the other along a scaffold) with node: the first contig of the run without connections that each lies in; contigs with connections are runs of their own."""
    if not merge:
        return contigs.withColumn("node", F.col("cid"))
    touched = links.select(F.col("a").alias("cid")).unionByName(links.select(F.col("b").alias("cid"))).distinct().withColumn("_touched", F.lit(1))
    w = Window.partitionBy("scaffold").orderBy("cid")
    c = contigs.join(touched, "cid", "left").withColumn("_touched", F.coalesce("_touched", F.lit(0)))
    new = (F.col("_touched") == 1) | (F.coalesce(F.lag("_touched").over(w), F.lit(1)) == 1)
    return c.withColumn("_new", F.when(new, F.col("cid"))).withColumn("node", F.last("_new", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_touched", "_new")


def _graph(contigs: DataFrame, links: DataFrame, write, merge: bool) -> DataFrame:
    """Nodes and links of each component with connections, in one table by root, the least scaffold: kind 0: node, scaffold, first, last, length, gap behind it, scaffold's length; 1: raw link; 2: connection (a, end, b, end, number)."""
    links = write(links, "links")
    placed = write(runs_of_contigs(contigs, links, merge), "placed")
    w = Window.partitionBy("scaffold").orderBy("first")
    n = placed.groupBy("node", "scaffold").agg(F.min("cid").alias("first"), F.max("cid").alias("last"), F.min("start").alias("s"), F.max("end").alias("e"), F.sum(F.col("end") - F.col("start") + 1).alias("length"))
    n = write(n.withColumns({"next": F.lead("node").over(w), "gap": F.coalesce(F.lead("s").over(w) - F.col("e") - 1, F.lit(-1)), "size": F.max("e").over(Window.partitionBy("scaffold")) + 1}), "nodes")
    of = lambda c, out: placed.select(F.col("cid").alias(c), F.col("node").alias(out), F.col("scaffold").alias(f"s{out}"))
    # each connection once, by its first number
    flip = (F.col("a") > F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("ea") > F.col("eb")))
    pick = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x))
    once = links.select(pick("a", "b").alias("a"), pick("ea", "eb").alias("ea"), pick("b", "a").alias("b"), pick("eb", "ea").alias("eb"), "nth").groupBy("a", "ea", "b", "eb").agg(F.min("nth").alias("nth"))
    once = write(once.join(of("a", "u"), "a").join(of("b", "v"), "b").select("su", "sv", "u", F.col("ea").cast("int"), "v", F.col("eb").cast("int"), F.col("nth").cast("long")), "connections")
    raw = n.where("next is not null").select(F.col("scaffold").alias("su"), F.col("node").alias("u"), F.lit(1).alias("ea"), F.col("next").alias("v"), F.lit(0).alias("eb"), F.lit(None).cast("long").alias("nth"))
    # a scaffold's nodes are linked with each other, so components are those of scaffolds, and only scaffolds with connections are labelled
    labels = components(once.select(F.col("su").alias("u"), F.col("sv").alias("v")), write).select(F.col("node").alias("scaffold"), "root")
    long = lambda *cols: [F.col(c).cast("long").alias(f"x{i}") for i, c in enumerate(cols)]
    rows = n.join(labels, "scaffold").select("root", F.lit(0).alias("kind"), *long("node", "scaffold", "first", "last", "length", "gap", "size"))
    ends = raw.unionByName(once.drop("sv")).join(labels.withColumnRenamed("scaffold", "su"), "su").select("root", F.when(F.col("nth").isNull(), 1).otherwise(2).alias("kind"), *long("u", "ea", "v", "eb"), F.coalesce("nth", F.lit(0)).alias("x4"), *(F.lit(0).cast("long").alias(c) for c in ("x5", "x6")))
    return write(rows.unionByName(ends), "graphs")


#: Rows of a group: small components share one, as a call costs more than they do; a larger component is in one with what falls to it.
GROUP = 1 << 12


def _each(rows: DataFrame, run: Callable[[Graph], list[tuple]], schema: str) -> DataFrame:
    """Rows that `run` makes of the graph of each component."""
    columns = [x.split()[0] for x in schema.split(", ")]

    def several(pdf: pd.DataFrame) -> pd.DataFrame:
        parts: dict[int, list[tuple]] = {}
        for root, *row in zip(*(pdf[c].tolist() for c in ("root", "kind", *(f"x{i}" for i in range(7)))), strict=True):
            parts.setdefault(root, []).append(tuple(row))
        made = [row for root in sorted(parts) for row in run(_read(parts.pop(root)))]
        return pd.DataFrame({c: [row[i] for row in made] for i, c in enumerate(columns)})

    groups = max(1, rows.count() // GROUP)
    return rows.groupBy(F.pmod(F.xxhash64("root"), F.lit(groups)).alias("_group")).applyInPandas(several, schema)


def _read(rows: list[tuple]) -> Graph:
    g = Graph({r[1]: r[2:] for r in rows if r[0] == 0})
    for kind, u, ea, v, eb, *_ in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[5], r[1], r[3], r[2], r[4])):
        g.link((u, ea), (v, eb), kind == 1)
    return g


def cyclic_contigs(contigs: DataFrame, links: DataFrame, write, merge: bool = True) -> DataFrame:
    """(cid) of contigs on a cycle of links and connections: a way through opposite ends that comes back. Within a component nodes are tried in order, those of a cycle found before aren't."""

    def run(g: Graph) -> list[tuple]:
        return [(c,) for n in g.cyclic() for c in range(g.nodes[n][1], g.nodes[n][2] + 1)]

    return _each(_graph(contigs, links, write, merge), run, "cid long")


def acyclic_links(contigs: DataFrame, links: DataFrame, write) -> DataFrame:
    """links without those of contigs on a cycle, but for links that follow the raw scaffold."""
    links = write(links, "given")
    c = cyclic_contigs(contigs, links, write).withColumn("_cyclic", F.lit(True))
    at = contigs.select("cid", "scaffold")
    side = lambda df, x: df.join(c.select(F.col("cid").alias(x), F.col("_cyclic").alias(f"_{x}")), x, "left").join(at.select(F.col("cid").alias(x), F.col("scaffold").alias(f"_s{x}")), x)
    both = side(side(links, "a"), "b")
    raw = (F.col("_sa") == F.col("_sb")) & (F.abs(F.col("a") - F.col("b")) == 1) & (F.when(F.col("a") < F.col("b"), (F.col("ea") == 1) & (F.col("eb") == 0)).otherwise((F.col("ea") == 0) & (F.col("eb") == 1)))
    return both.where(raw | (F.col("_a").isNull() & F.col("_b").isNull())).select(*links.columns)


def ordered_contigs(contigs: DataFrame, links: DataFrame, write, ignore_gaps: bool = False, merge: bool = True) -> DataFrame:
    """(scaffold, place, cid, way, gap): new scaffolds, named by the contig that they start with; way '+' or '-'; gap: letters before the contig (0 for the first), as in the raw scaffold between contigs of one, else UNKNOWN_GAP.

    contigs(cid, scaffold, start, end), links(a, ea, b, eb, nth): connections between ends, younger ones (larger nth)
    looked at first. Connections of contigs that aren't there don't count. Contigs on rings aren't reported.
    """

    def run(g: Graph) -> list[tuple]:
        g.without_connections(g.cyclic())
        g.without_connections(g.turned())
        rows = []
        for path in Ordering(g, ignore_gaps).paths():
            n, e = path[0]
            rows += [(g.nodes[n][1 + e], i, *g.nodes[m][1:3], "+" if f == 0 else "-") for i, (m, f) in enumerate(path)]
        return rows

    rows = _graph(contigs, links, write, merge)
    done = write(_each(rows, run, "new long, step long, first long, last long, way string"), "ordered")
    ways = F.when(F.col("way") == "+", F.sequence("first", "last")).otherwise(F.sequence("last", "first", F.lit(-1)))
    moved = done.select("new", "step", "way", F.posexplode(F.when(F.col("first") == F.col("last"), F.array("first")).otherwise(ways)).alias("i", "cid"))
    known = rows.where("kind = 0").select(F.explode(F.sequence("x2", "x3")).alias("cid"))
    still = contigs.join(known, "cid", "left_anti").withColumn("new", F.min("cid").over(Window.partitionBy("scaffold")))
    still = still.select("new", F.lit(0).cast("long").alias("step"), F.lit("+").alias("way"), (F.col("cid") - F.col("new")).cast("int").alias("i"), "cid")
    w = Window.partitionBy("new").orderBy("step", "i")
    r = moved.select("new", "step", "way", "i", "cid").unionByName(still).join(contigs.select("cid", F.col("scaffold").alias("_s"), F.col("start").alias("_b"), F.col("end").alias("_e")), "cid")
    last = lambda c: F.lag(c).over(w)
    gap = F.when(last("cid").isNull(), 0).when(last("_s") != F.col("_s"), UNKNOWN_GAP).when(last("cid") < F.col("cid"), F.col("_b") - last("_e") - 1).otherwise(last("_b") - F.col("_e") - 1)
    return r.select(F.col("new").alias("scaffold"), (F.row_number().over(w) - 1).alias("place"), "cid", "way", gap.cast("long").alias("gap"))


def end_of(strand: Column, first: bool) -> Column:
    """The end by which a chain of parts with strands leaves its first part, or enters its second."""
    return F.when(strand == "+", 1 if first else 0).otherwise(0 if first else 1)
