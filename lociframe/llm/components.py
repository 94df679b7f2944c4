"""Connected components of an edge table: alternating large-star and small-star steps, each written to the shared folder.

Tasks first contract their own edges to stars. A node's least neighbour is found by a partial aggregate, so a hub
with very many links isn't gathered anywhere; the join that hands it on is one that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges that a task contracts at once.
STEP = 500_000


class Forest:
    """Union-find over any hashable nodes; the least node is the root."""

    def __init__(self):
        self.above: dict = {}

    def root(self, x):
        above = self.above
        top = x
        while (up := above.get(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above.get(x, x)
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.above[b] = a
        self.above.setdefault(a, a)
        return True

    def stars(self) -> list[tuple]:
        return [(x, r) for x in list(self.above) if (r := self.root(x)) != x]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a task as stars (a, b), b the least node that a's edges lead to."""

    def out(f: Forest) -> pa.RecordBatch:
        rows = np.array(f.stars(), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["a", "b"])

    f, n = Forest(), 0
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if x != y:
                f.join(x, y)
        n += b.num_rows
        if n >= STEP:
            yield out(f)
            f, n = Forest(), 0
    if n:
        yield out(f)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of all nodes that have a link; component is the least node. edges: two long columns."""
    a, b = edges.columns
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = scratch.table(pairs.mapInArrow(contract, "a long, b long").distinct(), f"{name}-0")
    seen = None
    for i in count(1):  # the number of edges off their star falls in each round
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.table(large, f"{name}-{i}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        e = scratch.table(small, f"{name}-{i}")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        scratch.drop(f"{name}-{i}-large")
        scratch.drop(f"{name}-{i - 1}")
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
