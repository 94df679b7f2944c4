"""Target stretches of a sequence: the best path of a two-state model, found without any task that sees a sequence.

A sequence is cut into buckets of positions. What a bucket does to the best scores of the two states (off, on target)
is a 2 x 2 matrix under (max, +); a scan over these matrices, one row a bucket, gives each bucket the scores that it
starts with. With them a bucket knows its best paths, one for each state that it may end in, and the state before it
that each comes from; a scan from the end picks the one that holds. Sites are read twice, each time in buckets, and all
buckets of a batch go through the model together, one position a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calling as K

#: Scores of an uncovered, a doubtful and a clear position on target (off target all count nothing), and what entering a target costs.
UNCOVERED, DOUBTFUL, CLEAR, ENTER = -4, 1, 6, 14_000
WIDTH, PART, TOGETHER = 4096, 1024, 256
LOW = -(1 << 60)


def consensus(letters: DataFrame) -> DataFrame:
    """(tid, place, letter, quality, kind) of letters(tid, place, base, rev, q, mapq): the letter that explains a site best, by how much (at most 63), and its kind: 2 clear, 1 doubtful. Sites without letters of enough quality are left out."""
    known = letters.where(K.code(F.col("base")) < 4)
    one = K.site_samples(known.select(*(c for c in ("tid", "bucket", "place") if c in known.columns), F.lit("N").alias("ref"), F.lit(0).alias("sample"), "base", "rev", "q", F.least("mapq", F.lit(K.HIGH)).alias("mapq"), F.lit(0).alias("tail")), capped=K.HIGH)
    p = K.with_likelihoods(one.select("tid", "place", "cells"))
    ranked = F.sort_array(F.array(*(F.struct(F.floor(F.get("p", F.lit(6 * i)) + 0.499).alias("v"), F.lit(i).alias("i")) for i in range(4))))
    best = F.get("r", F.lit(0))
    r = p.withColumn("r", ranked).select("tid", "place", best["i"].alias("i"), F.least(F.get("r", F.lit(1))["v"] - best["v"], F.lit(63)).cast("int").alias("quality"))
    return r.select("tid", "place", F.substr(F.lit(K.LETTERS), F.col("i") + 1, F.lit(1)).alias("letter"), "quality", F.when((F.col("quality") == 0) & (F.col("i") == 0), 1).otherwise(2).alias("kind"))


def _step(f: np.ndarray, gain: np.ndarray, enter: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores after a position and, for either state, whether its best predecessor is on target (equal ones: it is)."""
    off, on = f
    from_on = np.stack([off <= on, off - enter <= on])
    return np.stack([np.maximum(off, on), np.maximum(off - enter, on) + gain]), from_on[0], from_on[1]


def _dense(batch: pa.RecordBatch, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gains of each (bucket, position), and the buckets' lengths."""
    n = batch.column("length").to_numpy(zero_copy_only=False)
    kinds = np.zeros((batch.num_rows, WIDTH), np.int8)
    sites = batch.column("sites")
    if pa.types.is_binary(sites.type.value_type.field(1).type):  # parts of a bucket, a byte a place
        flat = sites.flatten()
        rows = np.repeat(np.arange(batch.num_rows), sites.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        parts = [np.frombuffer(x, np.int8) for x in flat.field("kind").to_pylist()]
        if parts:
            kinds.reshape(batch.num_rows, -1, len(parts[0]))[rows, flat.field("at").to_numpy(zero_copy_only=False)] = np.stack(parts)
        return scores[kinds], n
    rows = np.repeat(np.arange(batch.num_rows), sites.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = sites.flatten()
    kinds[rows, flat.field("at").to_numpy(zero_copy_only=False)] = flat.field("kind").to_numpy(zero_copy_only=False)
    return scores[kinds], n


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, TOGETHER):
            yield b.slice(a, TOGETHER)


def buckets(sites: DataFrame, lengths: DataFrame) -> DataFrame:
    """(tid, bucket, length, sites) for all buckets of lengths(tid, length), those without sites too; sites is an array of (at, kind), of WIDTH at most: of sites, or of their parts with a kind for each place of these (PART places)."""
    if "kinds" in sites.columns:
        at, kind, many, none = F.col("part"), F.col("kinds"), WIDTH // PART, "array<struct<at: int, kind: binary>>"
    else:
        at, kind, many, none = F.col("place"), F.col("kind").cast("int"), WIDTH, "array<struct<at: int, kind: int>>"
    rows = sites.groupBy("tid", F.floor(at / many).alias("bucket")).agg(F.collect_list(F.struct((at % many).cast("int").alias("at"), kind.alias("kind"))).alias("sites"))
    every = lengths.where("length > 0").select("tid", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {WIDTH}"))).alias("bucket"), F.col("length").alias("_all"))
    every = every.select("tid", "bucket", F.least(F.col("_all") - F.col("bucket") * WIDTH, F.lit(WIDTH)).cast("int").alias("length"))
    return every.join(rows, ["tid", "bucket"], "left").withColumn("sites", F.coalesce("sites", F.array().cast(none)))


def targets(sites: DataFrame, lengths: DataFrame, enter: int = ENTER, uncovered: int = UNCOVERED, doubtful: int = DOUBTFUL, clear: int = CLEAR) -> DataFrame:
    """(tid, start, end) of the stretches on target, half-open, from sites(tid, place, kind), or packed ones as sitecounts.consensus has them, and lengths(tid, length).

    Of equally good paths the one that is on target later holds. The first position of a sequence is never on target.
    Sites beyond their sequence's length, or of sequences without length, don't count.
    """
    scores = np.array([uncovered, doubtful, clear], np.int64)
    # places beyond a length within its last bucket aren't looked at
    inside = buckets(sites.where("part >= 0") if "kinds" in sites.columns else sites.join(lengths, "tid").where("place >= 0 and place < length").select("tid", "place", "kind"), lengths)
    key = dict(lengths.dtypes)["tid"]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            gains, n = _dense(b, scores)
            f = [np.repeat([[0], [LOW]], b.num_rows, 1), np.repeat([[LOW], [0]], b.num_rows, 1)]
            for i in range(WIDTH):
                for s in (0, 1):
                    f[s] = np.where(i < n, _step(f[s], gains[:, i], enter)[0], f[s])
            yield pa.RecordBatch.from_arrays([b.column("tid"), b.column("bucket"), *(pa.array(f[s][t]) for s in (0, 1) for t in (0, 1))], names=["tid", "bucket", "m00", "m01", "m10", "m11"])

    def forward(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        off, on, out = 0, 0, []
        for m00, m01, m10, m11 in rows[["m00", "m01", "m10", "m11"]].itertuples(index=False):
            out.append((off, on))
            off, on = max(off + m00, on + m10), max(off + m01, on + m11)
        return rows[["tid", "bucket"]].assign(off=[x for x, _ in out], on=[y for _, y in out], last=[False] * (len(out) - 1) + [True])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            gains, n = _dense(b, scores)
            f = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("off", "on")])
            back = np.zeros((WIDTH, 2, b.num_rows), bool)
            back[:, 1] = True  # beyond the end a state comes from itself
            for i in range(WIDTH):
                new, from_off, from_on = _step(f, gains[:, i], enter)
                f = np.where(i < n, new, f)
                back[i, 0], back[i, 1] = from_off & (i < n), from_on | (i >= n)
            columns: list[list] = []
            for end in (False, True):
                state = np.full(b.num_rows, end)
                on = np.zeros((WIDTH + 2, b.num_rows), np.int8)
                for i in range(WIDTH - 1, -1, -1):
                    on[i + 1] = state & (i < n)
                    state = np.where(state, back[i, 1], back[i, 0])
                cols, edges = np.nonzero(np.diff(on, axis=0).T)
                pairs = list(zip(cols[::2].tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True))
                found: list[list] = [[] for _ in range(b.num_rows)]
                for c, lo, hi in pairs:
                    found[c].append({"lo": lo, "hi": hi})
                columns += [state, found]
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("tid"), b.column("bucket"), b.column("last"), pa.array(f[0]), pa.array(f[1]), *(pa.array(columns[i], pa.bool_() if i % 2 == 0 else kind) for i in range(4))],
                names=["tid", "bucket", "last", "off", "on", "before_off", "spans_off", "before_on", "spans_on"],
            )

    def backward(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket", ascending=False)
        state, out = None, []
        for off, on, before_off, before_on in rows[["off", "on", "before_off", "before_on"]].itertuples(index=False):
            if state is None:
                state = not off > on
            out.append(state)
            state = before_on if state else before_off
        return rows[["tid", "bucket"]].assign(ends_on=out)

    m = inside.mapInArrow(matrices, f"tid {key}, bucket long, m00 long, m01 long, m10 long, m11 long")
    starts = m.groupBy("tid").applyInPandas(forward, f"tid {key}, bucket long, off long, on long, last boolean")
    span = "array<struct<lo: int, hi: int>>"
    p = inside.join(starts, ["tid", "bucket"]).mapInArrow(paths, f"tid {key}, bucket long, last boolean, off long, on long, before_off boolean, spans_off {span}, before_on boolean, spans_on {span}")
    ends = p.select("tid", "bucket", "off", "on", "before_off", "before_on").groupBy("tid").applyInPandas(backward, f"tid {key}, bucket long, ends_on boolean")
    spans = p.join(ends, ["tid", "bucket"]).select("tid", "bucket", F.explode(F.when(F.col("ends_on"), F.col("spans_on")).otherwise(F.col("spans_off"))).alias("s"))
    at = F.col("bucket") * WIDTH
    return _joined(spans.select("tid", "bucket", (F.when((at == 0) & (F.col("s.lo") == 0), 1).otherwise(at + F.col("s.lo"))).alias("lo"), (at + F.col("s.hi")).alias("hi")).where("lo < hi"))


def _joined(spans: DataFrame) -> DataFrame:
    """Spans that go on over the border of a bucket, made one: only those that touch a border need an order along their sequence."""
    touches = (F.col("lo") % WIDTH == 0) | (F.col("hi") % WIDTH == 0)
    alone = spans.where(~touches).select("tid", F.col("lo").alias("start"), F.col("hi").alias("end"))

    def runs(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lo")
        new = (rows["lo"] != rows["hi"].shift()).cumsum()
        return rows.groupby(new).agg(tid=("tid", "first"), start=("lo", "first"), end=("hi", "last"))

    key = dict(spans.dtypes)["tid"]
    return alone.unionByName(spans.where(touches).select("tid", "lo", "hi").groupBy("tid").applyInPandas(runs, f"tid {key}, start long, end long"))
