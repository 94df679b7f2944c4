"""Alignments to a padded reference (with gaps, '*' or '-') lifted to the reference without its pads.

A position without pads is the number of letters before it: those before its piece of the reference, from a running sum
over one row a piece, and those within the piece. Records meet the pieces of their own and of their mate's place in
joins on (name, piece number), so no task needs a whole reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from . import realign

PADS = "*-"
WIDTH = 1024


def gap_map(pieces: DataFrame, stride: int) -> DataFrame:
    """pieces(name, piece, seq; piece j starts at j * stride and may reach further) with letters (before the piece) and last (place of the last letter before it, -1: none), places counted with pads."""
    own = F.substring("seq", 1, stride)
    stripped = F.regexp_replace(own, "[*-]+$", "")
    counted = pieces.select("name", "piece", "seq", F.length(F.translate(own, PADS, "")).cast("long").alias("_n"), F.when(F.length(stripped) > 0, F.col("piece") * stride + F.length(stripped) - 1).alias("_last"))
    w = Window.partitionBy("name").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("name", "piece", "seq", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("letters"), F.coalesce(F.max("_last").over(w), F.lit(-1)).alias("last"))


def _at(mapped: DataFrame, prefix: str) -> DataFrame:
    return mapped.select(*(F.col(c).alias(f"{prefix}{c}") for c in ("name", "piece", "seq", "letters", "last")))


def _finer(mapped: DataFrame, stride: int, width: int) -> DataFrame:
    """gap_map's rows cut to pieces of `width` places, which reach as far as theirs: to the end of the reference, if theirs do."""
    end = F.col("piece") * stride + F.length("seq")
    whole = mapped.withColumn("_end", F.max(end).over(Window.partitionBy("name")))
    parts = whole.select("*", F.explode(F.sequence(F.lit(0), F.lit(stride // width - 1))).alias("_i")).withColumn("_at", F.col("_i") * width)
    before = F.expr("substring(seq, 1, _at)")
    stripped = F.length(F.regexp_replace(before, "[*-]+$", ""))
    size = F.when(end >= F.col("_end"), F.length("seq")).otherwise(F.length("seq") - stride + width)
    return parts.select(
        "name", (F.col("piece") * (stride // width) + F.col("_i")).alias("piece"), F.substr("seq", F.col("_at") + 1, size).alias("seq"),
        (F.col("letters") + F.length(F.translate(before, PADS, ""))).alias("letters"), F.when(stripped > 0, F.col("piece") * stride + stripped - 1).otherwise(F.col("last")).alias("last"),
    )


def _joined(df: DataFrame, mapped: DataFrame, name: str, pos: str, stride: int, prefix: str) -> DataFrame:
    at = realign.piece_or_none(F.when(F.col(name).isNotNull(), F.expr(f"`{pos}` div {stride}")), "qname", "pos", "cigar")
    # joined by a name that is never null: rows without one would all meet in one task
    rows = df.withColumns({f"{prefix}j": at, f"{prefix}k": F.coalesce(name, F.lit(""))})
    return rows.join(_at(mapped, prefix).hint("merge"), (F.col(f"{prefix}k") == F.col(f"{prefix}name")) & (F.col(f"{prefix}j") == F.col(f"{prefix}piece")), "left").drop(f"{prefix}j", f"{prefix}k")


def _head(pos: str, stride: int, prefix: str) -> Column:
    """The piece's text before a place."""
    return F.expr(f"substring({prefix}seq, 1, cast(`{pos}` - {prefix}piece * {stride} as int))")


def unpadded_cigar(cigar: str, window: str, pads_before: int) -> str | None:
    """CIGAR of a read without the reference's pads; window: the padded reference under its aligned letters and deletions. None if an operation has no place in a padded alignment."""
    ops, n = [], 0
    for c in cigar:
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            ops.append((n, c))
            n = 0
    shown: list[str] = []
    for n, c in ops:
        if c in "M=X":
            shown += [c] * n
        elif c == "D":
            shown += ["D"] * n
        elif c not in "SH":
            return None
    kinds = [("D" if pad is False else "P") if s == "D" else "I" if pad else "M" for s, pad in zip(shown, (x in PADS for x in window), strict=False)]
    if len(kinds) < len(shown) or not kinds:
        return None
    runs: list[list] = [[pads_before, "P"]] if kinds[0] == "I" and pads_before else []
    first = len(runs)
    for k in kinds:
        if len(runs) > first and runs[-1][1] == k:
            runs[-1][0] += 1
        else:
            runs.append([1, k])
    # pads between matches and deletions say nothing: what stands on either side is one run if it is of one kind
    out: list[list] = []
    for i, (n, k) in enumerate(runs):
        if k == "P" and 0 < i < len(runs) - 1 and runs[i - 1][1] in "MD" and runs[i + 1][1] in "MD":
            continue
        if out and out[-1][1] == k and k in "MD":
            out[-1][0] += n
        else:
            out.append([n, k])
    head = [x for x in ops[:2] if x[1] in "SH"] if ops[0][1] in "SH" else []
    head = head[:1] if len(head) == 2 and head[0][1] == "S" else head
    tail = [x for x in ops[-2:] if x[1] in "SH"] if ops[-1][1] in "SH" and len(ops) > 1 else []
    tail = tail[-1:] if len(tail) == 2 and tail[1][1] == "S" else tail
    return "".join(f"{n}{k}" for n, k in [*head, *out, *tail])


def without_pads(records: DataFrame, pieces: DataFrame, stride: int) -> DataFrame:
    """records(qname, flag, rname, pos, cigar, rnext, pnext, seq, ...) with pos, pnext and cigar without pads.

    A record named like its reference at its start is the reference itself: its CIGAR becomes all matches. Records
    without CIGAR stay as they are but for their mate's place; a CIGAR becomes null where it has introns or pads
    already, or goes beyond the reference; the places are null where the reference is not there. A mate's place without
    a sequence is cleared. pieces(name, piece, seq) have to reach as far beyond the next piece's start as a read is long.
    """
    mapped = gap_map(pieces, stride)
    if stride % WIDTH == 0 and stride > WIDTH:  # what comes before a record within its piece is looked through for each
        mapped, stride = _finer(mapped, stride, WIDTH), WIDTH
    ops = C.ops(F.col("cigar"))
    kinds, names = dict(records.dtypes), records.columns
    r = _joined(_joined(records, mapped, "rname", "pos", stride, "_o_"), mapped, "rnext", "pnext", stride, "_m_")
    own = _head("pos", stride, "_o_")
    stripped = F.length(F.regexp_replace(own, "[*-]+$", ""))
    last = F.when(stripped > 0, F.col("_o_piece") * stride + stripped - 1).otherwise(F.col("_o_last"))
    r = r.withColumns({
        "_pos": F.col("_o_letters") + F.length(F.translate(own, PADS, "")), "_next": F.col("_m_letters") + F.length(F.translate(_head("pnext", stride, "_m_"), PADS, "")),
        "_pads": F.least(F.col("pos") - 1 - last, F.greatest(F.col("pos") - 1, F.lit(0))).cast("long"),
    })
    r = r.withColumn("_span", C.reference_length(ops)).withColumn("_window", F.expr(f"substring(_o_seq, cast(pos - _o_piece * {stride} + 1 as int), cast(_span as int))"))
    itself = F.coalesce((F.col("qname") == F.col("rname")) & (F.col("pos") == 0), F.lit(False))
    r = r.withColumn("_itself", itself).select(*records.columns, "_pos", "_next", "_pads", "_window", "_itself")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for cigar, window, pads, itself, seq in zip(*(b.column(c).to_pylist() for c in ("cigar", "_window", "_pads", "_itself", "seq")), strict=True):
                new.append(None if cigar is None else f"{len(seq)}M" if itself and seq else unpadded_cigar(cigar, window, max(pads or 0, 0)) if window is not None else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*names, "_pos", "_next"]), pa.array(new, pa.string())], names=[*names, "_pos", "_next", "_cigar"])

    done = r.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in records.dtypes), "_pos long, _next long, _cigar string"]))
    changed = {
        "cigar": F.col("_cigar"), "pos": F.when(F.col("cigar").isNull(), F.col("pos")).otherwise(F.col("_pos")).cast(kinds["pos"]),
        "pnext": F.when(F.col("rnext").isNull() | F.col("pnext").isNull(), F.lit(None)).otherwise(F.col("_next")).cast(kinds["pnext"]), "rnext": F.when(F.col("pnext").isNotNull(), F.col("rnext")),
    }
    return done.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in records.columns))


def unpadded_lengths(pieces: DataFrame, stride: int) -> DataFrame:
    """(name, length): letters of each reference without pads."""
    return pieces.groupBy("name").agg(F.sum(F.length(F.translate(F.substring("seq", 1, stride), PADS, ""))).cast("long").alias("length"))
