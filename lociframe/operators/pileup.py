"""Pileup: the read letters over each reference place, from records with CIGAR, sequence and qualities.

Operations are unfolded by one query's arithmetic: an array of (op, length) becomes rows with the places before it on
the reference and on the read, and an aligned run becomes one row a place. Rows are grouped by (reference, place), so
a deep place is a group of its own and nothing is ordered over a whole reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C


def runs(records: DataFrame) -> DataFrame:
    """Rows (record columns, op, len, r0, q0): where each operation begins on the reference and on the read."""
    zero = F.struct(F.col("pos").cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.array().cast("array<struct<op:string,len:bigint,r0:bigint,q0:bigint>>").alias("out"))
    moved = lambda s, x: F.struct(
        (s["r"] + F.when(x["op"].isin(*"MDN=X"), x["len"]).otherwise(0)).alias("r"), (s["q"] + F.when(x["op"].isin(*"MIS=X"), x["len"]).otherwise(0)).alias("q"),
        F.concat(s["out"], F.array(F.struct(x["op"].alias("op"), x["len"].alias("len"), s["r"].alias("r0"), s["q"].alias("q0")))).alias("out"))
    return records.withColumn("_o", F.explode(F.aggregate(C.ops(F.col("cigar")), zero, moved, lambda s: s["out"]))).select("*", "_o.*").drop("_o")


def pileup(records: DataFrame, mask: int = 0x704, skip_gaps: bool = True) -> DataFrame:
    """(rname, place, qname, base, quality, gap) of mapped records without the mask's flags: one row a read and place; deletions have base '*', gaps of introns '>' unless skipped."""
    r = runs(records.where((F.col("flag").bitwiseAND(mask) == 0) & F.col("pos").isNotNull() & F.col("cigar").isNotNull()))
    r = r.where(F.col("op").isin(*("MD=X" if skip_gaps else "MD=XN")) & (F.col("len") > 0))
    e = r.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)))
    at = (F.col("q0") + F.col("i") + 1).cast("int")
    letter = F.when(F.col("op") == "D", "*").when(F.col("op") == "N", ">").otherwise(F.substr("seq", at, F.lit(1)))
    quality = F.when(F.col("op").isin("D", "N") | F.col("qual").isNull(), None).otherwise(F.ascii(F.substr("qual", at, F.lit(1))) - 33)
    return e.select("rname", (F.col("r0") + F.col("i")).alias("place"), "qname", F.when(F.col("flag").bitwiseAND(16) != 0, F.lower(letter)).otherwise(F.upper(letter)).alias("base"), quality.alias("quality"), F.col("op").isin("D", "N").alias("gap"))


def columns(piled: DataFrame, least_quality: int = 13) -> DataFrame:
    """(rname, place, depth, bases) with letters of at least that quality (unknown ones count), in the order of the read names."""
    ok = piled.where(F.col("quality").isNull() | (F.col("quality") >= least_quality))
    g = ok.groupBy("rname", "place").agg(F.count("*").alias("depth"), F.sort_array(F.collect_list(F.struct("qname", "base"))).alias("x"))
    return g.select("rname", "place", "depth", F.array_join(F.transform("x", lambda v: v["base"]), "").alias("bases"))


def consensus(piled: DataFrame, least_share: float = 0.7) -> DataFrame:
    """(rname, place, base, depth): the letter that most reads have, N below the share; ties go to the first in the alphabet."""
    n = piled.where("not gap").groupBy("rname", "place", F.upper("base").alias("base")).agg(F.count("*").alias("n"))
    top = n.groupBy("rname", "place").agg(F.max(F.struct("n", (-F.ascii("base")).alias("a"), "base")).alias("m"), F.sum("n").alias("depth"))
    return top.select("rname", "place", F.when(F.col("m.n") >= least_share * F.col("depth"), F.col("m.base")).otherwise("N").alias("base"), "depth")


def indels(records: DataFrame) -> DataFrame:
    """(rname, place, kind, len, reads): insertions and deletions by the place before them."""
    r = runs(records.where(F.col("pos").isNotNull() & (F.col("flag").bitwiseAND(4) == 0))).where(F.col("op").isin("I", "D"))
    return r.groupBy("rname", (F.col("r0") - 1).alias("place"), F.col("op").alias("kind"), "len").agg(F.count("*").alias("reads"))


def mismatches(records: DataFrame, seqs: DataFrame) -> DataFrame:
    """(qname, flag, pos, nm): letters that differ from the reference (name, seq), with inserted and deleted ones."""
    r = runs(records.where(F.col("pos").isNotNull() & F.col("seq").isNotNull()))
    key = ["qname", "flag", "rname", "pos"]
    other = r.where(F.col("op").isin("I", "D")).groupBy(*key).agg(F.sum("len").alias("gaps"))
    m = r.where(F.col("op").isin(*"M=X") & (F.col("len") > 0)).join(seqs.select(F.col("name").alias("rname"), F.col("seq").alias("ref")), "rname")
    own, ref = F.substr("seq", (F.col("q0") + 1).cast("int"), F.col("len").cast("int")), F.substr("ref", (F.col("r0") + 1).cast("int"), F.col("len").cast("int"))
    pairs = F.zip_with(F.split(F.upper(own), ""), F.split(F.upper(ref), ""), lambda a, b: F.when((a != b) & (a != "N") & (b != "N") & (a != ""), 1).otherwise(0))
    subs = m.select(*key, F.aggregate(pairs, F.lit(0), lambda a, x: a + x).alias("s")).groupBy(*key).agg(F.sum("s").alias("s"))
    return subs.join(other, key, "left").select("qname", "flag", "rname", "pos", (F.col("s") + F.coalesce("gaps", F.lit(0))).alias("nm"))
