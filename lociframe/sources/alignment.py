"""Alignment text: reader, writer and header, one row a record, in column expressions only.

Coordinates are 0-based in tables and 1-based in files. '*' and 0 stand for nothing in files and are null in tables.
A record without CIGAR counts as unmapped. Tags are kept as a map from their two letters to (type, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as C

FIELDS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of one or more files. Lines with fewer than eleven fields are left out."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("@")) & (F.size(f) >= 11))
    given = lambda c: F.nullif(c, F.lit("*"))
    part = lambda i: F.get("f", F.lit(i))
    tags = F.transform(F.slice("f", 12, 10_000), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.struct(F.substring(t, 4, 1).alias("type"), F.substr(t, F.lit(6)).alias("value")).alias("v")))
    rows = lines.select(f.alias("f"))
    rows = rows.select(
        part(0).alias("qname"), part(1).cast("int").alias("flag"), given(part(2)).alias("rname"), F.nullif(part(3).cast("long") - 1, F.lit(-1)).alias("pos"), part(4).cast("int").alias("mapq"), given(part(5)).alias("cigar"),
        F.when(part(6) == "=", part(2)).otherwise(given(part(6))).alias("rnext"), F.nullif(part(7).cast("long") - 1, F.lit(-1)).alias("pnext"), part(8).cast("long").alias("tlen"), given(part(9)).alias("seq"), given(part(10)).alias("qual"),
        F.map_from_entries(F.transform(tags, lambda t: F.struct(t["key"], t["v"]))).alias("tags"))
    return rows.withColumn("flag", F.when(F.col("cigar").isNull(), F.col("flag").bitwiseOR(4)).otherwise(F.col("flag")))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(type, fields: map) of header lines; comments have their text under ''."""
    h = spark.read.text(path).where(F.startswith("value", F.lit("@")))
    pairs = F.transform(F.slice(F.split("value", "\t"), 2, 1000), lambda x: F.struct(F.substring_index(x, ":", 1), F.substr(x, F.instr(x, ":") + 1)))
    kind = F.substring("value", 2, 2)
    return h.select(kind.alias("type"), F.when(kind == "CO", F.create_map(F.lit(""), F.substr("value", F.lit(5)))).otherwise(F.map_from_entries(pairs)).alias("fields"))


def references(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of the reference sequences that a header names."""
    return read_header(spark, path).where("type = 'SQ'").select(F.col("fields")["SN"].alias("name"), F.col("fields")["LN"].cast("long").alias("length"))


def to_lines(records: DataFrame) -> DataFrame:
    """One text line (value) a record, as read_sam reads it."""
    star, zero = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*")), lambda c: F.coalesce(F.col(c) + 1, F.lit(0)).cast("string")
    tags = F.transform(F.array_sort(F.map_entries(F.coalesce("tags", F.create_map().cast("map<string,struct<type:string,value:string>>")))), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["type"], F.lit(":"), e["value"]["value"]))
    mate = F.when(F.col("rnext") == F.col("rname"), "=").otherwise(star("rnext"))
    fields = F.array(F.col("qname"), F.col("flag").cast("string"), star("rname"), zero("pos"), F.col("mapq").cast("string"), star("cigar"), mate, zero("pnext"), F.coalesce("tlen", F.lit(0)).cast("string"), star("seq"), star("qual"))
    return records.select(F.array_join(F.concat(fields, tags), "\t").alias("value"))


def write_sam(records: DataFrame, path: str) -> None:
    """A folder of text files, a part for each partition; records keep the order that they have in it."""
    to_lines(records).write.text(path)


def to_fastq(records: DataFrame) -> DataFrame:
    """Four-line entries as the sequencer gave them: reverse-strand reads are turned back, mates get /1 and /2."""
    from ..functions.sequence import reverse_complement

    back = F.col("flag").bitwiseAND(16) != 0
    name = F.concat(F.lit("@"), F.col("qname"), F.when(F.col("flag").bitwiseAND(64) != 0, "/1").when(F.col("flag").bitwiseAND(128) != 0, "/2").otherwise(""))
    seq = F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    qual = F.when(back, F.reverse("qual")).otherwise(F.coalesce("qual", F.repeat(F.lit("B"), F.length("seq"))))
    return records.where("seq is not null").select(F.concat_ws("\n", name, seq, F.lit("+"), qual).alias("value"))


def segments(records: DataFrame) -> DataFrame:
    """Aligned segments of mapped records, one row each: a, b 0-based inclusive."""
    r = records.where((F.col("flag").bitwiseAND(4) == 0) & F.col("pos").isNotNull())
    return r.select("*", F.posexplode(C.segments(C.ops(F.col("cigar")), F.col("pos"))).alias("i", "s")).select("*", F.col("s.a").alias("a"), F.col("s.b").alias("b")).drop("s")
