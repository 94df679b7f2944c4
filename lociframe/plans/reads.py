"""Read-like views over lineitem, in Spark and as the SQL that every oracle starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Orders rows that share (l_orderkey, l_linenumber).
TIES = ["ln", "pk", "sk", "pos", "end_pos", "price", "shipped"]

RAW_SQL = """raw as (select l_orderkey qname, l_linenumber ln, l_partkey pk, l_suppkey sk, l_suppkey % 10 tid,
    l_partkey*50 + cast(l_quantity as bigint) pos, l_partkey*50 + cast(l_quantity as bigint) + 20 + (l_orderkey % 30) end_pos,
    case when l_partkey % 5 = 0 then 2 else 1 end nh, l_linenumber % 4 nm, cast(round(l_discount*100) as int)*6 mapq,
    case when l_linestatus='F' then 1 else 0 end rev,
    1 + case when l_linestatus='F' then 16 else 0 end + case l_returnflag when 'R' then 64 when 'A' then 128 else 0 end
      + case when l_partkey % 17=0 then 4 else 0 end + case when l_suppkey % 19=0 then 8 else 0 end + case when l_partkey % 31=0 then 256 else 0 end
      + case when l_partkey % 29=0 then 512 else 0 end + case when l_partkey % 23=0 then 1024 else 0 end flag,
    l_extendedprice price, l_shipdate shipped from lineitem)"""
READS_SQL = f"""{RAW_SQL},
reads as (select *, row_number() over w ord, lead(tid) over w mtid, lead(pos) over w mpos, lead(rev) over w mrev
  from raw window w as (partition by qname order by {", ".join(TIES)}))"""
#: Even line numbers are spliced: two segments around a gap.
SEGS_SQL = f"""{READS_SQL},
spans as (select *, (end_pos - pos) // 2 half, case when ln % 2 = 0 then 100 * ln else 0 end gap from reads),
segs as (select qname, ord, tid, mtid, mpos, rev, mrev, nh, nm, flag, 0 i, case when gap > 0 then 2 else 1 end n, pos a, case when gap > 0 then pos + half else end_pos end b from spans
  union all select qname, ord, tid, mtid, mpos, rev, mrev, nh, nm, flag, 1, 2, pos + half + gap + 1, end_pos + gap from spans where gap > 0)"""
ADMITTED = "(flag & 12) = 0 and (flag & 2304) = 0"


def with_sql(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pos = F.col("l_partkey") * 50 + F.col("l_quantity").cast("long")
    bit = lambda when, value: F.when(when, value).otherwise(0)
    return li.select(
        F.col("l_orderkey").alias("qname"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
        (F.col("l_suppkey") % 10).alias("tid"), pos.alias("pos"), (pos + 20 + F.col("l_orderkey") % 30).alias("end_pos"),
        F.when(F.col("l_partkey") % 5 == 0, 2).otherwise(1).alias("nh"), (F.col("l_linenumber") % 4).alias("nm"),
        (F.round(F.col("l_discount") * 100).cast("int") * 6).alias("mapq"), bit(F.col("l_linestatus") == "F", 1).alias("rev"),
        (F.lit(1) + bit(F.col("l_linestatus") == "F", 16) + F.when(F.col("l_returnflag") == "R", 64).when(F.col("l_returnflag") == "A", 128).otherwise(0)
         + bit(F.col("l_partkey") % 17 == 0, 4) + bit(F.col("l_suppkey") % 19 == 0, 8) + bit(F.col("l_partkey") % 31 == 0, 256)
         + bit(F.col("l_partkey") % 29 == 0, 512) + bit(F.col("l_partkey") % 23 == 0, 1024)).alias("flag"),
        F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("shipped"))


#: Folders that hold a table of their reads with their mates.
_MATED: set[str] = set()


def keep_reads(spark: SparkSession, folder: str) -> None:
    """Writes the reads of a folder of ours with their mates beside its lineitem, so that they are put in order once; `reads` reads them from there."""
    reads(spark, folder).drop("pk", "sk", "mapq", "price", "shipped").write.parquet(f"{folder}/reads.parquet")
    _MATED.add(folder)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of one name in order; the next one is the mate."""
    if sf_dir in _MATED:
        return spark.read.parquet(f"{sf_dir}/reads.parquet")
    w = Window.partitionBy("qname").orderBy(*TIES)
    return raw(spark, sf_dir).select("*", F.row_number().over(w).alias("ord"), *(F.lead(c).over(w).alias("m" + c) for c in ("tid", "pos", "rev")))


def tasks(spark: SparkSession, sf_dir: str, rows: int = 1 << 15) -> int:
    """Tasks that reads are dealt to before they unfold to letters: one for so many reads, and no fewer than Spark's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // rows)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).withColumns({"half": F.expr("(end_pos - pos) div 2"), "gap": F.when(F.col("ln") % 2 == 0, 100 * F.col("ln")).otherwise(0)})


def segment_array() -> Column:
    """0-based inclusive segments of a span."""
    seg = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    pos, end, half, gap = F.col("pos"), F.col("end_pos"), F.col("half"), F.col("gap")
    return F.when(gap > 0, F.array(seg(pos, pos + half), seg(pos + half + gap + 1, end + gap))).otherwise(F.array(seg(pos, end)))


def segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark, sf_dir).withColumn("segments", segment_array())
    keep = ["qname", "ord", "tid", "mtid", "mpos", "rev", "mrev", "nh", "nm", "flag"]
    return found.select(*keep, F.size("segments").alias("n"), F.posexplode("segments").alias("i", "s")).select(*keep, "i", "n", F.col("s.a").alias("a"), F.col("s.b").alias("b"))


def admitted() -> Column:
    flag = F.col("flag")
    return (flag.bitwiseAND(12) == 0) & (flag.bitwiseAND(2304) == 0)
