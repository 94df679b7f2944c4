"""Queries over the contig graph: parts are contigs, eight of them a scaffold; suppliers connect the two parts that they sell most of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ordering as O
from ..operators.storage import writer


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") - 1).cast("long").alias("cid"), (F.col("p_size") * 10 + 200).cast("long").alias("n"))
    start = (F.col("cid") % 8) * 1000
    return p.select("cid", F.floor(F.col("cid") / 8).cast("long").alias("scaffold"), start.alias("start"), (start + F.col("n")).alias("end"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a supplier's lines move once, and are summed and put in order where they are
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_quantity").repartition("l_suppkey")
    sold = lines.groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("q"), "l_partkey")
    two = sold.withColumn("r", F.row_number().over(w)).where("r <= 2")  # by itself, so that no other rows go through a window
    top = two.withColumns({"b": F.lead("l_partkey").over(w), "qb": F.lead("q").over(w)}).where("r = 1 and b is not null")
    return top.select((F.col("l_partkey") - 1).cast("long").alias("a"), (F.col("q") % 2).cast("int").alias("ea"), (F.col("b") - 1).cast("long").alias("b"), (F.col("qb") % 2).cast("int").alias("eb"), F.col("l_suppkey").cast("long").alias("nth"))


def cyclic_contigs(spark, sf_dir):
    """Contigs on cycles of the graph of scaffolds and connections."""
    return O.cyclic_contigs(contigs(spark, sf_dir), links(spark, sf_dir), writer(spark))


def acyclic_links(spark, sf_dir):
    """Connections that stay when those of contigs on cycles go."""
    return O.acyclic_links(contigs(spark, sf_dir), links(spark, sf_dir), writer(spark))


def ordered_contigs(spark, sf_dir):
    """All contigs in new scaffolds, with their way and the gap before each."""
    return O.ordered_contigs(contigs(spark, sf_dir), links(spark, sf_dir), writer(spark))


QUERIES = {"cyclic_contigs": (cyclic_contigs, None), "acyclic_links": (acyclic_links, None), "ordered_contigs": (ordered_contigs, None)}
