"""A training corpus from documents: quality, near copies, repeated passages, secrets, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, and all but the
last return the columns of documents. run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import ngramjoin, packing, quality, secrets, substrings
from lociframe.llm.common import Scratch, carried, restored


def _used(docs: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]


def _counted(df: DataFrame, changed: Column) -> DataFrame:
    """n_chars, where there is one, follows a changed text."""
    return df.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in df.columns else df


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labelled rows of these documents.

    Null and empty texts are scored as texts without words. Equal texts, repeated rows too, share one fate; a score
    equal to the threshold stays. Rows without doc_id aren't learned from. An empty table, or one without labels,
    stays as it is. Other columns, whatever their names, are carried along.
    """
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(carried(docs, "doc_id", "text"), model)
    return restored(scored.where(F.col("score") >= quality.THRESHOLD), docs, "doc_id", "text")


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document stays, that of least id; see ngramjoin.one_of_each for nulls, ties and repeated rows."""
    return ngramjoin.one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller id has are cut out; texts without any stay as they are.

    Null texts stay null, empty ones empty; a text may lose all its words and becomes empty then. Rows of one doc_id
    don't cut each other, and rows without doc_id neither cut nor are cut. An empty table stays empty. Other columns,
    whatever their names, are carried along.
    """
    used = _used(docs)
    cut = substrings.without_repeats(carried(docs, *used).withColumnRenamed("carried", "others"))
    changed = F.col("n_removed") > 0
    cut = _counted(cut.withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text"))), changed)
    return restored(cut.withColumnRenamed("others", "carried"), docs, *used)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; the documents stay, null and empty texts as they are, repeated rows alike. Other columns are carried along."""
    used = _used(docs)
    clean = secrets.redact(carried(docs, *used).withColumn("before", F.col("text")))
    return restored(_counted(clean, ~F.col("text").eqNullSafe(F.col("before"))), docs, *used)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 4096 ids. Null and empty texts are the end id alone; repeated rows are packed as often as they occur. Other columns don't matter."""
    return packing.packed_documents(docs.select("doc_id", "text"))


STAGES = [("quality classifier", quality_stage), ("n-gram Jaccard join", near_copy_stage), ("substring dedup", substring_stage), ("secret scans", secret_stage), ("best-fit packing", packing_stage)]

#: SQL can't express the classifier or the search for a packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
