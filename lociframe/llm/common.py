"""What the corpus operators share: scratch tables on the shared folder, word hashing, id buckets."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import shared_folder

#: Arrow batches are cut by rows and by bytes, so that very long texts don't meet in one batch.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

U = np.uint64
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def small_batches(spark: SparkSession) -> None:
    """Bound what Spark sends to a Python worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written as Parquet in the shared folder: a lost executor loses nothing of them, and they cut the lineage.

    drop() removes a table that is no longer needed; what is left goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._delete, self.root)

    def _delete(self, path: str) -> None:
        try:
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again. The shuffle files of the job go when it ends: nothing reads them any more."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, in a worker that hands large arrays back to the system when they are freed, and the rest when its task ends. Workers outlive tasks, and an executor's share of memory has to hold all of them."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = ctypes.CDLL(None)
        steady = hasattr(libc, "mallopt") and hasattr(libc, "malloc_trim")  # of the GNU library only
        if steady:
            libc.mallopt(-3, 1 << 20)  # arrays from 1 MB on have memory of their own
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if steady:
                libc.malloc_trim(0)

    return tidied


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for words met before; starts anew when it holds too many."""

    LIMIT = 120_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = (h ^ (h >> U(30))) * M2
    h = (h ^ (h >> U(27))) * M3
    return h ^ (h >> U(31))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words; the whole sequence as one if it is shorter; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = hashes[: n - width + 1] + U(width)
    for j in range(1, width):
        out = (out ^ (out >> U(29))) * M1 + hashes[j : n - width + 1 + j]
    return mix(out)


def id_buckets(df: DataFrame, column: str, n: int) -> list:
    """At most n-1 ascending split points of an orderable numeric column, from a column-pruned scan."""
    if n <= 1:
        return []
    return sorted(set(df.select(F.col(column).cast("double")).approxQuantile(column, [i / n for i in range(1, n)], 0.2 / n)))


def bucket_of(column: str, splits: list):
    """Number of split points at or below the value: an ascending range bucket (null: 0)."""
    col = F.col(column)
    return F.coalesce(_bisect(col, splits, 0, len(splits)), F.lit(0))


def _bisect(col, splits: list, lo: int, hi: int):
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(col >= F.lit(splits[mid]), _bisect(col, splits, mid + 1, hi)).otherwise(_bisect(col, splits, lo, mid))


def carried(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns, and all others in one struct `carried`, so that names of ours can't clash with them."""
    others = [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in used]
    return docs.select(*used, F.struct(*others, F.lit(0).alias("none")).alias("carried"))


def restored(df: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of docs again, in their order."""
    return df.select(*(F.col(c) if c in used else F.col("carried")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)))


#: Rows of the table of may_occur, 64 bits each: some 4 MB at most, whatever the input.
WORDS = 1 << 18


def may_occur(df: DataFrame, key: Column, keys: DataFrame, name: str = "_may") -> DataFrame:
    """df with a boolean that is true where key is among the values of keys' only column, and seldom elsewhere.

    The values set bits of a table of bounded size, which is broadcast. So rows that surely have no partner needn't
    be shuffled; the others are joined as ever. Where the values are very many, all rows count as possible.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * WORDS))
    at = place(keys[keys.columns[0]])
    bits = keys.select(F.shiftright(at, 6).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    placed = df.withColumn("_place", place(key)).join(F.broadcast(bits), F.shiftright("_place", 6) == F.col("_word"), "left")
    return placed.withColumn(name, F.coalesce(F.getbit("_bits", F.pmod("_place", F.lit(64)).cast("int")) == 1, F.lit(False))).drop("_place", "_word", "_bits")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch(columns: Iterable, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
