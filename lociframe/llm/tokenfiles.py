"""Token-id files of patched frame-of-reference blocks, in ascending document order.

Layout of a token folder
  blocks/  Parquet, one row a block: file, block, first (position in the file of its first id), count,
           payload, and of each document that overlaps the block its id, start in the file and length.
           Blocks of a file stand in order, so Parquet's statistics over (file, first) index block starts.
  files/   one row a file: first_token (ids of all files before), tokens.
A payload is independent of all others:
  header   little-endian: base u32, count u32, exceptions u32, width u8
  packed   (id - base) mod 2**width, `width` bits each, groups of 32 ids in `width` 32-bit words
  patches  positions u32 and high parts (id - base) >> width, u32, of the ids that need more bits
The width is that of a percentile of (id - base), so a few large ids don't widen a block.

Documents are dealt to files by ranges of doc_id whose bounds come from the ids alone, and each file is
sorted, so no task sees more than its range. Null texts count as empty. Repeated doc_ids stand one after
the other, by text. An empty table gives no blocks. Extra columns aren't written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordbpe
from .common import Scratch, bucket_of, id_buckets, partitions, small_batches, tidy

BLOCK, PERCENTILE = 16384, 95
HEADER = struct.Struct("<IIIB")


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of at least one id (uint32)."""
    base = int(ids.min())
    rest = ids.astype(np.uint64) - np.uint64(base)
    width = max(1, int(np.percentile(rest, percentile, method="higher")).bit_length())
    odd = np.nonzero(rest >> np.uint64(width))[0]
    low = np.zeros(-(-len(ids) // 32) * 32, np.uint64)
    low[: len(ids)] = rest & np.uint64((1 << width) - 1)
    low = low.reshape(-1, 32)
    words = np.zeros((len(low), width + 1), np.uint64)
    for j in range(32):
        at, shift = divmod(j * width, 32)
        v = low[:, j] << np.uint64(shift)
        words[:, at] |= v & np.uint64(0xFFFFFFFF)
        words[:, at + 1] |= v >> np.uint64(32)
    return b"".join((HEADER.pack(base, len(ids), len(odd), width), words[:, :width].astype("<u4").tobytes(), odd.astype("<u4").tobytes(), (rest[odd] >> np.uint64(width)).astype("<u4").tobytes()))


def unpack(payload: bytes) -> np.ndarray:
    base, count, odd, width = HEADER.unpack_from(payload)
    groups = -(-count // 32)
    words = np.zeros((groups, width + 1), np.uint64)
    words[:, :width] = np.frombuffer(payload, "<u4", groups * width, HEADER.size).reshape(groups, width)
    low = np.empty((groups, 32), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(32):
        at, shift = divmod(j * width, 32)
        low[:, j] = ((words[:, at] | words[:, at + 1] << np.uint64(32)) >> np.uint64(shift)) & mask
    low = low.reshape(-1)[:count]
    at = HEADER.size + 4 * groups * width
    where = np.frombuffer(payload, "<u4", odd, at)
    low[where] |= np.frombuffer(payload, "<u4", odd, at + 4 * odd).astype(np.uint64) << np.uint64(width)
    return (low + np.uint64(base)).astype(np.uint32)


BLOCKS = "file int, block int, first long, count int, payload binary, doc_ids array<long>, doc_starts array<long>, doc_lengths array<long>"
_ARROW = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("count", pa.int32()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64()))])


class _FileWriter:
    """Cuts the ids of one file's documents, in order, into blocks."""

    def __init__(self, file: int):
        self.file, self.block, self.first = file, 0, 0
        self.waiting: list[np.ndarray] = []
        self.size, self.at = 0, 0
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc, self.at, len(ids)))
        self.at += len(ids)
        self.waiting.append(ids)
        self.size += len(ids)
        if self.size >= BLOCK:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // BLOCK * BLOCK
            for a in range(0, whole, BLOCK):
                yield self._row(ids[a : a + BLOCK])
            self.waiting, self.size = [ids[whole:]], len(ids) - whole

    def end(self) -> Iterator[tuple]:
        if self.size:
            yield self._row(np.concatenate(self.waiting))

    def _row(self, ids: np.ndarray) -> tuple:
        end = self.first + len(ids)
        docs = [d for d in self.docs if d[1] < end]
        row = (self.file, self.block, self.first, len(ids), pack(ids), *([d[i] for d in docs] for i in range(3)))
        self.docs = [d for d in self.docs if d[1] + d[2] > end]
        self.block, self.first = self.block + 1, end
        return row


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2) -> None:
    """Writes the ids of documents(doc_id, text), each followed by end_id, to a folder of any file system that Spark reaches."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    splits = id_buckets(docs, "doc_id", n)
    n = len(splits) + 1
    end = np.uint32(end_id).astype("<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = wordbpe.tokenizer(vocabulary)
        for b in batches:
            ids = [x + end for x in t.encode_all(b.column("text").to_pylist())]
            # two bytes an id on the way to its file, where all of a document's fit
            wide = [bool(len(x) and np.frombuffer(x, "<u4").max() >= 1 << 16) for x in ids]
            short = [x if w else np.frombuffer(x, "<u4").astype("<u2").tobytes() for x, w in zip(ids, wide, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("doc_id"), pa.array(wide), pa.array(short, pa.binary())], names=["file", "doc_id", "wide", "ids"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, writer = [], None
        for b in batches:
            for file, doc, wide, ids in zip(*(b.column(c).to_pylist() for c in ("file", "doc_id", "wide", "ids")), strict=True):
                if writer is None or writer.file != file:
                    out += [] if writer is None else writer.end()
                    writer = _FileWriter(file)
                out += writer.add(doc, np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4"))
                if len(out) >= 64:
                    yield _rows(out)
                    out = []
        out += [] if writer is None else writer.end()
        if out:
            yield _rows(out)

    ids = docs.select(bucket_of("doc_id", splits).alias("file"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(encode), "file int, doc_id long, wide boolean, ids binary")
    ids.repartitionById(n, F.col("file")).sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "ids").mapInArrow(tidy(blocks), BLOCKS).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    files = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").groupBy("file").agg(F.sum("count").alias("tokens"))
    # one row a file, so the window over all of them stays small
    files = files.withColumn("first_token", F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)))
    files.select("file", F.coalesce("first_token", F.lit(0)).alias("first_token"), "tokens").coalesce(1).write.parquet(f"{folder}/files")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks"), spark.read.schema("file int, first_token long, tokens long").parquet(f"{folder}/files")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of documents as the blocks hold them: doc_id, start (of the document), length (of the document), at (of the piece in it), ids (binary, u32)."""

    blocks, files = _tables(spark, folder)
    found = blocks.mapInArrow(tidy(pieces), "file int, doc_id long, start long, length long, at long, ids binary")
    return _numbered(found, files).select("doc_id", "start", "length", "at", "ids")


def _numbered(found: DataFrame, files: DataFrame) -> DataFrame:
    """Starts in a file become starts over all files; the broadcast has one row a file."""
    return found.join(F.broadcast(files), "file").withColumn("start", F.col("first_token") + F.col("start"))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document in each block."""
    for b in batches:
        out = []
        for file, first, count, payload, docs, starts, lengths in zip(*(b.column(c).to_pylist() for c in ("file", "first", "count", "payload", "doc_ids", "doc_starts", "doc_lengths")), strict=True):
            ids = unpack(payload)
            for doc, start, length in zip(docs, starts, lengths, strict=True):
                a, z = max(start, first), min(start + length, first + count)
                out.append((file, doc, start, length, a - start, ids[a - first : z - first].astype("<u4").tobytes()))
            if len(out) > 4000:
                yield _pieces(out)
                out = []
        if out:
            yield _pieces(out)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), *(pa.int64(),) * 4, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["file", "doc_id", "start", "length", "at", "ids"])


def read_range(spark: SparkSession, folder: str, start: int, count: int) -> np.ndarray:
    """The ids from a position over all files; only the blocks that hold them are read."""
    blocks, files = _tables(spark, folder)
    at = F.col("first_token") + F.col("first")
    rows = blocks.select("file", "first", "count", "payload").join(F.broadcast(files), "file").where((at < start + count) & (at + F.col("count") > start)).select(at.alias("at"), "payload").orderBy("at").collect()
    ids = np.concatenate([unpack(bytes(r.payload)) for r in rows]) if rows else np.zeros(0, np.uint32)
    return ids[start - rows[0]["at"] :][:count] if rows else ids


def _times(m: list[int], v: int) -> int:
    s = 0
    for row in m:
        if not v:
            break
        if v & 1:
            s ^= row
        v >>= 1
    return s


def _steps() -> list[list[int]]:
    """What carries a CRC register over 1, 2, 4, ... zero bytes: the one-bit step, squared again and again."""
    step = [0xEDB88320, *(1 << i for i in range(31))]
    out = []
    for i in range(3 + 64):
        if i >= 3:
            out.append(step)
        step = [_times(step, r) for r in step]
    return out


STEPS = _steps()


def crc32_joined(a: int, b: int, length: int) -> int:
    """crc32 of x + y from crc32(x), crc32(y) and the bytes of y: a's register is carried over as many zero bytes."""
    for i, step in enumerate(STEPS):
        if length >> i & 1:
            a = _times(step, a)
    return a ^ b


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of documents to files, reads these back, and digests each document's ids."""
    import public_tokenizers

    folder = Scratch(spark, "tokens").root
    write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):  # in one worker
            ids = b.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("file", "doc_id", "start", "length", "at")), pa.array(map(len, ids), pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64())], names=["file", "doc_id", "start", "length", "at", "size", "crc"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column("parts").to_pylist():
                crc = parts[0]["crc"]
                for p in parts[1:]:
                    crc = crc32_joined(crc, p["crc"], p["size"])
                out.append(crc)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks, files = _tables(spark, folder)
    parts = _numbered(blocks.mapInArrow(tidy(sums), "file int, doc_id long, start long, length long, at long, size long, crc long"), files)
    # a document has a part for each block that it touches
    whole = parts.groupBy("doc_id", "start", F.col("length").alias("n_tokens")).agg(F.sort_array(F.collect_list(F.struct("at", "size", "crc"))).alias("parts"))
    return whole.mapInArrow(tidy(joined), "doc_id long, start long, n_tokens long, ids_crc32 long")
