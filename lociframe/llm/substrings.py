"""Substring dedup by prefix-partitioned suffix trees, cut at the depth of a window.

Each word position starts a suffix. Suffixes are dealt to groups by a prefix of variable length: one word
where few suffixes begin with it, as many more as it takes for a group to fit in memory where many do. So
each group is a subtree of the corpus' suffix tree that one task can hold. Only nodes at the depth of the
window matter: a suffix is known by a 64-bit hash of its first `window` words, the leaves of a subtree are
sorted by it, and leaves that share it hang below one deep internal node, a repeat. Adjacent repeats join
into maximal ones. In a node, all leaves but those of the least doc_id are marked.

A third of all documents may be copies of one passage: each task first sorts the suffixes of its own
documents, marks what repeats there at once, and hands on a node's leaves of its least doc_id only. So a
node gets no more from a task than from one document, however many copies there are.

Hashes meet only within a group, which has the prefix in common; two different windows of one group are
taken for one with a chance of 2**-64.

Words are runs without ASCII white space; null texts have none. A window is within one document; texts of
fewer words keep all. Repeated doc_ids don't mark each other; rows without doc_id neither mark nor are
marked. An empty table gives an empty table. Extra columns are kept, but for those named like the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import M1, U, Scratch, WordHashes, carried, may_occur, mix, partitions, restored, shingles, small_batches, tidy

WINDOW = 13
#: Suffixes in a group, and suffixes whose repeats a task looks for by itself; about 40 bytes each while sorted.
GROUP, OWN = 1_200_000, 300_000
#: Prefix lengths that are counted in one pass over the texts.
AT_ONCE = 4


def _longer(prefix: np.ndarray, hashes: np.ndarray, depth: int) -> np.ndarray:
    """Hashes of prefixes of depth + 1 words; at a text's end prefixes stop growing."""
    out = prefix.copy()
    n = len(hashes) - depth
    if n > 0:
        out[:n] = mix((prefix[:n] ^ U(depth)) * M1 + hashes[depth:])
    return out


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


class _Texts:
    """Word hashes of documents, gathered up to a number of windows."""

    def __init__(self, window: int):
        self.window, self.words = window, WordHashes()
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple, text: str | None) -> None:
        h = self.words.of(text.encode().split()) if text else np.zeros(0, U)
        if len(h) >= self.window:
            self.rows.append((*row, h))
            self.size += len(h)

    def clear(self) -> None:
        self.rows, self.size = [], 0


def heavy_prefixes(docs: DataFrame, text: str, window: int, limit: int, total: int) -> list[np.ndarray]:
    """For each depth from 1 on, the hashes of prefixes that begin more than about `limit` suffixes and have to grow.

    A task names a prefix if its share of the task's suffixes is a quarter of limit / total or more, so a count may fall
    short by a quarter of the limit; this bears on the size of groups only. At most total / limit prefixes a depth come
    to the driver.
    """
    heavy: list[np.ndarray] = []
    share = limit / max(total, 1) / 4
    while len(heavy) < window - 1:
        known, base = list(heavy), len(heavy)

        def count(batches: Iterator[pa.RecordBatch], known=known, base=base) -> Iterator[pa.RecordBatch]:
            texts = _Texts(window)

            def counted() -> pa.RecordBatch:
                cols: list[list] = [[], [], []]
                levels: list[list[np.ndarray]] = [[] for _ in range(AT_ONCE)]
                for (h,) in texts.rows:
                    live, prefix = None, mix(h)
                    n = len(h) - window + 1
                    for d in range(1, base + AT_ONCE + 1):
                        if d > base and d < window:
                            levels[d - base - 1].append(prefix[:n] if live is None else prefix[:n][live])
                        elif d <= base:
                            more = _among(prefix[:n], known[d - 1])
                            live = more if live is None else live & more
                        if d < base + AT_ONCE:
                            prefix = _longer(prefix, h, d)
                for d, some in enumerate(levels):
                    if some:
                        values, counts = np.unique(np.concatenate(some), return_counts=True)
                        many = counts >= max(2, share * texts.size)
                        cols[0] += [base + d + 1] * int(many.sum())
                        cols[1] += values[many].astype(np.int64).tolist()
                        cols[2] += counts[many].tolist()
                texts.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["depth", "prefix", "n"])

            for b in batches:
                for t in b.column(0).to_pylist():
                    texts.add((), t)
                    if texts.size >= OWN:
                        yield counted()
            if texts.rows:
                yield counted()

        found = docs.select(text).mapInArrow(tidy(count), "depth int, prefix long, n long").groupBy("depth", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("depth", "prefix").collect()
        for d in range(base + 1, min(base + AT_ONCE, window - 1) + 1):
            heavy.append(np.sort(np.array([r.prefix for r in found if r.depth == d], np.int64).astype(np.uint64)))
            if not len(heavy[-1]):
                return heavy[:-1]
    return heavy


def _least(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaves in order, and which of them have a doc_id above their node's least."""
    order = np.lexsort((docs, hashes))
    h, d = hashes[order], docs[order]
    first = np.empty(len(h), bool)
    first[:1] = True
    np.not_equal(h[1:], h[:-1], out=first[1:])
    return order, d > d[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]


def _short(values: np.ndarray) -> bytes:
    """Two bytes a value where they do."""
    return values.astype("<u2" if not len(values) or values.max() < 1 << 16 else "<u4").tobytes()


def _long(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")


def _documents(ids: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The least id and what others are above it (four bytes each, where they do); keys; counts."""
    above = ids - ids.min()
    return ids.min().tobytes() + above.astype("<u4" if above.max() < 1 << 32 else "<i8").tobytes(), keys.astype("<u4").tobytes(), _short(counts)


def _documents_of(ids: bytes, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.frombuffer(keys, "<u4").astype(np.int64)
    n = len(keys)
    ids = np.frombuffer(ids, "<i8", 1)[0] + np.frombuffer(ids, "<u4" if len(ids) == 8 + 4 * n else "<i8", n, 8).astype(np.int64)
    return ids, keys, _long(counts, n)


_LEAVES = pa.schema([("part", pa.int32()), ("docs", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary()), ("hashes", pa.binary())])


def _deal(texts: _Texts, heavy: list[np.ndarray], parts: int, window: int) -> Iterator[tuple]:
    """Rows of leaves for the groups' parts; and rows without hashes, of leaves that are marked already."""
    sizes = np.array([len(h) - window + 1 for *_, h in texts.rows])
    row = np.repeat(np.arange(len(sizes)), sizes)
    ids, keys = np.array([r[0] for r in texts.rows], np.int64), np.array([r[1] for r in texts.rows], np.int64)
    position = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes, group = np.empty(len(row), U), np.empty(len(row), U)
    at = 0
    for *_, h in texts.rows:
        n = len(h) - window + 1
        hashes[at : at + n] = shingles(h, window)
        prefix = mix(h)
        chosen = prefix[:n].copy()
        live = np.ones(n, bool)
        for d, known in enumerate(heavy, 1):
            live &= _among(prefix[:n], known)
            if not live.any():
                break
            prefix = _longer(prefix, h, d)
            chosen[live] = prefix[:n][live]
        group[at : at + n] = chosen
        at += n
    order, marked = _least(hashes, ids[row])
    own = np.zeros(len(row), bool)
    own[order[marked]] = True
    part = (mix(group ^ M1) % U(parts)).astype(np.int64)
    part[own] = keys[row[own]] % parts  # marked leaves only pass through
    for mask, with_hashes in ((~own, True), (own, False)):
        leaves = np.nonzero(mask)[0]
        if not len(leaves):
            continue
        leaves = leaves[np.argsort(part[leaves], kind="stable")]
        cuts = np.nonzero(np.diff(part[leaves], prepend=-1))[0]
        for a, b in zip(cuts, [*cuts[1:], len(leaves)], strict=True):
            some = leaves[a:b]
            rows, counts = np.unique(row[some], return_counts=True)
            pos = position[some]
            yield int(part[some[0]]), *_documents(ids[rows], keys[rows], counts), _short(pos), hashes[some].tobytes() if with_hashes else None


def repeats(docs: DataFrame, key: str = "__repeats_key", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Marked window starts of documents(doc_id, key, text): doc_id, key, starts (binary, u32), one row a document. Keys (32 bits) tell texts of one doc_id apart."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.where(F.col("doc_id").isNotNull())
    words = docs.agg(F.sum(F.length(text)).alias("n")).first()["n"] or 0
    total = max(1, words // 6)  # a word and a blank take about six characters; this only sets sizes
    parts = max(partitions(spark), -(-total // GROUP))
    heavy = heavy_prefixes(docs, text, window, max(1000, total // parts // 2), total)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts(window)

        def rows() -> Iterator[pa.RecordBatch]:
            out, size = [], 0
            for r in _deal(texts, heavy, parts, window):
                out.append(r)
                size += len(r[4])
                if size > 1 << 21:
                    yield _batch(out, _LEAVES)
                    out, size = [], 0
            if out:
                yield _batch(out, _LEAVES)
            texts.clear()

        for b in batches:
            for doc, k, t in zip(b.column("doc_id").to_pylist(), b.column(key).to_pylist(), b.column(text).to_pylist(), strict=True):
                texts.add((doc, k), t)
                if texts.size >= OWN:
                    yield from rows()
        if texts.rows:
            yield from rows()

    buckets = partitions(spark)

    def subtree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, positions, hashes = [], [], [], []
        for b in batches:
            for docs, k, counts, pos, h in zip(*(b.column(c).to_pylist() for c in _LEAVES.names[1:]), strict=True):
                docs, k, counts = _documents_of(docs, k, counts)
                docs, k, pos = np.repeat(docs, counts), np.repeat(k, counts), _long(pos, int(counts.sum()))
                if h is None:
                    yield from _to_buckets(docs, k, pos, buckets)
                else:
                    ids.append(docs)
                    keys.append(k.astype("<u4"))
                    positions.append(pos)
                    hashes.append(np.frombuffer(h, U))
        if ids:
            h, docs = np.concatenate(hashes), np.concatenate(ids)
            hashes, ids = [], []
            order, marked = _least(h, docs)
            order = order[marked]
            yield from _to_buckets(docs[order], np.concatenate(keys)[order].astype(np.int64), np.concatenate(positions)[order], buckets)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each document, from all subtrees."""
        parts = [[], [], []]
        for b in batches:
            for docs, k, counts, pos in zip(*(b.column(c).to_pylist() for c in _STARTS_IN.names[1:]), strict=True):
                docs, k, counts = _documents_of(docs, k, counts)
                for x, y in zip(parts, (np.repeat(docs, counts), np.repeat(k, counts).astype("<u4"), _long(pos, int(counts.sum()))), strict=True):
                    x.append(y)
        if parts[0]:
            yield from _starts(*map(np.concatenate, parts))

    leaves = docs.select("doc_id", key, text).mapInArrow(tidy(deal), "part int, docs binary, keys binary, counts binary, positions binary, hashes binary")
    marked = leaves.repartitionById(parts, F.col("part")).mapInArrow(tidy(subtree), "bucket int, docs binary, keys binary, counts binary, positions binary")
    return marked.repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(gather), "doc_id long, key long, starts binary")


_STARTS_IN = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary())])


def _to_buckets(docs: np.ndarray, keys: np.ndarray, positions: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Marked starts on their way to the bucket of their document, one row a bucket."""
    if not len(docs):
        return
    bucket = (mix(docs.astype(U)) % U(buckets)).astype(np.int64)
    order = np.lexsort((positions, keys, docs, bucket))
    docs, keys, positions, bucket = docs[order], keys[order], positions[order], bucket[order]
    cuts = np.nonzero(np.diff(bucket, prepend=-1))[0]
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        new = np.nonzero((np.diff(docs[a:b], prepend=docs[a] - 1) != 0) | (np.diff(keys[a:b], prepend=keys[a]) != 0))[0]
        rows.append((int(bucket[a]), *_documents(docs[a:b][new], keys[a:b][new], np.diff(np.append(new, b - a))), _short(positions[a:b])))
    if rows:
        yield _batch(rows, _STARTS_IN)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_STARTS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("starts", pa.binary())])


def _starts(docs: np.ndarray, keys: np.ndarray, positions: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each document."""
    order = np.lexsort((positions, keys, docs))
    docs, keys, positions = docs[order], keys[order].astype(np.int64), positions[order]
    cuts = np.nonzero((np.diff(docs, prepend=docs[:1] - 1) != 0) | (np.diff(keys, prepend=keys[:1]) != 0))[0]
    ends = [*cuts[1:], len(docs)]
    for a in range(0, len(cuts), 5000):
        some = [(int(docs[i]), int(keys[i]), positions[i:j].astype("<u4").tobytes()) for i, j in zip(cuts[a : a + 5000], ends[a : a + 5000], strict=True)]
        yield _batch(some, _STARTS)


def without_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed and kept (what is left, joined by one space) beside the text."""
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_removed", "kept")
    used = tuple(dict.fromkeys(("doc_id", text)))
    keyed = carried(docs, *used).withColumn("text_key", F.xxhash64(text).bitwiseAND(0xFFFFFFFF))
    found = Scratch(spark, "repeats").table(repeats(keyed, "text_key", text, window), "starts")
    found = found.select(F.col("doc_id").alias("found_id"), F.col("key").alias("found_key"), "starts")
    # only documents that may have repeats are shuffled
    keyed = may_occur(keyed, F.xxhash64(F.col("doc_id").cast("long"), F.col("text_key")), found.select(F.xxhash64("found_id", "found_key").alias("key")))
    some = keyed.where("_may")
    some = some.join(found, (some["doc_id"] == found["found_id"]) & (some["text_key"] == found["found_key"]), "left").select(*used, "carried", "starts")
    both = some.unionByName(keyed.where("not _may").select(*used, "carried", F.lit(None).cast("binary").alias("starts")))
    schema = StructType([*both.schema.fields[:-1], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_kept(t, s, window) for t, s in zip(b.column(text).to_pylist(), b.column("starts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=schema.names)

    new = ("n_words", "n_removed", "kept")
    return restored(both.mapInArrow(tidy(cut), schema), docs.withColumns(dict.fromkeys(new, F.lit(0))), *used, *new)


def _kept(text: str | None, starts: bytes | None, window: int) -> tuple[int, int, str]:
    words = text.encode().split() if text else []
    n = len(words)
    if not starts:
        return n, 0, b" ".join(words).decode()
    edges = np.zeros(n + 1, np.int64)
    at = np.unique(np.frombuffer(starts, "<u4")).astype(np.int64)
    edges[at] += 1
    edges[at + window] -= 1
    keep = np.cumsum(edges)[:n] == 0
    return n, int(n - keep.sum()), b" ".join([words[i] for i in np.nonzero(keep)[0].tolist()]).decode()


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, without repeats of 13 words of documents with smaller ids."""
    docs = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    return docs.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same rows by plain windows.
ORACLE = """
with words as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
starts as (select doc_id, unnest(range(1, len(w) - 11)) p, w from words where len(w) >= 13),
windows as (select doc_id, p, array_to_string(w[p:p + 12], ' ') s from starts),
firsts as (select s, min(doc_id) d from windows group by s),
marked as (select doc_id, p from windows join firsts using (s) where doc_id > d),
gone as (select distinct doc_id, unnest(range(p, p + 13)) i from marked),
each as (select doc_id, unnest(range(1, len(w) + 1)) i, unnest(w) x from words),
left_ as (select e.doc_id, count(*) n, string_agg(x, ' ' order by e.i) t from each e anti join gone g on e.doc_id = g.doc_id and e.i = g.i group by e.doc_id)
select w.doc_id, cast(len(w.w) as bigint) n_words, cast(len(w.w) - coalesce(l.n, 0) as bigint) n_removed, sha256(coalesce(l.t, '')) kept_sha256
from words w left join left_ l using (doc_id)
"""
