"""Byte-level BPE encoding and decoding by ranks; the merges of a piece go through a segment tree.

A text is cut into pieces by the vocabulary's pattern. Over the byte positions of a piece stands a
segment tree; a leaf holds the rank of the pair that starts there (none: infinite), an inner node the
least rank below it and, of equal ranks, the leftmost position. The root names the next merge. A merge
changes the pair at its place and the one before it, so it costs two updates of log n nodes, and a piece
of n bytes takes O(n log n) time, however long it is.

Short pieces met before come from a dictionary of bounded size. Null texts count as empty and have no
ids. Unknown byte sequences can't occur: each single byte has a rank. Extra columns are kept.
"""

from __future__ import annotations

import base64
import hashlib
from collections import ChainMap, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, tidy

NONE = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeTree:
    """Leftmost minimum of pair ranks under point updates. A key is rank * size + position, so that the least key is the leftmost of the least rank."""

    def __init__(self, ranks: list[int]):
        self.size = size = 1 << max(0, len(ranks) - 1).bit_length()
        self.tree = tree = [NONE * size] * size + [r * size + i for i, r in enumerate(ranks)] + [NONE * size] * (size - len(ranks))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

    def least(self) -> tuple[int, int]:
        return divmod(self.tree[1], self.size)

    def put(self, at: int, rank: int) -> None:
        tree, i = self.tree, at + self.size
        tree[i] = rank * self.size + at
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                break
            tree[i] = least
            i >>= 1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = lambda i, j: ranks.get(parts[i] + parts[j], NONE)
    tree = MergeTree([*(rank(i, i + 1) for i in range(n - 1)), NONE])
    while True:
        least, i = tree.least()
        if least >= NONE:
            break
        j = after[i]
        parts[i], parts[j] = parts[i] + parts[j], None
        k = after[i] = after[j]
        tree.put(j, NONE)
        if k < n:
            before[k] = i
            tree.put(i, rank(i, k))
        else:
            tree.put(i, NONE)
        if before[i] >= 0:
            tree.put(before[i], rank(before[i], i))
    return [ranks[p] for p in parts if p is not None]


class PairTable:
    """Rank of the union of two adjacent tokens, for arrays of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {(a << 20 | b): i for token, i in ranks.items() for cut in range(1, len(token)) if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None}
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k] for k in self.keys.tolist()] + [NONE], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        at[at >= len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge_many(pieces: list[bytes], first: np.ndarray, pairs: PairTable) -> list[np.ndarray]:
    """Ids of many short pieces at once: a segment tree for each, one merge in every piece at each step.

    first: rank of each single byte. Column p of the arrays belongs to piece p; all pieces get trees of one size.
    """
    n = len(pieces)
    lengths = np.array([len(p) for p in pieces])
    size = 1 << int(max(1, lengths.max() - 1)).bit_length()
    bits, cols = size.bit_length() - 1, np.arange(n)
    rows = np.arange(size)[:, None]
    ids = np.zeros((size + 1, n), np.int64)
    ids[:size] = first[np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size).T]
    after, before = np.repeat(np.arange(1, size + 1)[:, None], n, 1), np.repeat(np.arange(-1, size)[:, None], n, 1)
    rank = np.full((size, n), NONE)
    real = rows < lengths - 1
    real_at = np.nonzero(real)
    rank[real_at] = pairs.of(ids[:size][real_at], ids[1:][real_at])
    tree = np.empty((2 * size, n), np.int64)
    tree[size:] = rank << bits | rows
    for at in range(size - 1, 0, -1):
        np.minimum(tree[2 * at], tree[2 * at + 1], out=tree[at])
    alive = ids[:size] >= 0
    alive &= rows < lengths

    def put(at: np.ndarray, col: np.ndarray, new: np.ndarray) -> None:
        tree[at + size, col] = new << bits | at
        at = (at + size) >> 1
        for _ in range(bits):
            tree[at, col] = np.minimum(tree[2 * at, col], tree[2 * at + 1, col])
            at = at >> 1

    while len(cols := cols[tree[1, cols] < NONE << bits]):
        least = tree[1, cols]
        i = least & (size - 1)
        j = after[i, cols]
        k = after[j, cols]
        ids[i, cols] = least >> bits
        alive[j, cols] = False
        after[i, cols] = k
        before[k, cols] = i
        put(j, cols, np.full(len(cols), NONE))
        inner = k < lengths[cols]
        put(i, cols, np.where(inner, pairs.of(ids[i, cols], ids[k, cols]), NONE))
        p = before[i, cols]
        some = p >= 0
        put(p[some], cols[some], pairs.of(ids[p[some], cols[some]], ids[i[some], cols[some]]))
    flat, counts = ids[:size].T[alive.T], alive.sum(0)
    return np.split(flat, np.cumsum(counts)[:-1])


class Codec:
    """Encodes to little-endian uint32 bytes and back. STEP: characters whose new pieces are merged together."""

    KEPT, LONGEST, STEP, TOGETHER = 400_000, 64, 1 << 19, 4096

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pairs = PairTable(self.ranks)
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.cut = regex.compile(pattern)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.kept: dict[str, bytes] = {}

    def _meet(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces not met before: whole tokens, short pieces by size many at once, long ones each by its own tree."""
        out, by_size = {}, defaultdict(list)
        for piece in pieces:
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(raw) > self.LONGEST:
                out[piece] = np.array(merge(raw, self.ranks), "<u4").tobytes()
            else:
                by_size[(len(raw) - 1).bit_length()].append((piece, raw))
        for some in by_size.values():
            for a in range(0, len(some), self.TOGETHER):
                part = some[a : a + self.TOGETHER]
                for (piece, _), ids in zip(part, merge_many([raw for _, raw in part], self.first, self.pairs), strict=True):
                    out[piece] = ids.astype("<u4").tobytes()
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        run, size = [], 0
        for i, t in enumerate(texts):
            run.append(self.cut.findall(t) if t else [])
            size += len(t or "")
            if size < self.STEP and i < len(texts) - 1:
                continue
            kept = self.kept
            found = set().union(*run)
            missing = found - kept.keys()
            if missing:
                if len(kept) + len(missing) > self.KEPT:
                    kept = {}
                    missing = found
                met = self._meet(list(missing))
                short = {p: v for p, v in met.items() if len(p) <= self.LONGEST}
                kept.update(short)
                self.kept = kept
                if len(short) < len(met):
                    kept = ChainMap(met, kept)
            out += [b"".join(map(kept.__getitem__, pieces)) for pieces in run]
            run, size = [], 0
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


Batches = Iterator[pa.RecordBatch]


def encoding(path: str, pattern: str, text: str = "text", out: str = "ids") -> Callable[[Batches], Batches]:
    """Adds a column of ids to Arrow batches."""

    def run(batches: Batches) -> Batches:
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c.encode_all(b.column(text).to_pylist()), pa.binary())], names=[*b.schema.names, out])

    return run


def decoding(path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> Callable[[Batches], Batches]:
    """Adds a column of the bytes that the ids stand for."""

    def run(batches: Batches) -> Batches:
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.decode(x or b"") for x in b.column(ids).to_pylist()], pa.binary())], names=[*b.schema.names, out])

    return run


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with a binary column of ids (little-endian uint32). Rows stay where they are read."""
    docs = docs.drop(out)
    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(encoding(path, pattern, text, out)), ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{out}` binary"]))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with a binary column of the bytes that the ids stand for (null: empty)."""
    docs = docs.drop(out)
    return docs.mapInArrow(tidy(decoding(path, pattern, ids, out)), ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{out}` binary"]))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded again."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    small_batches(spark)
    there, back = encoding(path, pattern), decoding(path, pattern)

    def digest(batches: Batches) -> Batches:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in back(there(batches)):  # in one worker
            ids, text = b.column("ids").to_pylist(), b.column("decoded").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(map(sha, text), pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(tidy(digest), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
