"""Document fingerprints by consistent weighted sampling.

Terms are runs of five words (all words, if fewer) of the lower-cased text; a term's weight is how often
it occurs. For each of `samples` and each term of weight S, three draws that depend on the term alone,
r and c from Gamma(2, 1) and b uniform, give t = floor(ln S / r + b), ln y = r (t - b) and
ln a = ln c - ln y - r. The term of least a, with its t, is the sample. Two texts share a sample with a
probability equal to their generalised Jaccard similarity, sum of least over sum of greatest weights.

Only texts meet in a task that follow each other: documents are dealt by ranges of doc_id, and the first
of the next range comes along. Null texts count as empty. Texts without words have the one fingerprint of
zeros, are alike to one another (1) and to no other (0). Rows without doc_id come first; repeated doc_ids are
ordered by text. The last document is followed by the first, an only one by itself. Of equal terms of least a any
gives the same sample. Texts of any length are taken whole; an empty table gives no rows. Extra columns aren't used,
but `fingerprints` keeps them and replaces one that is named like its result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import M1, U, WordHashes, bucket_of, id_buckets, mix, partitions, shingles, small_batches, tidy

WORDS, SAMPLES = 5, 64
#: Terms whose draws are made together, so that the arrays stay in a core's cache.
TERMS = 1 << 14


def _gamma2(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of n equal steps: solves 1 - (1 + x) exp(-x) = u by Newton's rule in ln(1 - u)."""
    want = np.log1p(-(np.arange(n) + 0.5) / n)
    x = np.sqrt(-2 * want) - want
    for _ in range(60):
        x = np.maximum(x + (np.log1p(x) - x - want) * (1 + x) / x, 1e-12)
    return x


class Sampler:
    def __init__(self, samples: int = SAMPLES, words: int = WORDS):
        self.samples, self.words = samples, words
        self.gamma = _gamma2()
        self.log_gamma = np.log(self.gamma)
        self.seeds = mix(np.arange(1, samples + 1, dtype=np.uint64) * M1)
        self.hashes = WordHashes()

    def terms(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        found = shingles(self.hashes.of(text.encode().lower().split()), self.words) if text else np.zeros(0, U)
        return np.unique(found, return_counts=True)

    def signatures(self, texts: list[str | None]) -> np.ndarray:
        """A row of 16-bit samples for each text; 0 stands for no terms and for nothing else."""
        out = np.zeros((len(texts), self.samples), np.uint16)
        some: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0
        for i, t in enumerate(texts):
            terms, counts = self.terms(t)
            if len(terms):
                some.append((i, terms, counts))
                size += len(terms)
            if some and (size >= TERMS or i == len(texts) - 1):
                out[[x[0] for x in some]] = self._least(np.concatenate([x[1] for x in some]), np.concatenate([x[2] for x in some]), np.cumsum([0, *(len(x[1]) for x in some[:-1])]))
                some, size = [], 0
        if some:
            out[[x[0] for x in some]] = self._least(np.concatenate([x[1] for x in some]), np.concatenate([x[2] for x in some]), np.cumsum([0, *(len(x[1]) for x in some[:-1])]))
        return out

    def _least(self, terms: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        many = np.nonzero(counts > 1)[0]
        logs = np.log(counts[many])
        out = np.empty((len(starts), self.samples), np.uint16)
        low = U(0xFFFF)
        for k, seed in enumerate(self.seeds):
            z = mix(terms ^ seed)
            r = self.gamma[z & low]
            c = self.log_gamma[(z >> U(16)) & low]
            b = (z >> U(32)).astype(np.float64) * 2.0**-32
            if len(many):
                b[many] -= np.floor(logs / r[many] + b[many])  # now b - t
            b -= 1
            b *= r
            b += c
            least = mix(np.minimum.reduceat(b, starts).view(np.uint64)) & low
            out[:, k] = np.maximum(least, 1)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples."""
    return float(np.mean(a == b))


def written(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (part, extra, key, text) in tasks by ranges of the key; in each, an extra row is the one that follows its last, around the end too.

    The bounds come from a scan of the keys alone; what each range needs of the next is one row, so the text moves once.
    """
    spark = docs.sparkSession
    splits = id_buckets(docs, key, partitions(spark))
    n = len(splits) + 1
    docs = docs.select(bucket_of(key, splits).alias("part"), key, text)
    around = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # over one row a range
    firsts = docs.groupBy("part").agg(F.min(F.struct(F.col(key).isNotNull().alias("some"), F.col(key).alias("key"))).alias("_f"))  # null keys come first
    firsts = firsts.select(F.coalesce(F.lag("part").over(Window.orderBy("part")), F.last("part").over(around)).alias("_to"), F.col("_f.key").alias("_first"))
    both = docs.join(F.broadcast(firsts), docs[key].eqNullSafe(firsts["_first"]), "left")
    both = both.select(F.explode(F.when(F.col("_to").isNull(), F.array(F.struct("part", F.lit(False).alias("extra")))).otherwise(F.array(F.struct("part", F.lit(False).alias("extra")), F.struct(F.col("_to").alias("part"), F.lit(True).alias("extra"))))).alias("_at"), key, text)
    return both.select("_at.part", "_at.extra", key, text).repartitionById(n, F.col("part")).sortWithinPartitions("part", "extra", F.col(key).asc_nulls_first(), text)


def fingerprints(docs: DataFrame, text: str = "text", samples: int = SAMPLES, out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each whole text; rows stay where they are read."""
    docs = docs.drop(out)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sampler(samples)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(written, s.signatures(b.column(text).to_pylist())), pa.string())], names=[*b.schema.names, out])

    return docs.mapInArrow(tidy(run), ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{out}` string"]))


def compare_with_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each document(doc_id, text) and of an edited text, half its own and half the next one's, and their likeness."""
    small_batches(docs.sparkSession)
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def pairs(s: Sampler, docs: list[tuple[int | None, str]], own: np.ndarray) -> pa.RecordBatch:
        """Rows for all but the last of docs, which is the next one's."""
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for (_, t), (_, u) in zip(docs, docs[1:], strict=False)]
        new = s.signatures(edited)
        rows = [(doc, len(t), hashlib.sha256(e.encode()).hexdigest(), written(a), written(b), likeness(a, b), likeness(a, c)) for (doc, t), e, a, b, c in zip(docs, edited, own, new, own[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def alone(s: Sampler, held: list, sig: np.ndarray) -> pa.RecordBatch:
        """A last row that nothing leads on from is followed by itself."""
        return pairs(s, held * 2, np.concatenate([sig, sig]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sampler(samples)
        held: list[tuple[int | None, str]] = []  # the last document so far, whose next one is still to come
        sig = np.zeros((0, samples), np.uint16)
        part, done = None, False
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("part", "extra", "doc_id", "text")), strict=True))
            for a in range(0, len(rows), 256):
                for p in dict.fromkeys(r[0] for r in rows[a : a + 256]):
                    if p != part:
                        if held and not done:
                            yield alone(s, held, sig)
                        held, sig, part, done = [], sig[:0], p, False
                    new = []
                    for _, extra, doc, text in (r for r in rows[a : a + 256] if r[0] == p):
                        if not done:
                            new.append((doc, text or ""))
                            done = extra  # of extra rows only the first counts
                    if not new:
                        continue
                    sig = np.concatenate([sig, s.signatures([t for _, t in new])])
                    held += new
                    if len(held) > 1:
                        yield pairs(s, held, sig)
                        held, sig = held[-1:], sig[-1:]
        if held and not done:
            yield alone(s, held, sig)

    return with_next(docs).mapInArrow(tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, its edited text and the next document."""
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
