"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage is encoded by statistics of its characters and words
and by hashed word counts, and one tanh layer turns that into h. Gated attention, softmax over the passages of
w . (tanh(V h) * sigmoid(U h)), is learned from document labels alone; the document's score is the logistic
function of c . sum(a h) + b. So one bad passage can decide, and no passage needs a label.

Training takes a bounded sample of labelled documents, in order of a hash of doc_id: SAMPLE of them, or as many
as it takes to reach PASSAGES passages. All passages of each are learned from. Everything else covers all rows.
Encoding and scoring run where rows are read; the driver holds the sample's encoded passages, some 200 bytes
each, and a few thousand weights.

Null and empty texts are one empty passage; a very long one is as many passages as it takes. Null labels or
doc_ids aren't learned from; labels of one doc_id are averaged, and of several texts of one the least is learned
from. Without labels of both kinds, all scores are their mean (without any: 0.5). Repeated rows get
equal scores, which also settles ties: a score at the threshold counts as label 1. An empty table gives an empty
table. Extra columns are kept by `score`, which replaces one that is named like its result. doc_ids are integers
of any width.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, tidy

PASSAGE, HASHED, HIDDEN, ATTENTION = 96, 32, 24, 12
SAMPLE, PASSAGES, STEPS = 5000, 200_000, 160
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """Kinds of bytes: upper and lower case, digits, blanks, line ends, sentence marks, quotes and brackets, bars, exclamation, other marks, beyond ASCII."""
    out = np.zeros((256, 11))
    for b in range(256):
        c = chr(b)
        kind = 10 if b > 127 else 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 4 if c == "\n" else 3 if c.isspace() else 5 if c in ".,;:?" else 6 if c in "\"'()[]{}" else 7 if c in "|<>" else 8 if c == "!" else 9
        out[b, kind] = 1
    return out


CLASSES = _classes()
WIDTH = CLASSES.shape[1] + 9 + HASHED


def encode(text: str | None) -> np.ndarray:
    """One row for each passage."""
    words = (text or "").split()
    rows = []
    for a in range(0, max(1, len(words)), PASSAGE):
        some = words[a : a + PASSAGE]
        raw = " ".join(some).encode()
        kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASSES / max(1, len(raw))
        n = max(1, len(some))
        lengths = np.fromiter(map(len, some), np.float64, len(some)) if some else np.zeros(1)
        counts = Counter(some)
        twice = sum(map(str.__eq__, some, some[1:]))
        last = sum(not w[-1].isalnum() for w in some)
        stats = [lengths.mean() / 10, lengths.std() / 5, lengths.max() / 30, len(counts) / n, max(counts.values(), default=0) / n, twice / n, last / n, sum(w.isupper() and len(w) > 1 for w in some) / n, np.log1p(len(some)) / 5]
        hashed = np.zeros(HASHED)
        for w, c in counts.items():
            hashed[zlib.crc32(w.lower().encode()) % HASHED] += c
        rows.append(np.concatenate([kinds, stats, hashed / n]))
    return np.array(rows, np.float32)


class Model:
    """Weights as arrays; the same forward pass serves training and scoring."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.prior = np.zeros(WIDTH), np.ones(WIDTH), None
        g = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.w = {"E": g(WIDTH, HIDDEN), "e": np.zeros(HIDDEN), "V": g(HIDDEN, ATTENTION), "U": g(HIDDEN, ATTENTION), "a": g(ATTENTION, 1)[:, 0], "c": g(HIDDEN, 1)[:, 0], "b": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        """x: scaled passages, bag after bag, which begin at `starts`."""
        w = self.w
        h = np.tanh(x @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        s = (v * u) @ w["a"]
        sizes = np.diff(np.append(starts, len(x)))
        bag = np.repeat(np.arange(len(starts)), sizes)
        ex = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        att = ex / np.add.reduceat(ex, starts)[bag]
        z = np.add.reduceat(att[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"][0], -30, 30)))
        return {"h": h, "v": v, "u": u, "att": att, "bag": bag, "z": z, "p": p}

    def gradients(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over bags, for each weight."""
        w, f = self.w, self.forward(x, starts)
        h, v, u, att, bag = f["h"], f["v"], f["u"], f["att"], f["bag"]
        out = (f["p"] - labels) / len(labels)
        dz = out[:, None] * w["c"]
        dh = att[:, None] * dz[bag]
        along = (h * dz[bag]).sum(1)
        ds = att * (along - np.add.reduceat(att * along, starts)[bag])
        dvu = ds[:, None] * w["a"]
        dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
        dh += dv @ w["V"].T + du @ w["U"].T
        dpre = dh * (1 - h * h)
        return {"E": x.T @ dpre, "e": dpre.sum(0), "V": h.T @ dv, "U": h.T @ du, "a": (v * u).T @ ds, "c": f["z"].T @ out, "b": np.array([out.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, rate: float = 0.02, decay: float = 1e-4) -> Model:
        if not len(labels) or labels.min() == labels.max():
            self.prior = float(labels.mean()) if len(labels) else 0.5
            return self
        x = np.concatenate(bags).astype(np.float64)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
        w = self.w
        m, q = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
        for i in range(1, steps + 1):
            grads = self.gradients(x, starts, labels)
            for k, g in grads.items():  # Adam
                g = g + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                q[k] = 0.999 * q[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(q[k] / (1 - 0.999**i)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.prior is not None or not bags:
            return np.full(len(bags), self.prior or 0.0)
        x = (np.concatenate(bags) - self.mean) / self.scale
        return self.forward(x, np.cumsum([0, *(len(b) for b in bags[:-1])]))["p"]


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows that may be learned from; the others are held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) != 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, passages: int = PASSAGES) -> Model:
    """docs(doc_id, text), labels(doc_id, label). The sample's ids, at most `sample` rows, are broadcast, so no text is shuffled."""
    known = labels.withColumn("doc_id", F.col("doc_id").cast("long")).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learnable()).groupBy("doc_id").agg(F.avg(label).alias("_label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [encode(text) for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_label"), pa.array(map(len, bags), pa.int64()), pa.array([x.tobytes() for x in bags], pa.binary())], names=["doc_id", "label", "n", "bag"])

    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    # at most `sample` rows, so the window over all of them stays small
    before = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")) - F.col("n")
    bags = texts.mapInArrow(tidy(run), "doc_id long, label double, n long, bag binary").withColumn("before", before).where(F.col("before") < passages)
    rows = sorted(bags.select("doc_id", "label", "bag").collect(), key=lambda r: r.doc_id)
    return Model().fit([np.frombuffer(r.bag, np.float32).reshape(-1, WIDTH) for r in rows], np.array([r.label for r in rows]))


def scoring(model: Model, text: str, out: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, scores = b.column(text).to_pylist(), []
            for a in range(0, len(texts), 200):
                scores += model.score([encode(t) for t in texts[a : a + 200]]).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, out])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each whole text."""
    docs = docs.drop(out)
    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(scoring(model, text, out)), ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{out}` double"]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, as labels.quality marks it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
