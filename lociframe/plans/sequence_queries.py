"""Sequence queries over texts mapped onto A, C, G, T, N."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as Q

#: Letters onto nucleotides; blanks and line ends become N, so sentences have gaps.
FROM, TO = "etaoinshrdlcumwfgypbvk \n", "ACGTACGTACGTACGTACGTACNN"
K = 11


def docs_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.regexp_replace(F.translate(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), FROM, TO), "[^ACGTN]", "").alias("seq"))


DNA_SQL = f"""dna as (select doc_id, regexp_replace(translate(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{FROM[:-1]}' || chr(10), '{TO}'), '[^ACGTN]', '', 'g') seq from documents)"""


def reverse_complement(spark, sf_dir):
    return docs_dna(spark, sf_dir).select("doc_id", F.length("seq").alias("n"), F.md5(Q.reverse_complement(F.col("seq"))).alias("md5"))


REVERSE_COMPLEMENT = f"with {DNA_SQL} select doc_id, length(seq)::int n, md5(translate(reverse(seq), 'ACGT', 'TGCA')) md5 from dna"


def sequence_md5(spark, sf_dir):
    """Checksum of each stored sequence."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(Q.stored(F.col("text"))).alias("md5"))


SEQUENCE_MD5 = "select doc_id, md5(regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g')) md5 from documents"


def contig_runs(spark, sf_dir):
    """Runs of known letters between gaps of three or more N: the pieces that a sequence is cut into, with their place."""
    d = docs_dna(spark, sf_dir)
    gap = "N{3,}"
    lengths = lambda texts: F.transform(texts, F.length)
    pairs = F.arrays_zip(lengths(F.split("seq", gap)).alias("n"), lengths(F.regexp_extract_all("seq", F.lit(f"({gap})"), 1)).alias("g"))
    # lengths only are unfolded, each with the gap behind it, so rows stay small and places are sums within a text's rows
    d = d.select("doc_id", F.posexplode(pairs).alias("i", "x"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("x")["n"] + F.coalesce(F.col("x")["g"], F.lit(0))).over(w), F.lit(0))
    return d.withColumn("start", start).where("x.n > 0").select("doc_id", "start", F.col("x")["n"].alias("n"))


CONTIG_RUNS = f"""with {DNA_SQL}, p as (select doc_id, string_split_regex(seq, 'N{{3,}}') p, regexp_extract_all(seq, 'N{{3,}}') g from dna),
e as (select doc_id, unnest(range(1, len(p) + 1)) i, unnest(p) piece, g from p),
s as (select *, coalesce(sum(length(piece) + coalesce(length(g[i]), 0)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint "start" from e)
select doc_id, "start", length(piece)::int n from s where piece <> ''"""


def _known(spark, sf_dir) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select(F.regexp_replace(F.translate(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), FROM, TO), "[^ACGTN]", "").alias("seq"))


def _counted(rows: DataFrame) -> DataFrame:
    """(kmer, n) of canonical k-mers in rows' seq, summed up within batches of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Q.kmer_codes(seq, K)[1] for seq in b.column("seq").to_pylist() if seq]
            kmers, n = np.unique(np.concatenate(found or [np.empty(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kmers, pa.int64()), pa.array(n, pa.int64())], names=["kmer", "n"])

    return rows.select("seq").mapInArrow(run, "kmer long, n long")


KMERS_SQL = f"""{DNA_SQL}, km as (select doc_id, i, least(k, translate(reverse(k), 'ACGT', 'TGCA')) kmer from (select doc_id, i - 1 i, substr(seq, i, {K}) k from (select doc_id, seq, unnest(range(1, length(seq) - {K - 2})) i from dna)) where not contains(k, 'N'))"""


def canonical_kmers(spark, sf_dir):
    """Canonical k-mers of the corpus by how often they occur: how many distinct ones occur so often."""
    return _counted(docs_dna(spark, sf_dir)).groupBy("kmer").agg(F.sum("n").alias("times")).groupBy("times").agg(F.count("*").alias("kmers"))


CANONICAL_KMERS = f"with {KMERS_SQL}, c as (select kmer, count(*) times from km group by kmer) select times, count(*) kmers from c group by times"


def kmer_coverage(spark, sf_dir):
    """Letters of a sequence that k-mers cover which also occur in a benchmark text, overlaps counted once."""
    known = _counted(_known(spark, sf_dir)).select("kmer").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for doc, seq in zip(b.column("doc_id").to_pylist(), b.column("seq").to_pylist(), strict=True):
                at, kmers = Q.kmer_codes(seq or "", K)
                for column, x in zip(out, ([doc] * len(at), at, kmers), strict=True):
                    column.append(np.asarray(x, object if column is out[0] else np.int64))
                if sum(map(len, out[1])) >= 1 << 16:
                    yield _rows(out)
                    out = [[], [], []]
            if out[0]:
                yield _rows(out)

    def _rows(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0]), pa.int64()), *(pa.array(np.concatenate(c), pa.int64()) for c in out[1:])], names=["doc_id", "i", "kmer"])

    found = docs_dna(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "seq").mapInArrow(run, "doc_id long, i long, kmer long")
    # the benchmark has at most 4^11 k-mers, however long it is
    hits = found.join(F.broadcast(known), "kmer", "left_semi")
    w = Window.partitionBy("doc_id").orderBy("i")
    hits = hits.withColumn("new", F.least(F.lit(K), F.col("i") - F.coalesce(F.lag("i").over(w), F.lit(-K))))
    return hits.groupBy("doc_id").agg(F.sum("new").alias("covered"), F.count("*").alias("hits"))


KMER_COVERAGE = f"""with {KMERS_SQL}, bd as (select regexp_replace(translate(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{FROM[:-1]}' || chr(10), '{TO}'), '[^ACGTN]', '', 'g') seq from benchmark),
known as (select distinct least(k, translate(reverse(k), 'ACGT', 'TGCA')) kmer from (select substr(seq, unnest(range(1, length(seq) - {K - 2})), {K}) k from bd) where not contains(k, 'N')),
h as (select doc_id, i, least({K}, i - coalesce(lag(i) over (partition by doc_id order by i), -{K})) fresh from km semi join known using (kmer))
select doc_id, sum(fresh)::bigint covered, count(*) hits from h group by doc_id"""


def kmer_compare(spark, sf_dir):
    """Of neighbouring sequences: k-mers of both, and sums of lesser and greater counts over them."""
    packed = "doc_id long, c struct<kmer: array<int>, n: array<int>>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, seq in zip(b.column("doc_id").to_pylist(), b.column("seq").to_pylist(), strict=True):
                kmers, n = np.unique(Q.kmer_codes(seq or "", K)[1], return_counts=True)
                if len(kmers):
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "c": pa.array([{"kmer": kmers.astype(np.int32), "n": n.astype(np.int32)}])})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = lambda lists: _merged([(x["kmer"].values.to_numpy(), x["n"].values.to_numpy()) for x in lists])
        for b in batches:
            for doc, own, following in zip(b.column("doc_id").to_pylist(), b.column("own"), b.column("following"), strict=True):
                (a, m), (c, n) = (merged(side.values) for side in (own, following))
                _, i, j = np.intersect1d(a, c, assume_unique=True, return_indices=True)
                if len(i):
                    row = (doc, len(i), int(np.minimum(m[i], n[j]).sum()), int(np.maximum(m[i], n[j]).sum()))
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=["doc_id", "shared", "least", "most"])

    rows = docs_dna(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "seq").where("doc_id is not null")
    each = rows.mapInArrow(count, packed).groupBy("doc_id").agg(F.collect_list("c").alias("own"))  # rows that share a doc_id are one sequence
    both = each.join(each.select((F.col("doc_id") - 1).alias("doc_id"), F.col("own").alias("following")), "doc_id")
    return both.mapInArrow(compare, "doc_id long, shared long, least long, most long")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-mers of several lists, and their counts summed up."""
    if len(parts) == 1:
        return parts[0]
    kmers, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return kmers, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


KMER_COMPARE = f"""with {KMERS_SQL}, c as (select doc_id, kmer, count(*) n from km group by all)
select a.doc_id, count(*) shared, sum(least(a.n, b.n))::bigint "least", sum(greatest(a.n, b.n))::bigint "most" from c a join c b on b.doc_id = a.doc_id + 1 and a.kmer = b.kmer group by a.doc_id"""


def colour_space(spark, sf_dir):
    """Colours of the benchmark texts' sequences."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.regexp_replace(F.translate(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), FROM, TO), "[^ACGTN]", "").alias("seq"))
    return b.select("item_id", Q.colours(F.col("seq")).alias("colours"))


COLOUR_SPACE = f"""with bd as (select item_id, regexp_replace(translate(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{FROM[:-1]}' || chr(10), '{TO}'), '[^ACGTN]', '', 'g') seq from benchmark),
c as (select item_id, i, instr('ACGT', substr(seq, i, 1)) - 1 a, instr('ACGT', substr(seq, i + 1, 1)) - 1 b from (select item_id, seq, unnest(range(1, length(seq))) i from bd))
select item_id, string_agg(case when a < 0 or b < 0 then '4' else cast(xor(a, b) as varchar) end, '' order by i) colours from c group by item_id"""


def letter_content(spark, sf_dir):
    """Sequences by their share of G and C, in hundredths of known letters."""
    d = docs_dna(spark, sf_dir)
    n = lambda cs: F.length("seq") - F.length(F.translate("seq", cs, ""))
    return d.where(n("ACGT") > 0).groupBy(F.floor(100 * n("GC") / n("ACGT")).alias("gc")).agg(F.count("*").alias("sequences"))


LETTER_CONTENT = f"with {DNA_SQL}, c as (select length(seq) - length(translate(seq, 'GC', '')) gc, length(seq) - length(translate(seq, 'ACGT', '')) n from dna) select floor(100 * gc / n)::bigint gc, count(*) sequences from c where n > 0 group by 1"


def windows_of_length(spark, sf_dir):
    """Windows of 500 letters; a last one of less than a tenth of that belongs to the one before."""
    d = docs_dna(spark, sf_dir).select("doc_id", F.length("seq").alias("n"))
    count = F.greatest(F.ceil((F.col("n") - 50) / 500), F.lit(1))
    d = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("i"), count.alias("c"))
    return d.select("doc_id", "i", (F.col("i") * 500).alias("beg"), F.when(F.col("i") == F.col("c") - 1, F.col("n")).otherwise((F.col("i") + 1) * 500).alias("fin"))


WINDOWS = f"with {DNA_SQL}, c as (select doc_id, length(seq) n, greatest(ceil((length(seq) - 50) / 500)::bigint, 1) c from dna), w as (select *, unnest(range(0, c)) i from c) select doc_id, i, i * 500 beg, case when i = c - 1 then n else (i + 1) * 500 end fin from w"

QUERIES = {
    "reverse_complement": (reverse_complement, REVERSE_COMPLEMENT), "sequence_md5": (sequence_md5, SEQUENCE_MD5), "contig_runs": (contig_runs, CONTIG_RUNS), "canonical_kmers": (canonical_kmers, CANONICAL_KMERS),
    "kmer_coverage": (kmer_coverage, KMER_COVERAGE), "kmer_compare": (kmer_compare, KMER_COMPARE), "colour_space": (colour_space, COLOUR_SPACE), "letter_content": (letter_content, LETTER_CONTENT), "windows_of_length": (windows_of_length, WINDOWS),
}
