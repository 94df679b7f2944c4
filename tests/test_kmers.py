import numpy as np
import pytest

from lociframe.functions import sequence as Q
from lociframe.plans import sequence_queries


@pytest.mark.parametrize("k", [1, 3, 11])
def test_codes_of_kmers(k):
    seq = "".join(np.random.default_rng(k).choice(list("ACGTN"), 400, p=[0.24, 0.24, 0.24, 0.24, 0.04]))
    want = []
    for i in range(len(seq) - k + 1):
        x = seq[i : i + k]
        if "N" not in x:
            x = min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA")))
            want.append((i, int("".join(str("ACGT".index(c)) for c in x), 4)))
    assert list(zip(*(c.tolist() for c in Q.kmer_codes(seq, k)), strict=True)) == want
    assert [len(c) for c in Q.kmer_codes("ACGTACGTACGT"[: k - 1], k)] == [0, 0]


def test_long_text_takes_linear_time(spark, tmp_path):
    """Ten times the letters, not a hundred times the work: a k-mer isn't looked up by its place from the text's start."""
    rows = [(1, "thecatsaton " * 40_000), (1, "tea"), (2, "thecatsaton " * 3), (None, "thecatsatonamat"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sequence_queries.kmer_compare(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in got] == [1]
    assert 0 < got[0].least <= got[0].most
    counts = sequence_queries.canonical_kmers(spark, str(tmp_path)).collect()
    assert sum(r.times * r.kmers for r in counts) == sum(len(Q.kmer_codes(t.translate(str.maketrans(sequence_queries.FROM, sequence_queries.TO)), 11)[0]) for _, t in rows if t)
