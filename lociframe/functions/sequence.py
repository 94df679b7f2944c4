"""Column expressions over nucleotide strings, and k-mers of one as numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def stored(seq: Column) -> Column:
    """Upper case; letters other than A, C, G, T become N."""
    return F.regexp_replace(F.translate(seq, "acgt", "ACGT"), "[^ACGT]", "N")


def kmers(seq: Column, k: int) -> Column:
    """All runs of k letters, in order (none: empty array)."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substr(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_codes(seq: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs of k letters A, C, G, T, and each run's number or that of its reverse complement, whichever is less: two bits a letter, in the order of the letters. One pass over the text for each letter of a run, k at most 31."""
    codes = np.full(256, 4, np.int64)
    codes[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    letters = codes[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    n = len(letters) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    forward, reverse, known = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(k):
        x = letters[j : j + n]
        known &= x < 4
        forward = forward << 2 | x & 3
        reverse |= (3 - (x & 3)) << 2 * j
    at = np.nonzero(known)[0]
    return at, np.minimum(forward, reverse)[at]


def colours(seq: Column) -> Column:
    """Colour-space code of each pair of neighbours: 0 same letter, 1 AC or GT, 2 AG or CT, 3 AT or CG, 4 with N."""
    code = lambda c: F.instr(F.lit("ACGT"), c) - 1
    pair = lambda i: (F.substr(seq, i, F.lit(1)), F.substr(seq, i + 1, F.lit(1)))
    return F.when(F.length(seq) > 1, F.array_join(F.transform(F.sequence(F.lit(1), F.length(seq) - 1), lambda i: F.when((code(pair(i)[0]) < 0) | (code(pair(i)[1]) < 0), 4).otherwise(code(pair(i)[0]).bitwiseXOR(code(pair(i)[1]))).cast("string")), "")).otherwise("")
