"""Column expressions over read flags and support counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_all(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(bits) == bits


def has_none(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(bits) == 0


def unique(nh: Column) -> Column:
    return F.coalesce(nh, F.lit(1)) <= 1


def strand(n_segments: Column, xs: Column) -> Column:
    return F.when((n_segments <= 1) | xs.isNull(), 0).when(xs == "-", -1).otherwise(1)


def segment_weight(i: Column, n: Column) -> Column:
    """A read's strand weight is spread over its segments: inner ones twice the outer ones, 1 in all."""
    return F.when(n <= 1, 0.0).when((i == 0) | (i == n - 1), 1 / (2 * n - 2)).otherwise(1 / (n - 1))


def good(uniq: Column, multi: Column, nm_sum: Column) -> Column:
    """Some unique reads, at least a tenth of all, and a whole mean of fewer than three mismatches."""
    total = uniq + multi
    return (uniq > 0) & (uniq >= 0.1 * total) & (F.floor(nm_sum / total) < 2.5)


def mostly_unique(uniq: Column, multi: Column) -> Column:
    return uniq >= 0.95 * (uniq + multi)


def within_six_sigma(a: Column, b: Column) -> Column:
    """Neither count lies beyond six Poisson deviations of the other."""
    return (F.abs(a - b) <= 6 * F.sqrt(b)) | (F.abs(a - b) <= 6 * F.sqrt(a))


def strand_vote(plus: Column, minus: Column) -> Column:
    unclear = (within_six_sigma(plus, minus) & (plus > 1) & (minus > 1)) | ((plus <= 1) & (minus <= 1)) | (plus == minus)
    return F.when(unclear, 0).when(plus > minus, 1).otherwise(-1)


def rates_differ(ca: Column, la: Column, cb: Column, lb: Column) -> Column:
    """Chi-square of two counts over two lengths against 3.841 (one degree of freedom), on square roots of the rates; false without length or counts."""
    null = F.sqrt((ca + cb) / (la + lb))
    chi = F.pow(F.sqrt(ca / la) * la - null * la, 2) / (null * la) + F.pow(F.sqrt(cb / lb) * lb - null * lb, 2) / (null * lb)
    return F.when((la > 0) & (lb > 0) & (ca + cb > 0), chi > 3.841).otherwise(F.lit(False))


def flag_letters(flag: Column) -> Column:
    """One letter for each bit set, lowest bit first."""
    return F.concat(*(F.when(flag.bitwiseAND(1 << i) != 0, c).otherwise("") for i, c in enumerate("pPuUrR12sfd")))


def x31(name: Column) -> Column:
    """Hash of a string by h = 31 h + byte over 32 bits (ASCII names)."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), F.ascii)
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32))
