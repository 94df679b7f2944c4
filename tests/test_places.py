"""Letters of reads are made and counted in the task of their bucket of places."""

import re

import pytest

from lociframe.operators import intervals as I
from lociframe.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return re.findall(r"Exchange (\w+)\(([^#]*)", plan)


@pytest.mark.parametrize("name", ["sample_moments", "site_records", "genotype_likelihoods", "multiallelic_calls", "biallelic_calls", "site_biases"])
def test_calling_moves_reads_once(spark, name):
    assert exchanges(QUERIES[name](spark, SF)) == [("hashpartitioning", "tid")]


@pytest.mark.parametrize("name", ["site_alleles", "site_moments", "depth_by_source", "position_bias", "consensus_letters", "variant_view", "site_consensus", "depth"])
def test_pile_moves_reads_once(spark, name):
    assert exchanges(QUERIES[name](spark, SF)) == [("hashpartitioning", "tid")]


def test_mpileup_moves_reads_by_name_and_place(spark):
    assert [k for _, k in exchanges(QUERIES["mpileup"](spark, SF))] == ["tid", "qname"]


@pytest.mark.parametrize("width", [1, 7, 1024])
def test_places_of_intervals(spark, width):
    rows = [(1, 0, 0), (1, 5, 30), (1, 5, 30), (2, 1020, 1030), (None, 3, 4), (2, 9, 8), (1, -3, 2)]
    got = I.places(spark.createDataFrame(rows, "tid long, a long, b long"), "tid", "a", "b", 3, width).select("tid", "a", "b", "place").collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((t, a, b, p) for t, a, b in rows for p in range(a, b + 1)), key=key)
