"""Every registered query of the library proper against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from lociframe.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in os.listdir(SF):
        path = f"{SF}/{t}/*.parquet" if os.path.isdir(f"{SF}/{t}") else f"{SF}/{t}"
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{path}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def value(x):
        return "nan" if isinstance(x, float) and math.isnan(x) else str(round(x, 6) + 0.0) if isinstance(x, float) else str(x)

    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    want = duck.execute(SQL[name])
    assert got == plain(want.fetchall(), [d[0] for d in want.description])


def brute_components(edges):
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {x: root(x) for x in label}


def test_components_of_any_graph(spark):
    import random

    from lociframe.operators import graph
    from lociframe.operators.storage import writer

    random.seed(5)
    edges = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r.node: r.root for r in graph.components(df, writer(spark)).collect()} == brute_components(edges)


def test_greedy_paths_cover_once(spark):
    rows = [r for r in QUERIES["greedy_paths"](spark, SF).collect()]
    assert len({r.node for r in rows}) == len(rows)


def test_paths_follow_support(spark):
    from lociframe.operators import graph

    edges = spark.createDataFrame([(1, 1, 2, 0, 9), (2, 1, 3, 0, 7), (2, 1, 4, 0, 3), (4, 1, 5, 0, 2)], "u long, du int, v long, dv int, n long")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 6)], "node long, root long")
    got = {(r.path, r.place): (r.node, r.way, r.support) for r in graph.greedy_paths(edges, labels).collect()}
    assert [got[0, i] for i in range(3)] == [(1, 1, 7), (2, 1, 7), (3, 1, 7)]
    assert {got[1, 0][0], got[1, 1][0]} == {4, 5}


def test_layers_and_cycles(spark):
    from lociframe.operators import graph

    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (5, 6), (6, 5)], "u long, v long")
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "node long, root long")
    assert {r.node: r.layer for r in graph.path_order(edges, labels).collect()} == {1: 0, 2: 1, 3: 2, 5: -1, 6: -1}


def test_island_components_match_brute_force(spark):
    from lociframe.plans import interval_queries as Q

    edges = [(r.tid * 10_000_000 + r.u, r.tid * 10_000_000 + r.v) for q in (Q.splice_edges, Q.mate_edges_within) for r in q(spark, SF).collect() if r.u != r.v]
    got = {r.node: r.root for r in QUERIES["island_components"](spark, SF).collect()}
    want = brute_components(edges)
    assert {x: got[x] for x in want} == want


def test_allele_frequency_and_linkage():
    import numpy as np

    from lociframe.operators import genetics

    hom, het, alt = [0.98, 0.01, 0.01], [0.01, 0.98, 0.01], [0.01, 0.01, 0.98]
    site = np.array([hom] * 6 + [het] * 2 + [alt] * 2)
    assert abs(genetics.allele_frequency([site])[0] - 0.3) < 0.03
    assert genetics.frequency_posterior(site).argmax() == 6
    assert genetics.pair_frequencies(site, site)[1] > 0.9
    assert genetics.hwe_exact(np.array([10]), np.array([10]), np.array([0]))[0] < 1e-3
    assert abs(genetics.fisher_two_sided(*(np.array([x]) for x in (3, 1, 1, 3)))[0] - 0.4857142857) < 1e-6
