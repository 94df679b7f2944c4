from collections import Counter

import pyarrow.parquet as pq

from lociframe.operators import ordering as O
from lociframe.operators.storage import writer
from lociframe.plans import ordering_queries as Q

SF = "/root/testdata/sf0.001"


def test_links_join_the_two_parts_sold_most(spark):
    """As plain sums say, ties by part; and no more than two parts of a supplier go on to be paired."""
    lines = pq.read_table(f"{SF}/lineitem.parquet", columns=["l_suppkey", "l_partkey", "l_quantity"]).to_pylist()
    sums: Counter = Counter()
    for x in lines:
        sums[x["l_suppkey"], x["l_partkey"]] += int(x["l_quantity"])
    by: dict = {}
    for (s, p), q in sums.items():
        by.setdefault(s, []).append((-q, p))
    want = sorted((a - 1, -q % 2, b - 1, -r % 2, s) for s, x in by.items() if len(x) > 1 for (q, a), (r, b) in [sorted(x)[:2]])
    links = Q.links(spark, SF)
    assert sorted(tuple(r) for r in links.select("a", "ea", "b", "eb", "nth").collect()) == want
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Sort [") == 1


def test_ties_of_parts(spark, tmp_path):
    rows = [(1, 9, 5.0), (1, 4, 3.0), (1, 4, 2.0), (1, 7, 5.0), (2, 3, 1.0), (3, 8, 2.0), (3, 6, 1.0), (3, 6, 3.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(tuple(r) for r in Q.links(spark, str(tmp_path)).select("a", "ea", "b", "eb", "nth").collect())
    assert got == [(3, 1, 6, 1, 1), (5, 0, 7, 0, 3)]


def test_scaffolds_are_labelled_not_their_contigs(spark):
    """Components take an edge a connection, however many contigs scaffolds have; without a connection nothing is labelled."""
    seen = {}
    write = writer(spark)

    def noted(df, name):
        seen[name] = write(df, name)
        return seen[name]

    contigs = spark.createDataFrame([(c, c // 10, c % 10 * 100, c % 10 * 100 + 49) for c in range(60)], "cid long, scaffold long, start long, end long")
    # 0 - 1 - 2 by three, 3 within itself, 4 with a contig that isn't there, 5 without any
    given = [(3, 1, 14, 0, 1), (5, 1, 14, 0, 2), (16, 1, 22, 0, 3), (31, 1, 36, 0, 4), (44, 1, 99, 0, 5)]
    links = spark.createDataFrame(given, "a long, ea int, b long, eb int, nth long")
    rows = O.ordered_contigs(contigs, links, noted).collect()
    assert sorted(r.cid for r in rows) == list(range(60))
    assert sorted((r.x, r.y) for r in seen["edges"].collect()) == [(0, 1), (1, 2), (3, 3)]
    graphs = seen["graphs"].collect()
    assert {(r.root, r.x1) for r in graphs if r.kind == 0} == {(0, 0), (0, 1), (0, 2), (3, 3)}
    assert sorted((r.root, r.x4) for r in graphs if r.kind == 2) == [(0, 1), (0, 2), (0, 3), (3, 4)]
    assert {r.root for r in graphs if r.kind == 1} == {0, 3}
