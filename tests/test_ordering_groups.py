from pyspark.sql import functions as F

from lociframe.operators import ordering as O
from lociframe.operators.storage import writer
from lociframe.plans import ordering_queries as Q

SF = "/root/testdata/sf0.001"


def test_components_share_groups(spark, monkeypatch):
    """What comes out doesn't depend on which components share a group."""
    run = lambda f: sorted(tuple(r) for r in f(spark, SF).collect())
    got = []
    for rows in (1, 1 << 20):
        monkeypatch.setattr(O, "GROUP", rows)
        got.append((run(Q.ordered_contigs), run(Q.cyclic_contigs)))
    assert got[0] == got[1] and len(got[0][0]) == Q.contigs(spark, SF).count()


def test_links_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    contigs = spark.createDataFrame([(c, c // 4, c % 4 * 100, c % 4 * 100 + 49) for c in range(12)], "cid long, scaffold long, start long, end long")
    links = spark.createDataFrame([(1, 1, 4, 0, 1), (7, 1, 8, 0, 2), (7, 1, 8, 0, 3)], "a long, ea int, b long, eb int, nth long")
    for run in (O.cyclic_contigs, O.acyclic_links, O.ordered_contigs):
        before = seen.value
        run(contigs, links.withColumn("a", counted("a")), writer(spark)).collect()
        assert seen.value - before == 3


def test_lines_move_once_to_links(spark):
    plan = Q.links(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
