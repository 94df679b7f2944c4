import numpy as np

from lociframe.operators import genetics as G
from lociframe.plans import variant_queries as V

SF = "/root/testdata/sf0.001"


def likelihoods(r, n):
    miss = 10 ** (-r.integers(3, 40, n) / 10)
    return np.where(r.integers(0, 3, n)[:, None] == np.arange(3), 1 - miss[:, None], miss[:, None] / 2)


def test_sites_together_as_one_by_one(monkeypatch):
    monkeypatch.setattr(G, "TOGETHER", 20)  # several pieces of a size
    r = np.random.default_rng(3)
    sizes = [*r.integers(1, 6, 60).tolist(), 0, 100]
    a, b = [[likelihoods(r, n) for n in sizes] for _ in range(2)]
    a[7][:] = 1  # nothing known
    assert G.pair_correlations(a, b).tolist() == [G.pair_frequencies(x, y)[1] for x, y in zip(a, b, strict=True)]
    assert G.allele_frequency(a).tolist() == [G.allele_frequency([x])[0] for x in a]
    assert G.pair_correlations(a, b)[[7, 60]].tolist() == [-1, -1] and G.pair_correlations([], []).tolist() == []


def test_pairs_of_all_stretches(spark):
    """Lines move once, and the pairs are those of plain loops, at borders of stretches too; lines without site or sample count nowhere."""
    r = np.random.default_rng(4)
    sites = [0, 1, 126, 127, 128, 129, 131, 255, 256, 257, -1, -2]
    lines = [(s, int(x), int(r.integers(0, 3)), int(r.integers(3, 40))) for s in sites for x in r.integers(0, 6, 9)]
    got = V._linked(spark.createDataFrame([*lines, (None, 1, 0, 9), (1, None, 0, 9), (2, None, 0, 9)], "site long, s long, gt int, gq int"))
    like: dict = {}
    for s, x, gt, gq in lines:
        miss = 10 ** (-gq / 10)
        like[s, x] = like.get((s, x), 1) * np.array([1 - miss if g == gt else miss / 2 for g in range(3)])
    want = {}
    for s in sites:
        both = sorted(x for at, x in like if at == s and (s + 1, x) in like)
        if both:
            want[s] = G.pair_frequencies(*(np.array([like[at, x] / like[at, x].max() for x in both]) for at in (s, s + 1)))[1]
    found = {row.site: row.r for row in got.collect()}
    assert found.keys() == want.keys() and {127, 128, 255, -1} <= found.keys()
    assert all(abs(found[s] - want[s]) < 1e-4 for s in want)
    plan = V.linkage_em(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
