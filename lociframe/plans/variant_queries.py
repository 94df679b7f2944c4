"""Variant statistics over sites and samples made of orders and lines: a part is a site, a supplier a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import genetics as G


#: A site's samples are its lines; a line's genotype (0, 1, 2) comes from its flags and quantity.
SAMPLES_SQL = """samples as (select l_partkey site, l_suppkey sample, l_orderkey o, l_linenumber ln, l_shipdate sd, l_extendedprice ep,
  case when l_returnflag = 'R' then 2 when cast(l_quantity as bigint) % 3 = 0 then 1 else 0 end gt, case when l_linestatus = 'F' then 1 else 0 end rev, cast(l_quantity as bigint) dp, cast(round(l_discount * 100) as int) * 4 + 3 gq from lineitem)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q = F.col("l_quantity").cast("long")
    return li.select(F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"), F.col("l_shipdate").alias("sd"), F.col("l_extendedprice").alias("ep"),
                     F.when(F.col("l_returnflag") == "R", 2).when(q % 3 == 0, 1).otherwise(0).alias("gt"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("rev"), q.alias("dp"), (F.round(F.col("l_discount") * 100).cast("int") * 4 + 3).alias("gq"))


def allele_counts(spark, sf_dir):
    """Alleles and second alleles of each site."""
    return samples(spark, sf_dir).groupBy("site").agg((2 * F.count("*")).alias("an"), F.sum("gt").alias("ac"), F.count_if(F.col("gt") == 1).alias("het"))


ALLELE_COUNTS = f"with {SAMPLES_SQL} select site, 2 * count(*) an, sum(gt)::bigint ac, count_if(gt = 1)::bigint het from samples group by site"


def strand_tables(spark, sf_dir):
    """Two by two tables of allele and strand of each site, and their chi-square."""
    t = samples(spark, sf_dir).groupBy("site").agg(*(F.count_if((F.col("gt") > 0 if g else F.col("gt") == 0) & (F.col("rev") == r)).alias(n) for n, g, r in (("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1))))
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    den = (a + b) * (c + d) * (a + c) * (b + d)
    return t.withColumn("chi2", F.round(F.when(den > 0, (a + b + c + d) * F.pow(a * d - b * c, 2) / den).otherwise(0.0), 6))


STRAND_TABLES = f"""with {SAMPLES_SQL}, t as (select site, count_if(gt = 0 and rev = 0)::bigint a, count_if(gt = 0 and rev = 1)::bigint b, count_if(gt > 0 and rev = 0)::bigint c, count_if(gt > 0 and rev = 1)::bigint d from samples group by site)
select site, a, b, c, d, round(case when ((a + b) * (c + d) * (a + c) * (b + d)) > 0 then (a + b + c + d)::double * pow(a::double * d - b::double * c, 2) / ((a + b)::double * (c + d) * (a + c) * (b + d)) else 0.0 end, 6) chi2 from t"""


def strand_bias(spark, sf_dir):
    """Fisher's exact test of the strand tables."""
    return strand_tables(spark, sf_dir).select("site", F.round(G.fisher("a", "b", "c", "d"), 9).alias("p"))


LOGF = "lf as (select r n, coalesce(sum(ln(r)) over (order by r rows between unbounded preceding and current row), 0) v from range(1, 20001) t(r) union all select 0, 0.0)"
STRAND_BIAS = f"""with {LOGF}, t as (select site, a, b, c, d, a + b r, a + c k, a + b + c + d n from ({STRAND_TABLES})),
e as (select *, unnest(range(greatest(0, r + k - n), least(r, k) + 1)) x from t),
p as (select e.site, e.a, e.x, exp(l1.v + l2.v + l3.v + l4.v - l5.v - l6.v - l7.v - l8.v - l9.v) p from e join lf l1 on l1.n = r join lf l2 on l2.n = e.n - r join lf l3 on l3.n = k join lf l4 on l4.n = e.n - k join lf l5 on l5.n = e.n
  join lf l6 on l6.n = x join lf l7 on l7.n = r - x join lf l8 on l8.n = k - x join lf l9 on l9.n = e.n - r - k + x),
s as (select site, p from p where x = a)
select p.site, round(least(1.0, sum(p.p)), 9) p from p join s using (site) where p.p <= s.p * 1.00000001 group by p.site"""


def hwe(spark, sf_dir):
    """Exact test of Hardy-Weinberg proportions."""
    t = samples(spark, sf_dir).groupBy("site").agg(*(F.count_if(F.col("gt") == g).alias(n) for n, g in (("hom", 0), ("het", 1), ("alt", 2))))
    return t.select("site", "hom", "het", "alt", F.round(G.hwe("hom", "alt", "het"), 9).alias("p"))


HWE = f"""with {LOGF}, {SAMPLES_SQL}, t as (select site, count_if(gt = 0)::bigint hom, count_if(gt = 1)::bigint het, count_if(gt = 2)::bigint alt from samples group by site),
e as (select *, hom + het + alt n, 2 * least(hom, alt) + het rare from t), k as (select *, unnest(range(rare % 2, rare + 1, 2)) k from e),
p as (select site, hom, het, alt, k, k * ln(2) - a.v - b.v - c.v l from k join lf a on a.n = k join lf b on b.n = (rare - k) // 2 join lf c on c.n = k.n - k - (rare - k) // 2),
m as (select site, max(l) m from p group by site), q as (select p.*, exp(l - m) w from p join m using (site)), s as (select site, sum(w) t, max(case when k = het then w end) seen from q group by site)
select site, hom, het, alt, round(least(1.0, sum(case when w <= seen * (1 + 1e-9) then w else 0 end) / max(t)), 9) p from q join s using (site) group by site, hom, het, alt"""


def likelihoods(spark, sf_dir) -> DataFrame:
    """Three likelihoods a line, from its genotype and quality, as one array a site."""
    miss = F.pow(F.lit(10.0), -F.col("gq") / 10)
    like = F.array(*(F.when(F.col("gt") == g, 1 - miss).otherwise(miss / 2) for g in range(3)))
    order = F.struct("sample", "o", "ln", "sd", "ep", like.alias("l"))
    return samples(spark, sf_dir).groupBy("site").agg(F.flatten(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["l"])).alias("l"))


def em_frequency(spark, sf_dir):
    return likelihoods(spark, sf_dir).select("site", F.round(G.frequency("l"), 6).alias("f"))


def frequency_posterior(spark, sf_dir):
    """Most likely number of second alleles, and the chance of none."""
    p = likelihoods(spark, sf_dir).withColumn("p", G.posterior("l"))
    return p.select("site", (F.array_position("p", F.array_max("p")) - 1).alias("ac"), F.round(F.get("p", F.lit(0)), 6).alias("p_none"))


def site_genotypes(spark, sf_dir) -> DataFrame:
    """Mean genotype of each sample at a site."""
    return samples(spark, sf_dir).groupBy("site", (F.col("sample") % 50).alias("sample")).agg(F.avg("gt").alias("g"))


def linkage_r2(spark, sf_dir):
    """Squared correlation of neighbouring sites over the samples that both have."""
    g = site_genotypes(spark, sf_dir)
    both = g.join(g.select((F.col("site") - 1).alias("site"), "sample", F.col("g").alias("h")), ["site", "sample"])
    s = both.groupBy("site").agg(F.count("*").alias("n"), *(F.sum(e).alias(n) for n, e in (("sx", F.col("g")), ("sy", F.col("h")), ("xx", F.col("g") * F.col("g")), ("yy", F.col("h") * F.col("h")), ("xy", F.col("g") * F.col("h")))))
    vx, vy, c = F.col("n") * F.col("xx") - F.col("sx") ** 2, F.col("n") * F.col("yy") - F.col("sy") ** 2, F.col("n") * F.col("xy") - F.col("sx") * F.col("sy")
    return s.where(F.col("n") > 1).select("site", "n", F.round(F.when((vx > 1e-9) & (vy > 1e-9), c * c / (vx * vy)).otherwise(-1.0), 6).alias("r2"))


LINKAGE_R2 = f"""with {SAMPLES_SQL}, g as (select site, sample % 50 sample, avg(gt) g from samples group by all),
s as (select a.site, count(*) n, sum(a.g) sx, sum(b.g) sy, sum(a.g * a.g) xx, sum(b.g * b.g) yy, sum(a.g * b.g) xy from g a join g b on b.site = a.site + 1 and a.sample = b.sample group by a.site)
select site, n, round(case when n * xx - sx * sx > 1e-9 and n * yy - sy * sy > 1e-9 then pow(n * xy - sx * sy, 2) / ((n * xx - sx * sx) * (n * yy - sy * sy)) else -1.0 end, 6) r2 from s where n > 1"""


def sample_likelihoods(lines, *keys):
    """lines(*keys, site, s, gt, gq): likelihoods of the three genotypes from all lines of a sample at a site, the greatest as 1."""
    miss = F.pow(F.lit(10.0), -F.col("gq") / 10)
    logs = [F.log(F.greatest(F.when(F.col("gt") == g, 1 - miss).otherwise(miss / 2), F.lit(1e-300))) for g in range(3)]
    sums = lines.groupBy(*keys, "site", "s").agg(*(F.sum(x).alias(f"l{g}") for g, x in enumerate(logs)))
    return sums.select(*keys, "site", "s", F.array(*(F.exp(F.col(f"l{g}") - F.greatest("l0", "l1", "l2")) for g in range(3))).alias("l"))


#: Sites of a stretch, which are paired in one task.
STRETCH = 128


def linkage_em(spark, sf_dir):
    """Linkage of neighbouring sites from likelihoods of the samples that both have, all lines of a sample combined, by expectation and maximisation over haplotypes."""
    return _linked(samples(spark, sf_dir).select("site", (F.col("sample") % 50).alias("s"), "gt", "gq"))


def _linked(lines):
    """Lines move once, to the task of their stretch of sites, and those of its first site to the stretch before too: there they are combined, paired along the sites of a sample, and gathered."""
    stretch = lambda site: F.floor(site / STRETCH)
    both = F.array_distinct(F.array(stretch(F.col("site")), stretch(F.col("site") - 1)))
    one = sample_likelihoods(lines.where("site is not null and s is not null").withColumn("stretch", F.explode(both)).repartition("stretch"), "stretch")
    w = Window.partitionBy("stretch", "s").orderBy("site")
    pairs = one.withColumns({"next": F.lead("site").over(w), "m": F.lead("l").over(w)}).where("next = site + 1")
    arr = pairs.groupBy("stretch", "site").agg(F.sort_array(F.collect_list(F.struct("s", "l", "m"))).alias("x"))
    flat = lambda f: F.flatten(F.transform("x", lambda x: x[f]))
    return arr.select("site", F.round(G.linkage(flat("l"), flat("m")), 4).alias("r"))


def genotype_quality(spark, sf_dir):
    """Likelihoods as Phred integers, clamped to 0..255, and the genotype with its quality (at most 99)."""
    miss = F.pow(F.lit(10.0), -F.col("gq") / 10)
    gl = lambda g: F.log10(F.when(F.col("gt") == g, 1 - miss).otherwise(miss / 2))
    pl = lambda g: F.least(F.greatest(F.floor(-10 * gl(g) + 0.499), F.lit(0)), F.lit(255))
    s = samples(spark, sf_dir).select("gq", "gt", *(pl(g).alias(f"pl{g}") for g in range(3))).groupBy("gq", "gt", "pl0", "pl1", "pl2").agg(F.count("*").alias("n"))
    low = F.least("pl0", "pl1", "pl2")
    second = F.get(F.sort_array(F.array("pl0", "pl1", "pl2")), F.lit(1))
    return s.withColumns({"called": F.when(F.col("pl0") == low, 0).when(F.col("pl1") == low, 1).otherwise(2), "quality": F.least(second - low, F.lit(99))})


GENOTYPE_QUALITY = f"""with {SAMPLES_SQL}, m as (select *, pow(10.0, -gq / 10) miss from samples),
p as (select gq, gt, {", ".join(f"least(greatest(floor(-10 * log10(case when gt = {g} then 1 - miss else miss / 2 end) + 0.499)::bigint, 0), 255) pl{g}" for g in range(3))} from m),
c as (select gq, gt, pl0, pl1, pl2, count(*) n from p group by all)
select *, case when pl0 = least(pl0, pl1, pl2) then 0 when pl1 = least(pl0, pl1, pl2) then 1 else 2 end called, least(list_sort([pl0, pl1, pl2])[2] - least(pl0, pl1, pl2), 99) quality from c"""


def trio_constraint(spark, sf_dir):
    """Of orders with three lines or more, the first three as a trio: least sum of Phred values with and without inheritance."""
    r = samples(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("o").orderBy("ln", "site", "sample", "dp", "ep", "sd"))).where("k <= 3")
    pl = lambda g: F.abs(F.col("gt") - g) * F.col("gq")
    t = r.groupBy("o").agg(*(F.max(F.when(F.col("k") == k, pl(g))).alias(f"p{k}{g}") for k in (1, 2, 3) for g in range(3))).where("p30 is not null")
    # which child genotypes two parents' allow
    allowed = [(f, m, c) for f in range(3) for m in range(3) for c in range(3) if c in {x + y for x in ((0,), (0, 1), (1,))[f] for y in ((0,), (0, 1), (1,))[m]}]
    total = lambda f, m, c: F.col(f"p1{f}") + F.col(f"p2{m}") + F.col(f"p3{c}")
    return t.select("o", F.least(*(total(*x) for x in allowed)).alias("held"), F.least(*(total(f, m, c) for f in range(3) for m in range(3) for c in range(3))).alias("free"))


_ALLOWED = [(f, m, c) for f in range(3) for m in range(3) for c in range(3) if c in {x + y for x in ((0,), (0, 1), (1,))[f] for y in ((0,), (0, 1), (1,))[m]}]
TRIO = f"""with {SAMPLES_SQL}, r as (select *, row_number() over (partition by o order by ln, site, sample, dp, ep, sd) k from samples),
t as (select o, {", ".join(f"max(case when k = {k} then abs(gt - {g}) * gq end) p{k}{g}" for k in (1, 2, 3) for g in range(3))} from r where k <= 3 group by o)
select o, least({", ".join(f"p1{f} + p2{m} + p3{c}" for f, m, c in _ALLOWED)}) held, least({", ".join(f"p1{f} + p2{m} + p3{c}" for f in range(3) for m in range(3) for c in range(3))}) free from t where p30 is not null"""


def quality_steps(spark, sf_dir):
    """Sites by quality, best first: how many so far, and how many of them are transitions or known."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("qual"), (F.col("p_partkey") % 3 == 0).cast("int").alias("ts"), (F.col("p_partkey") % 4 == 0).cast("int").alias("known"))
    s = p.groupBy("qual").agg(F.count("*").alias("n"), F.sum("ts").alias("ts"), F.sum("known").alias("known"))
    w = Window.orderBy(F.desc("qual")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each quality
    return s.select("qual", *(F.sum(c).over(w).alias(c) for c in ("n", "ts", "known")))


QUALITY_STEPS = """with s as (select p_size qual, count(*) n, sum(case when p_partkey % 3 = 0 then 1 else 0 end) ts, sum(case when p_partkey % 4 = 0 then 1 else 0 end) known from part group by all)
select qual, sum(n) over w::bigint n, sum(ts) over w::bigint ts, sum(known) over w::bigint known from s window w as (order by qual desc rows unbounded preceding)""".replace("over w::bigint", "over w")


def variant_filter(spark, sf_dir):
    """Sites that pass depth and quality limits, with the reason of those that don't, and sites within ten of a large one (an indel's neighbourhood)."""
    s = samples(spark, sf_dir).groupBy("site").agg(F.sum("dp").alias("dp"), F.avg("gq").alias("gq"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("site"), "p_size")
    s = s.join(p, "site")
    # sites are dealt to stretches of 1,000 with ten neighbours on each side, so no task orders all of them
    stretch = F.floor(F.col("site") / 1000)
    near = F.array_distinct(F.array(stretch, F.floor((F.col("site") - 10) / 1000), F.floor((F.col("site") + 10) / 1000)))
    s = s.withColumn("part", F.explode(near)).withColumn("own", F.col("part") == stretch)
    w = Window.partitionBy("part").orderBy("site").rangeBetween(-10, 10)
    s = s.withColumn("indels", F.count_if(F.col("p_size") >= 49).over(w)).where("own")
    why = F.when(F.col("dp") < 300, "depth").when(F.col("gq") < 20, "quality").when((F.col("p_size") < 49) & (F.col("indels") > 0), "near indel").otherwise("pass")
    return s.groupBy(why.alias("why")).agg(F.count("*").alias("sites"), F.sum("dp").alias("dp"))


VARIANT_FILTER = f"""with {SAMPLES_SQL}, s as (select site, sum(dp)::bigint dp, avg(gq) gq from samples group by site), j as (select s.*, p_size from s join part on p_partkey = site),
w as (select *, count_if(p_size >= 49) over (order by site range between 10 preceding and 10 following) indels from j)
select case when dp < 300 then 'depth' when gq < 20 then 'quality' when p_size < 49 and indels > 0 then 'near indel' else 'pass' end why, count(*) sites, sum(dp)::bigint dp from w group by all"""


def contrast(spark, sf_dir):
    """Two by two tables of language against quality labels, and their chi-square."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    t = d.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("a"), F.count_if(F.col("quality") == 0).alias("b"))
    every = Window.partitionBy()  # a row for each language
    t = t.withColumns({"c": F.sum("a").over(every) - F.col("a"), "d": F.sum("b").over(every) - F.col("b")})
    a, b, c, e = (F.col(x).cast("double") for x in "abcd")
    den = (a + b) * (c + e) * (a + c) * (b + e)
    return t.withColumn("chi2", F.round(F.when(den > 0, (a + b + c + e) * F.pow(a * e - b * c, 2) / den).otherwise(0.0), 6))


CONTRAST = """with t as (select lang, count_if(quality = 1)::bigint a, count_if(quality = 0)::bigint b from documents join labels using (doc_id) group by lang),
u as (select *, (sum(a) over () - a)::bigint c, (sum(b) over () - b)::bigint d from t)
select *, round(case when (a + b) * (c + d) * (a + c) * (b + d) > 0 then (a + b + c + d)::double * pow(a::double * d - b::double * c, 2) / ((a + b)::double * (c + d) * (a + c) * (b + d)) else 0.0 end, 6) chi2 from u"""

QUERIES = {
    "allele_counts": (allele_counts, ALLELE_COUNTS), "strand_tables": (strand_tables, STRAND_TABLES), "strand_bias": (strand_bias, STRAND_BIAS), "hwe": (hwe, HWE), "em_frequency": (em_frequency, None), "frequency_posterior": (frequency_posterior, None),
    "linkage_r2": (linkage_r2, LINKAGE_R2), "linkage_em": (linkage_em, None), "genotype_quality": (genotype_quality, GENOTYPE_QUALITY), "trio_constraint": (trio_constraint, TRIO), "quality_steps": (quality_steps, QUALITY_STEPS),
    "variant_filter": (variant_filter, VARIANT_FILTER), "contrast": (contrast, CONTRAST),
}
