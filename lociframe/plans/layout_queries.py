"""Queries on where blocks, edges and scaffolds lie, and on lists of sites, alleles and tags."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as I
from . import graph_queries as G
from . import interval_queries as Q
from . import reads as R
from . import variant_queries as V


def block_contigs(spark, sf_dir):
    """The contig of each island: contigs are runs of reads less than 200 apart, and an island between two takes the next one."""
    contigs = I.interval_union(R.raw(spark, sf_dir), "tid", "pos", "end_pos", {"n": F.count("*")}, {"n": F.sum("n")}, gap=200).select("tid", F.col("start").alias("c0"), F.col("end").alias("c1"))
    blocks = Q.exon_blocks(spark, sf_dir).select("tid", "bid", F.col("start").alias("at"))
    return I.following(blocks, "at", contigs, "c0", "c1", "tid").select("tid", "bid", "c0", "c1")


BLOCK_CONTIGS = f"""with {Q.BLOCKS_SQL},
cm as (select *, max(end_pos) over (partition by tid order by pos, end_pos rows between unbounded preceding and 1 preceding) pe from raw),
ci as (select *, sum(case when pe is null or pos > pe + 200 then 1 else 0 end) over (partition by tid order by pos, end_pos rows unbounded preceding) g from cm),
contigs as (select tid, min(pos) c0, max(end_pos) c1 from ci group by tid, g)
select k.tid, k.bid, c.c0, c.c1 from blocks k asof left join contigs c on k.tid = c.tid and k.start <= c.c1"""


def block_ranges(spark, sf_dir):
    """First and last island of each sequence."""
    return Q.exon_blocks(spark, sf_dir).groupBy("tid").agg(F.min("bid").alias("first"), F.max("bid").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"))


BLOCK_RANGES = f'with {Q.BLOCKS_SQL} select tid, min(bid) "first", max(bid) "last", min("start") "start", max("end") "end" from blocks group by tid'


def point_exons(spark, sf_dir):
    """Which island of its window of 50,000 positions holds a read's start, from 0; -1 in a window where none does."""
    stretch = lambda c: F.floor(F.col(c) / 50000)
    b = Q.exon_blocks(spark, sf_dir).select("tid", "start", "end", stretch("start").alias("g"))
    b = b.withColumn("ordinal", F.row_number().over(Window.partitionBy("tid", "g").orderBy("start")) - 1)
    points = R.raw(spark, sf_dir).select("qname", "ln", "pk", "sk", "tid", F.col("pos").alias("at"))
    held = I.point_join(points, "at", b.drop("g"), "start", "end", "tid", how="left").drop("start", "end").withColumn("g", stretch("at"))
    return held.join(b.select("tid", "g").distinct(), ["tid", "g"], "left_semi").select("qname", "ln", "pk", "sk", "tid", "at", "g", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"))


POINT_EXONS = f"""with {Q.BLOCKS_SQL}, b as (select tid, "start" s, "end" e, "start" // 50000 g, row_number() over (partition by tid, "start" // 50000 order by "start") - 1 ordinal from blocks),
p as (select qname, ln, pk, sk, tid, pos "at", pos // 50000 g from raw), near as (select p.*, b.s, b.e, b.ordinal from p asof left join b on p.tid = b.tid and p."at" >= b.s)
select qname, ln, pk, sk, tid, "at", g, case when "at" <= e then ordinal else -1 end::int ordinal from near where exists (select 1 from b where b.tid = near.tid and b.g = near.g)"""


def compacted_edges(spark, sf_dir, edges=G.mate_edges, least: int = 860):
    """Reciprocal edges whose nodes are both valid: all edges of a node together have at least so much support."""
    e = G.reciprocal_edges(spark, sf_dir, edges)
    valid = e.groupBy("u").agg(F.sum("n").alias("support")).where(F.col("support") >= least).select("u")
    return e.join(valid, "u", "left_semi").join(valid.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v", "dir", "n")


COMPACTED_EDGES = f"""with {G.RECIPROCAL_SQL}, t as (select u node from kept group by u having sum(n) >= 860)
select u, v, dir, n from kept where u in (select node from t) and v in (select node from t)"""


def order_faults(spark, sf_dir, edges=G.mate_edges, numbers: int = 1000):
    """Edges within a sequence that speak against its order: one node is turned, or both have changed places."""
    e = G.oriented(spark, sf_dir, edges).where(F.floor(F.col("u") / numbers) == F.floor(F.col("v") / numbers))
    swapped = ((F.col("dir") == 1) & (F.col("u") > F.col("v"))) | ((F.col("dir") == 2) & (F.col("u") < F.col("v")))
    return e.select("u", "v", "dir", "n", F.when(F.col("dir").isin(0, 3), "turned").when(swapped, "swapped").otherwise("fine").alias("fault"))


ORDER_FAULTS = f"""with {G.BEST_SQL} select u, v, best dir, n, case when best in (0, 3) then 'turned' when (best = 1 and u > v) or (best = 2 and u < v) then 'swapped' else 'fine' end fault
from best where best >= 0 and u // 1000 = v // 1000"""


def adjacency_edges(spark, sf_dir, edges=G.mate_edges, numbers: int = 1000):
    """Neighbours by number within a sequence, and reciprocal edges between others, each link once."""
    e = G.reciprocal_edges(spark, sf_dir, edges).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    nodes = e.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    sequence = lambda c: F.floor(F.col(c) / numbers)
    raw = nodes.join(nodes.select((F.col("a") - 1).alias("a"), F.col("a").alias("b")), "a").where(sequence("a") == sequence("b"))
    return raw.withColumn("kind", F.lit("raw")).unionByName(e.join(raw, ["a", "b"], "left_anti").withColumn("kind", F.lit("new")))


ADJACENCY_EDGES = f"""with {G.RECIPROCAL_SQL}, e as (select distinct least(u, v) a, greatest(u, v) b from kept), n as (select a from e union select b from e),
raw_ as (select x.a, y.a b from n x join n y on y.a = x.a + 1 and y.a // 1000 = x.a // 1000)
select a, b, 'raw' kind from raw_ union all select a, b, 'new' kind from e where not exists (select 1 from raw_ r where r.a = e.a and r.b = e.b)"""


def edges_by_source(spark, sf_dir):
    """Support of links of consecutive parts of an order from each of three sources, and how many sources have them."""
    w = Window.partitionBy("qname").orderBy(*R.TIES)
    links = R.raw(spark, sf_dir).select(F.col("pk").alias("a"), F.lead("pk").over(w).alias("b"), (F.col("sk") % 3).alias("src")).where("b is not null and a <> b")
    each = links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "src").agg(F.count("*").alias("n"))
    return each.groupBy("a", "b").agg(F.count("*").alias("sources"), F.sum("n").alias("n"), F.min("src").alias("first"))


EDGES_BY_SOURCE = f"""with {R.RAW_SQL}, l as (select pk a, lead(pk) over (partition by qname order by {", ".join(R.TIES)}) b, sk % 3 src from raw)
select least(a, b) a, greatest(a, b) b, count(distinct src) sources, count(*) n, min(src) "first" from l where b is not null and a <> b group by least(a, b), greatest(a, b)"""


def _sized_chains(spark, sf_dir):
    c = G.chain_split(spark, sf_dir)
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("pk"), F.col("p_size").cast("long").alias("len"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"))
    return c.join(p, "pk")


def scaffold_info(spark, sf_dir):
    """Scaffolds, longest first: their length with 17 letters between parts, their sequence's checksum, and a line of their parts and strands."""
    order = F.sort_array(F.collect_list(F.struct("ord", "pk", "len", "strand")))
    g = _sized_chains(spark, sf_dir).groupBy("chain", "piece").agg(F.count("*").alias("parts"), (F.sum("len") + 17 * (F.count("*") - 1)).alias("length"), order.alias("x"))
    info = F.array_join(F.transform("x", lambda v: F.concat(F.lit("("), v["pk"].cast("string"), F.lit(" "), v["strand"], F.lit(")"))), " ")
    sequence = F.array_join(F.transform("x", lambda v: F.repeat(F.lit("A"), v["len"].cast("int"))), "N" * 17)
    return g.select("chain", "piece", "parts", "length", info.alias("info"), F.md5(sequence).alias("md5")).orderBy(F.desc("length"), "chain", "piece")


SCAFFOLD_INFO = f"""with c as ({G.CHAIN_SPLIT}), s as (select c.*, p_size::bigint len, case when pk % 2 = 0 then '+' else '-' end strand from c join part on p_partkey = pk)
select chain, piece, count(*) parts, (sum(len) + 17 * (count(*) - 1))::bigint length, string_agg('(' || pk || ' ' || strand || ')', ' ' order by ord) info, md5(string_agg(repeat('A', len), repeat('N', 17) order by ord)) md5 from s group by chain, piece"""


def unreported_parts(spark, sf_dir, least: int = 7):
    """Parts that are in no chain of at least so many."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("pk"), F.col("p_size").alias("size"))
    return parts.join(G.chain_split(spark, sf_dir).where(F.col("size") >= least).select("pk").distinct(), "pk", "left_anti")


UNREPORTED_PARTS = f"select p_partkey pk, p_size size from part where p_partkey not in (select pk from ({G.CHAIN_SPLIT}) where size >= 7)"


def overlap_lists(spark, sf_dir):
    """Parts of a chain laid end to end, from 1, and which windows of 100 letters they share more than 20 letters with."""
    w = Window.partitionBy("chain", "piece").orderBy("ord")
    s = _sized_chains(spark, sf_dir).withColumn("fin", F.sum("len").over(w)).withColumn("beg", F.col("fin") - F.col("len") + 1)
    s = s.withColumn("k", F.explode(F.sequence(F.floor((F.col("beg") - 1) / 100), F.floor((F.col("fin") - 1) / 100))))
    shared = F.least("fin", (F.col("k") + 1) * 100) - F.greatest("beg", F.col("k") * 100 + 1) + 1
    return s.select("chain", "piece", "ord", "pk", "beg", "fin", "k", shared.alias("shared")).where("shared > 20")


OVERLAP_LISTS = f"""with c as ({G.CHAIN_SPLIT}), s as (select c.*, p_size::bigint len, sum(p_size) over (partition by chain, piece order by ord)::bigint fin from c join part on p_partkey = pk),
k as (select *, fin - len + 1 beg, unnest(range((fin - len) // 100, (fin - 1) // 100 + 1)) k from s)
select chain, piece, ord, pk, beg, fin, k, least(fin, (k + 1) * 100) - greatest(beg, k * 100 + 1) + 1 shared from k where least(fin, (k + 1) * 100) - greatest(beg, k * 100 + 1) + 1 > 20"""


def tag_edits(spark, sf_dir):
    """Tags of a read: mismatches and read group are set, hits appended, then all but a few names dropped."""
    r = R.raw(spark, sf_dir)
    tags = F.create_map(F.lit("NM"), F.col("nm").cast("string"), F.lit("RG"), F.concat(F.lit("rg"), F.col("sk") % 5), F.lit("XT"), F.lit("U"))
    tags = F.map_concat(tags, F.create_map(F.lit("NH"), F.col("nh").cast("string")))
    tags = F.map_filter(tags, lambda k, v: k.isin("NM", "RG", "NH") & ~((k == "RG") & (F.col("sk") % 7 == 0)))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ";")
    return r.select("qname", "ln", "pk", "sk", text.alias("tags")).groupBy("tags").agg(F.count("*").alias("n"))


TAG_EDITS = f"with {R.RAW_SQL} select concat('NH:', nh, ';NM:', nm, case when sk % 7 = 0 then '' else concat(';RG:rg', sk % 5) end) tags, count(*) n from raw group by all"


def best_hits(spark, sf_dir):
    """Of each name the hit of fewest mismatches; quality 0 where another has as few, at most 15 where one has one more."""
    w = Window.partitionBy("qname").orderBy("nm", *R.TIES)
    top = R.raw(spark, sf_dir).withColumns({"r": F.row_number().over(w), "n2": F.lead("nm").over(w)}).where("r = 1")
    return top.select("qname", "ln", "pk", "nm", F.when(F.col("n2") == F.col("nm"), 0).when(F.col("n2") == F.col("nm") + 1, F.least("mapq", F.lit(15))).otherwise(F.col("mapq")).alias("quality"))


BEST_HITS = f"""with {R.RAW_SQL}, t as (select *, row_number() over w r, lead(nm) over w n2 from raw window w as (partition by qname order by nm, {", ".join(R.TIES)}))
select qname, ln, pk, nm, case when n2 = nm then 0 when n2 = nm + 1 then least(mapq, 15) else mapq end quality from t where r = 1"""


def linkage_listed(spark, sf_dir):
    """Squared correlation of listed pairs of sites over the samples that both have."""
    g = V.site_genotypes(spark, sf_dir)
    listed = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("site"), (F.col("p_partkey") + 2 + F.col("p_partkey") % 5).alias("other"))
    both = g.join(listed, "site").join(g.select(F.col("site").alias("other"), "sample", F.col("g").alias("h")), ["other", "sample"])
    s = both.groupBy("site", "other").agg(F.count("*").alias("n"), *(F.sum(e).alias(n) for n, e in (("sx", F.col("g")), ("sy", F.col("h")), ("xx", F.col("g") * F.col("g")), ("yy", F.col("h") * F.col("h")), ("xy", F.col("g") * F.col("h")))))
    vx, vy, c = F.col("n") * F.col("xx") - F.col("sx") ** 2, F.col("n") * F.col("yy") - F.col("sy") ** 2, F.col("n") * F.col("xy") - F.col("sx") * F.col("sy")
    return s.where(F.col("n") > 1).select("site", "other", "n", F.round(F.when((vx > 1e-9) & (vy > 1e-9), c * c / (vx * vy)).otherwise(-1.0), 6).alias("r2"))


LINKAGE_LISTED = f"""with {V.SAMPLES_SQL}, g as (select site, sample % 50 sample, avg(gt) g from samples group by all),
s as (select a.site, p_partkey + 2 + p_partkey % 5 other, count(*) n, sum(a.g) sx, sum(b.g) sy, sum(a.g * a.g) xx, sum(b.g * b.g) yy, sum(a.g * b.g) xy from g a join part on p_partkey = a.site join g b on b.site = p_partkey + 2 + p_partkey % 5 and a.sample = b.sample group by all)
select site, other, n, round(case when n * xx - sx * sx > 1e-9 and n * yy - sy * sy > 1e-9 then pow(n * xy - sx * sy, 2) / ((n * xx - sx * sx) * (n * yy - sy * sy)) else -1.0 end, 6) r2 from s where n > 1"""


def linked_stretches(spark, sf_dir):
    """Intervals between neighbouring sites by how strongly they are linked: how many and how long."""
    r = V.linkage_r2(spark, sf_dir).where("r2 >= 0")
    places = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("site"), (F.col("p_partkey") * 50 + F.col("p_size")).alias("at"))
    d = r.join(places, "site").join(places.select((F.col("site") - 1).alias("site"), F.col("at").alias("next")), "site")
    return d.groupBy((F.col("r2") > 0.2).alias("linked")).agg(F.count("*").alias("intervals"), F.sum(F.col("next") - F.col("at")).alias("length"))


LINKED_STRETCHES = f"""with r as ({V.LINKAGE_R2}), p as (select p_partkey site, p_partkey * 50 + p_size at_ from part)
select r2 > 0.2 linked, count(*) intervals, sum(y.at_ - x.at_)::bigint length from r join p x on x.site = r.site join p y on y.site = r.site + 1 where r2 >= 0 group by all"""


def gap_lengths(spark, sf_dir):
    """Lengths of inserted and deleted letters, an allele counting for its share of the site's, and whether they keep the frame."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("k", 1 + F.col("p_size") % 3)
    a = p.select("k", F.explode(F.transform(F.sequence(F.lit(1), F.col("k")), lambda j: (F.col("p_partkey") + 5 * j) % 9 - 4)).alias("len")).where("len <> 0")
    return a.groupBy("len").agg(F.count("*").alias("alleles"), F.round(F.sum(1 / F.col("k")), 6).alias("weight")).withColumn("in_frame", F.col("len") % 3 == 0)


GAP_LENGTHS = """with a as (select 1 + p_size % 3 k, unnest([(p_partkey + 5 * j) % 9 - 4 for j in range(1, 2 + p_size % 3)]) len from part)
select len, count(*) alleles, round(sum(1.0 / k)::double, 6) weight, len % 3 = 0 in_frame from a where len <> 0 group by len"""


def frequency_spectrum(spark, sf_dir):
    """Sites of each population (a supplier's nation) by how many of ten shares of its alleles are the second one."""
    nations = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("sample"), F.col("s_nationkey").alias("population"))
    c = V.samples(spark, sf_dir).join(nations, "sample").groupBy("population", "site").agg((2 * F.count("*")).alias("an"), F.sum("gt").alias("ac"))
    return c.groupBy("population", F.expr("10 * ac div an").alias("tenth")).agg(F.count("*").alias("sites"), F.sum("an").alias("alleles"))


FREQUENCY_SPECTRUM = f"""with {V.SAMPLES_SQL}, c as (select s_nationkey population, site, 2 * count(*) an, sum(gt)::bigint ac from samples join supplier on s_suppkey = sample group by all)
select population, (10 * ac) // an tenth, count(*) sites, sum(an)::bigint alleles from c group by all"""


def known_sites(spark, sf_dir):
    """Listed sites on the forward strand: alleles of the other strand are complemented, sites whose own letter isn't among two are dropped."""
    letter = lambda n: F.substr(F.lit("ACGT"), (n % 4 + 1).cast("int"), F.lit(1))
    size = F.col("p_size").cast("long")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("site"), letter(F.col("p_partkey")).alias("ref"), letter(size).alias("x"), letter(F.floor(size / 4)).alias("y"), (F.col("p_partkey") % 3 == 0).alias("reverse"))
    turn = lambda c: F.when(F.col("reverse"), F.translate(c, "ACGT", "TGCA")).otherwise(F.col(c))
    p = p.withColumns({"x": turn("x"), "y": turn("y")}).where("x <> y and (x = ref or y = ref)")
    return p.select("site", "ref", F.when(F.col("x") == F.col("ref"), F.col("y")).otherwise(F.col("x")).alias("alt"), "reverse")


KNOWN_SITES = """with p as (select p_partkey site, substr('ACGT', (1 + p_partkey % 4)::int, 1) ref, substr('ACGT', (1 + p_size % 4)::int, 1) x, substr('ACGT', (1 + (p_size // 4) % 4)::int, 1) y, p_partkey % 3 = 0 "reverse" from part),
t as (select site, ref, "reverse", case when "reverse" then translate(x, 'ACGT', 'TGCA') else x end x, case when "reverse" then translate(y, 'ACGT', 'TGCA') else y end y from p)
select site, ref, case when x = ref then y else x end alt, "reverse" from t where x <> y and (x = ref or y = ref)"""

QUERIES = {
    "block_contigs": (block_contigs, BLOCK_CONTIGS), "block_ranges": (block_ranges, BLOCK_RANGES), "point_exons": (point_exons, POINT_EXONS), "compacted_edges": (compacted_edges, COMPACTED_EDGES), "order_faults": (order_faults, ORDER_FAULTS),
    "adjacency_edges": (adjacency_edges, ADJACENCY_EDGES), "edges_by_source": (edges_by_source, EDGES_BY_SOURCE), "scaffold_info": (scaffold_info, SCAFFOLD_INFO), "unreported_parts": (unreported_parts, UNREPORTED_PARTS),
    "overlap_lists": (overlap_lists, OVERLAP_LISTS), "tag_edits": (tag_edits, TAG_EDITS), "best_hits": (best_hits, BEST_HITS), "linkage_listed": (linkage_listed, LINKAGE_LISTED), "linked_stretches": (linked_stretches, LINKED_STRETCHES),
    "gap_lengths": (gap_lengths, GAP_LENGTHS), "frequency_spectrum": (frequency_spectrum, FREQUENCY_SPECTRUM), "known_sites": (known_sites, KNOWN_SITES),
}
