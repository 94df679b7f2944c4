"""Graph queries: mate edges between nodes of a read's place, and what is done with them.

`mate_edges` and what is named after it here follow their SQL: nodes are fixed stretches, most orders take their
strands from the numbers of their nodes, and from 1,000 stretches a sequence on nodes of two sequences meet. The
queries whose names begin with gene_ are the whole operator: nodes are gene blocks, strands are the reads' own.
"""

from __future__ import annotations

from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import support as S
from ..operators import graph as G
from ..operators.storage import kept, writer
from . import interval_queries as Q
from . import reads as R

#: Nodes are stretches of 25,001 positions of a sequence.
NODE = 25001


def mate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (u, v, dir) from a read's node to its mate's, u <> v, by the strands of both (bit 1: read, bit 0: mate), with support."""
    node = lambda tid, pos: F.col(tid) * 1000 + F.floor(F.col(pos) / NODE)
    odd = F.col("qname") % 8 == 0  # of these the strands are the reads' own, of the others those of their nodes
    r = R.reads(spark, sf_dir).where(R.admitted() & F.col("mtid").isNotNull()).withColumns({"u": node("tid", "pos"), "v": node("mtid", "mpos")}).where("u <> v")
    r = r.select("u", "v", F.when(odd, 2 * F.col("rev") + F.col("mrev")).otherwise(2 * (F.col("u") % 2) + F.col("v") % 2).cast("int").alias("dir"), "nh", "nm", "pos", "mpos")
    return r.groupBy("u", "v", "dir").agg(F.count("*").alias("n"), F.sum(F.when(F.col("nh") <= 1, 1).otherwise(0)).alias("uniq"), F.sum("nm").alias("nm_sum"), F.min("pos").alias("left_pos"), F.max("mpos").alias("right_pos"), F.countDistinct("pos").alias("coords"))


EDGES_SQL = f"""{R.READS_SQL},
pairs as (select tid * 1000 + pos // {NODE} u, mtid * 1000 + mpos // {NODE} v, qname, rev, mrev, nh, nm, pos, mpos from reads where {R.ADMITTED} and mtid is not null),
turned as (select *, case when qname % 8 = 0 then 2 * rev + mrev else 2 * (u % 2) + v % 2 end dir from pairs),
edges as (select u, v, dir, count(*) n, sum(case when nh <= 1 then 1 else 0 end)::bigint uniq, sum(nm)::bigint nm_sum, min(pos) left_pos, max(mpos) right_pos, count(distinct pos) coords from turned where u <> v group by u, v, dir)"""
MATE_EDGES = f"with {EDGES_SQL} select * from edges"


def good_edges(spark, sf_dir, least: int = 3, edges=mate_edges) -> DataFrame:
    e = edges(spark, sf_dir)
    return e.where((F.col("n") >= least) & S.good(F.col("uniq"), F.col("n") - F.col("uniq"), F.col("nm_sum")))


GOOD_SQL = f"{EDGES_SQL},\ngood as (select * from edges where n >= 3 and uniq > 0 and uniq >= 0.1 * n and nm_sum // n < 2.5)"


def edge_orientation(spark, sf_dir, edges=mate_edges):
    return G.best_orientation(good_edges(spark, sf_dir, edges=edges), 400)


BEST_SQL = f"""{GOOD_SQL},
ranked as (select *, row_number() over w r, coalesce(lead(n) over w, 0) n_second from good window w as (partition by u, v order by n desc, dir)),
chi as (select *, sqrt((n + n_second) / 800.0) null_, sqrt(n / 400.0) * 400 ca, sqrt(n_second / 400.0) * 400 cb from ranked where r = 1),
best as (select u, v, case when (n_second = 1 and n = 2) or (n_second > 1 and not (pow(ca - null_ * 400, 2) / (null_ * 400) + pow(cb - null_ * 400, 2) / (null_ * 400) > 3.841)) then -1 else dir end best, n, n_second from chi)"""
EDGE_ORIENTATION = f"with {BEST_SQL} select * from best"


def oriented(spark, sf_dir, edges=mate_edges):
    return edge_orientation(spark, sf_dir, edges).where("best >= 0").select("u", "v", F.col("best").alias("dir"), "n")


def reciprocal_edges(spark, sf_dir, edges=mate_edges):
    return G.reciprocal(oriented(spark, sf_dir, edges))


RECIPROCAL_SQL = f"{BEST_SQL},\nkept as (select u, v, best dir, n from best a where best >= 0 and exists (select 1 from best b where b.u = a.v and b.v = a.u and b.best = ((a.best >> 1) | ((a.best & 1) << 1))))"
RECIPROCAL = f"with {RECIPROCAL_SQL} select * from kept"


def one_way_edges(spark, sf_dir, edges=mate_edges):
    """Edges that fall because their reverse is missing or turned another way."""
    o = oriented(spark, sf_dir, edges)
    return o.join(G.reciprocal(o).select("u", "v"), ["u", "v"], "left_anti")


ONE_WAY = f"with {RECIPROCAL_SQL} select u, v, best dir, n from best b where best >= 0 and not exists (select 1 from kept k where k.u = b.u and k.v = b.v)"


def _stretch_strands(spark, sf_dir):
    node = F.col("tid") * 1000 + F.floor(F.col("pos") / NODE)
    return R.raw(spark, sf_dir).where(R.admitted()).groupBy(node.alias("node")).agg(F.sum(F.when(F.col("rev") == 0, 1.0).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("rev") == 1, 1.0).otherwise(0.0)).alias("q"))


def strand_consistency(spark, sf_dir, edges=mate_edges, votes=_stretch_strands):
    """Edges whose orientation agrees with the strands of their nodes: like strands need one bit set, unlike ones none or both."""
    strands = votes(spark, sf_dir).select("node", S.strand_vote(F.col("p"), F.col("q")).alias("s"))
    e = oriented(spark, sf_dir, edges).join(strands.select(F.col("node").alias("u"), F.col("s").alias("su")), "u").join(strands.select(F.col("node").alias("v"), F.col("s").alias("sv")), "v")
    ok = F.when((F.col("su") == 0) | (F.col("sv") == 0), F.lit(True)).when(F.col("su") == F.col("sv"), F.col("dir").isin(1, 2)).otherwise(F.col("dir").isin(0, 3))
    return e.select("u", "v", "dir", "su", "sv", ok.alias("consistent"))


STRAND_CONSISTENCY = f"""with {BEST_SQL},
c as (select tid * 1000 + pos // {NODE} node, sum(1 - rev)::double p, sum(rev)::double q from raw where {R.ADMITTED} group by all),
st as (select node, case when ((abs(p - q) <= 6 * sqrt(p) or abs(p - q) <= 6 * sqrt(q)) and p > 1 and q > 1) or (p <= 1 and q <= 1) or p = q then 0 when p > q then 1 else -1 end s from c)
select u, v, best dir, a.s su, b.s sv, case when a.s = 0 or b.s = 0 then true when a.s = b.s then best in (1, 2) else best in (0, 3) end consistent from best join st a on a.node = u join st b on b.node = v where best >= 0"""


def single_coordinate_edges(spark, sf_dir, edges=mate_edges):
    """Edges that fall because neither direction has reads from two places."""
    e = edges(spark, sf_dir).groupBy("u", "v").agg(F.sum("n").alias("n"), F.max("coords").alias("c"))
    back = e.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("c").alias("rc"))
    return e.join(back, ["u", "v"], "left").where("c <= 1 and coalesce(rc, 1) <= 1").select("u", "v", "n")


SINGLE_COORDINATE = f"""with {EDGES_SQL}, e as (select u, v, sum(n)::bigint n, max(coords) c from edges group by u, v)
select e.u, e.v, e.n from e left join e b on b.u = e.v and b.v = e.u where e.c <= 1 and coalesce(b.c, 1) <= 1"""


def ambiguous_sides(spark, sf_dir, edges=mate_edges):
    """Of each node and side (left: bit 1 of dir) the best edge, the next one, and whether they are too alike to choose."""
    e = oriented(spark, sf_dir, edges).withColumn("side", F.shiftright("dir", 1))
    w = Window.partitionBy("u", "side").orderBy(F.desc("n"), "v")
    top = e.withColumns({"r": F.row_number().over(w), "n2": F.coalesce(F.lead("n").over(w), F.lit(0))}).where("r = 1")
    alike = (F.col("n2") > 0) & ~S.rates_differ(F.col("n"), F.lit(400), F.col("n2"), F.lit(400))
    return top.select("u", "side", "v", "n", "n2", alike.alias("ambiguous"))


AMBIGUOUS_SIDES = f"""with {BEST_SQL},
t as (select u, best >> 1 side, v, n, row_number() over w r, coalesce(lead(n) over w, 0) n2 from best where best >= 0 window w as (partition by u, best >> 1 order by n desc, v)),
c as (select *, sqrt((n + n2) / 800.0) * 400 e, sqrt(n / 400.0) * 400 ca, sqrt(n2 / 400.0) * 400 cb from t where r = 1)
select u, side, v, n, n2, n2 > 0 and not (pow(ca - e, 2) / e + pow(cb - e, 2) / e > 3.841) ambiguous from c"""


def bubble_triangles(spark, sf_dir, edges=mate_edges):
    """Nodes u < v < w joined by three edges: candidates for a simple bubble. Edges are pointed at their greater node, so each triangle is found once."""
    e = oriented(spark, sf_dir, edges).select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")).distinct()
    two = e.join(e.select(F.col("x").alias("y"), F.col("y").alias("z")), "y")
    return two.join(e.select("x", F.col("y").alias("z")), ["x", "z"], "left_semi").groupBy(F.col("x").alias("u")).agg(F.count("*").alias("triangles"))


BUBBLE_TRIANGLES = f"""with {BEST_SQL}, e as (select distinct least(u, v) x, greatest(u, v) y from best where best >= 0)
select a.x u, count(*) triangles from e a join e b on b.x = a.y join e c on c.x = a.x and c.y = b.y group by a.x"""


def boundary_edges(spark, sf_dir):
    """Edges whose outermost reads lie within 12,000 positions of their nodes' ends."""
    e = mate_edges(spark, sf_dir)
    u0, v1 = (F.col("u") % 1000) * NODE, (F.col("v") % 1000 + 1) * NODE
    return e.select("u", "v", "dir", ((F.col("left_pos") - u0 <= 12000) & (v1 - F.col("right_pos") <= 12000)).alias("near"))


BOUNDARY_EDGES = f"with {EDGES_SQL} select u, v, dir, left_pos - (u % 1000) * {NODE} <= 12000 and (v % 1000 + 1) * {NODE} - right_pos <= 12000 near from edges"


def terminal_nodes(spark, sf_dir, edges=mate_edges):
    """Nodes that have no reciprocal edge at one of their sides."""
    e = reciprocal_edges(spark, sf_dir, edges).withColumn("side", F.shiftright("dir", 1))
    return e.groupBy(F.col("u").alias("node")).agg(F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("left"), F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("right")).where("left = 0 or right = 0")


TERMINAL_NODES = f"""with {RECIPROCAL_SQL}, s as (select u node, sum(case when dir >> 1 = 1 then 1 else 0 end)::bigint "left", sum(case when dir >> 1 = 0 then 1 else 0 end)::bigint "right" from kept group by u)
select * from s where "left" = 0 or "right" = 0"""


def islands(spark, sf_dir):
    """Islands of the reads as a table that all steps of a query read."""
    return writer(spark)(Q.exon_blocks(spark, sf_dir), "islands")


def island_components(spark, sf_dir, blocks=None):
    """Classes of islands that splices and mates within sequences join: sequence, island, least island of the class."""
    number = F.col("tid") * 10_000_000
    blocks = islands(spark, sf_dir) if blocks is None else blocks
    e = Q.splice_edges(spark, sf_dir, blocks).unionByName(Q.mate_edges_within(spark, sf_dir, blocks))
    e = e.select((number + F.col("u")).alias("u"), (number + F.col("v")).alias("v")).distinct()
    return G.components(e, writer(spark)).select((F.col("node") / 10_000_000).cast("long").alias("tid"), F.col("node"), F.col("root"))


def component_validity(spark, sf_dir, labels=None, blocks=None):
    """Classes of islands with at least one good island and a fifth of them good."""
    blocks = islands(spark, sf_dir) if blocks is None else blocks
    labels = island_components(spark, sf_dir, blocks) if labels is None else labels
    q = Q.support_quality(spark, sf_dir, blocks).select((F.col("tid") * 10_000_000 + F.col("bid")).alias("node"), F.col("good").cast("int").alias("g"))
    return q.join(labels.select("node", "root"), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.count("*").alias("n"), F.sum("g").alias("good")).withColumn("valid", (F.col("good") >= 1) & (F.col("good") >= 0.2 * F.col("n")))


def block_exons(spark, sf_dir, blocks=None):
    """Valid islands with the number of their gene block."""
    blocks = islands(spark, sf_dir) if blocks is None else blocks
    labels = writer(spark)(island_components(spark, sf_dir, blocks).select("tid", "node", "root"), "labels")
    valid = component_validity(spark, sf_dir, labels, blocks).where("valid").select("root")
    labels = labels.drop("tid")
    b = blocks.withColumn("node", F.col("tid") * 10_000_000 + F.col("bid"))
    b = b.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")).join(valid, "root", "left_semi")
    w = Window.partitionBy("tid").orderBy("bid")
    return b.withColumn("new", F.when(F.lag("root").over(w).eqNullSafe(F.col("root")), 0).otherwise(1)).withColumn("gid", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def gene_blocks(spark, sf_dir):
    """Runs of valid islands of one class along a sequence: a new block begins where the class changes."""
    b = block_exons(spark, sf_dir)
    return b.groupBy("tid", "gid", "root").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("islands"), F.sum("n").alias("n"), F.sum(F.col("end") - F.col("start") + 1).alias("effective"))


_KEPT: dict[tuple[str, str, str], object] = {}


def _once(make):
    """make(spark, sf_dir), whose result lies in tables of the shared folder, is made once for an application and folder; all queries that begin with gene_ read these tables."""

    @wraps(make)
    def get(spark, sf_dir):
        key = (spark.sparkContext.applicationId, sf_dir, make.__name__)
        if key not in _KEPT:
            _KEPT[key] = make(spark, sf_dir)
        return _KEPT[key]

    return get


#: Loci that the rows of an order lie at, and how many of them a sequence has.
LOCI, SEQUENCES = 60, 5


@_once
def genes(spark, sf_dir) -> str:
    """Folder of a lineitem table whose reads lie at LOCI loci: those of an order at two that follow each other in a ring, the odd lines at the second, on the reverse strand; a tenth of the rows lies up to three loci further. So many pairs join the same two loci, from either side."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    odd = F.col("l_linenumber") % 2
    further = F.when(F.col("l_partkey") % 10 == 0, 1 + F.expr("l_partkey div 10") % 3).otherwise(0)
    locus = (F.col("l_orderkey") * 7 + odd + further) % LOCI
    changed = {"l_suppkey": locus % SEQUENCES + 10 * (F.col("l_suppkey") % 100), "l_partkey": F.floor(locus / SEQUENCES) * 60 + F.col("l_partkey") % 3, "l_linestatus": F.when(odd == 1, "F").otherwise("O"), "l_linenumber": 4 * F.col("l_linenumber") + 1}  # such lines have few differences and aren't spliced
    kinds = dict(li.dtypes)
    folder = kept(li.select(*(changed[c].cast(kinds[c]).alias(c) if c in changed else F.col(c) for c in li.columns)), "lineitem")
    R.keep_reads(spark, folder)
    return folder


@_once
def gene_islands(spark, sf_dir):
    """Islands of `genes`."""
    return islands(spark, genes(spark, sf_dir))


@_once
def gene_exons(spark, sf_dir):
    """Valid islands of `genes` with the number of their gene block."""
    return writer(spark)(block_exons(spark, genes(spark, sf_dir), gene_islands(spark, sf_dir)).select("tid", "gid", "start", "end", "left_splice", "right_splice", "plus", "minus"), "exons")


@_once
def gene_mate_edges(spark, sf_dir):
    """Edges between gene blocks of `genes` by the strands of each read and its mate, whose residuals come to at most a fragment and two deviations over all pairs inside islands."""
    return edges_of_blocks(spark, genes(spark, sf_dir), gene_exons(spark, sf_dir), gene_islands(spark, sf_dir))


def edges_of_blocks(spark, sf_dir, exons=None, blocks=None):
    write = writer(spark)
    exons = write(block_exons(spark, sf_dir).select("tid", "gid", "start", "end", "left_splice", "right_splice"), "exons") if exons is None else exons
    s = Q.inner_pairs(spark, sf_dir, blocks).agg(F.floor(F.avg("f")).alias("f"), F.avg(F.col("f") * F.col("f")).alias("sq"))
    limit = s.select((F.col("f") + 2 * F.floor(F.sqrt(F.greatest(F.col("sq") - F.col("f") * F.col("f"), F.lit(0.0))))).alias("residual"))
    return write(G.mate_graph(R.reads(spark, sf_dir).where(R.admitted() & F.col("mtid").isNotNull()), exons, limit), "mates")


def _locus_place(row: int, locus):
    """Where the reads of a locus of `genes` lie, some letters into them."""
    return F.floor(locus % LOCI / SEQUENCES) * 3000 + row


def gene_repeat_classes(spark, sf_dir):
    """Classes of gene blocks that many reads with several hits place in both: the second hit lies seven loci on."""
    folder = genes(spark, sf_dir)
    locus = F.floor(F.col("pos") / 3000) * SEQUENCES + F.col("tid") + 7
    r = R.reads(spark, folder).where(R.admitted() & (F.col("nh") > 1)).select("tid", "pos", (locus % LOCI % SEQUENCES).alias("ctid"), (_locus_place(40, locus)).alias("cpos"))
    return G.repeat_classes(r, gene_exons(spark, sf_dir), 3, writer(spark))


def gene_clipped_edges(spark, sf_dir):
    """Edges between gene blocks from other hits of clipped reads: every third read has one three loci on, and one too short before it."""
    folder = genes(spark, sf_dir)
    locus = F.floor(F.col("pos") / 3000) * SEQUENCES + F.col("tid") + 3
    hit = lambda row, length: F.struct((locus % LOCI % SEQUENCES).alias("tid"), _locus_place(row, locus).alias("pos"), (1 - F.col("rev")).alias("rev"), F.lit(length).alias("len"))
    s = R.spans(spark, folder).where(R.admitted() & F.col("mtid").isNotNull())
    r = s.select(F.struct("qname", "ord").alias("rid"), "tid", "pos", "rev", F.when(F.col("gap") > 0, F.col("half") + 1).otherwise(F.col("end_pos") - F.col("pos") + 1).alias("first"), "mtid", "mpos", "mrev",
                 (F.col("qname") % 13 == 0).alias("supplementary"), F.when(F.col("qname") % 3 == 0, F.array(hit(30, 20), hit(40, 36))).otherwise(F.array().cast("array<struct<tid: bigint, pos: bigint, rev: int, len: int>>")).alias("hits"))
    return G.clipped_graph(r, gene_exons(spark, sf_dir), spark.range(1).select(F.lit(None).cast("long").alias("residual")), 34)


def gene_family_edges(spark, sf_dir):
    """Edges between gene blocks of one class of repeats."""
    return G.family_edges(gene_clipped_edges(spark, sf_dir), gene_repeat_classes(spark, sf_dir))


def gene_misassembled(spark, sf_dir):
    """Sequences that paths of gene blocks leave and come back to at another block."""
    write = writer(spark)
    w = Window.partitionBy("root", "path").orderBy("place")
    p = write(greedy_paths(spark, sf_dir, gene_mate_edges).select(F.col("node").alias("u"), F.lead("node").over(w).alias("v")), "path-edges")
    nodes = p.select(F.col("u").alias("node")).distinct()
    return G.misassembled(p.where("v is not null"), nodes.select("node", F.floor(F.col("node") / G.NUMBERS).alias("contig")), write)


def _gene_votes(spark, sf_dir):
    node = F.col("tid") * G.NUMBERS + F.col("gid")
    return gene_exons(spark, sf_dir).groupBy(node.alias("node")).agg(F.sum("plus").alias("p"), F.sum("minus").alias("q"))


def _ends(spark, sf_dir, edges=mate_edges) -> tuple[DataFrame, DataFrame]:
    """Reciprocal edges, each once, between node ends (0 left, 1 right), and their classes."""
    e = reciprocal_edges(spark, sf_dir, edges).where("u < v")
    e = e.select("u", F.when(F.col("dir") >= 2, 0).otherwise(1).alias("du"), "v", F.when(F.col("dir") % 2 == 1, 0).otherwise(1).alias("dv"), "n")
    return e, G.components(e.select("u", "v"), writer(spark))


def greedy_paths(spark, sf_dir, edges=mate_edges):
    return G.greedy_paths(*_ends(spark, sf_dir, edges))


def scaffold_order(spark, sf_dir, edges=mate_edges):
    """Paths by support, longest first among equals."""
    p = greedy_paths(spark, sf_dir, edges).groupBy("root", "path").agg(F.min("support").alias("support"), F.count("*").alias("nodes"))
    return p.orderBy(F.desc("support"), F.desc("nodes"), "root", "path")


def path_layers(spark, sf_dir, edges=mate_edges):
    """Layers of the nodes in the order of their sequences; edges point at the greater node."""
    e, labels = _ends(spark, sf_dir, edges)
    return G.path_order(e.select("u", "v"), labels)


def end_assignment(spark, sf_dir, edges=mate_edges):
    """Of each node end the edge with most support; an end whose second edge is too near gets none."""
    e = reciprocal_edges(spark, sf_dir, edges)
    e = e.select("u", F.when(F.col("dir") >= 2, 0).otherwise(1).alias("side"), "v", "n")
    w = Window.partitionBy("u", "side").orderBy(F.desc("n"), "v")
    top = e.withColumns({"r": F.row_number().over(w), "n2": F.lead("n").over(w)}).where("r = 1")
    return top.select("u", "side", F.when((F.col("n") < 20) & (F.col("n2") * 2 > F.col("n")), -2).otherwise(F.col("v")).alias("v"), "n")


END_ASSIGNMENT = f"""with {RECIPROCAL_SQL}, t as (select u, case when dir >= 2 then 0 else 1 end side, v, n, row_number() over w r, lead(n) over w n2 from kept window w as (partition by u, case when dir >= 2 then 0 else 1 end order by n desc, v))
select u, side, case when n < 20 and n2 * 2 > n then -2 else v end v, n from t where r = 1"""


def chain_split(spark, sf_dir):
    """Orders as chains of lines, cut where the support between two lines is below 25."""
    r = R.raw(spark, sf_dir).withColumn("support", F.col("price").cast("long") % 50)
    w = Window.partitionBy("qname").orderBy(*R.TIES)
    links = r.select(F.col("qname").alias("chain"), F.row_number().over(w).alias("ord"), "pk", "support")
    return G.chains(links, ["ord"], 25).select("chain", "ord", "pk", "piece", "size")


CHAIN_SPLIT = f"""with {R.RAW_SQL},
l as (select qname chain, row_number() over (partition by qname order by {", ".join(R.TIES)}) ord, pk, cast(floor(price) as bigint) % 50 support from raw),
c as (select *, case when lag(support) over (partition by chain order by ord) < 25 then 1 else 0 end cut from l),
p as (select *, sum(cut) over (partition by chain order by ord rows unbounded preceding)::bigint piece from c),
s as (select *, count(*) over (partition by chain, piece) size from p)
select chain, ord::int ord, pk, piece, size from s where size > 1"""


def edge_union(spark, sf_dir):
    """Distinct undirected links of consecutive parts of an order and of consecutive parts by number."""
    w = Window.partitionBy("qname").orderBy(*R.TIES)
    raw = R.raw(spark, sf_dir)
    one = raw.select(F.col("pk").alias("a"), F.lead("pk").over(w).alias("b")).where("b is not null and a <> b")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    known = parts.join(parts.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
    both = one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(known)
    return both.distinct()


EDGE_UNION = f"""with {R.RAW_SQL}, l as (select pk a, lead(pk) over (partition by qname order by {", ".join(R.TIES)}) b from raw)
select least(a, b) a, greatest(a, b) b from l where b is not null and a <> b union select p_partkey, p_partkey + 1 from part where p_partkey + 1 in (select p_partkey from part)"""


def raw_edges_of_marked(spark, sf_dir):
    """Links that stay when those of marked nodes (part number divisible by 7) are taken away, but for raw ones (consecutive numbers)."""
    e = edge_union(spark, sf_dir)
    marked = spark.read.parquet(f"{sf_dir}/part.parquet").where(F.col("p_partkey") % 7 == 0).select(F.col("p_partkey").alias("m"))
    raw = e.where("b = a + 1")
    rest = e.where("b <> a + 1").join(marked, F.col("a") == F.col("m"), "left_anti").join(marked, F.col("b") == F.col("m"), "left_anti")
    return raw.unionByName(rest)


RAW_EDGES = f"""with {R.RAW_SQL}, l as (select pk a, lead(pk) over (partition by qname order by {", ".join(R.TIES)}) b from raw),
e as (select least(a, b) a, greatest(a, b) b from l where b is not null and a <> b union select p_partkey, p_partkey + 1 from part where p_partkey + 1 in (select p_partkey from part))
select * from e where b = a + 1 or (a % 7 <> 0 and b % 7 <> 0)"""


def reachability(spark, sf_dir, edges=mate_edges, numbers: int = 1000):
    """Stretches that reciprocal edges lead to from the least of each sequence, going up."""
    e = reciprocal_edges(spark, sf_dir, edges).where("u < v").select("u", "v").distinct()
    seeds = e.groupBy(F.floor(F.col("u") / numbers).alias("t")).agg(F.min("u").alias("node"))
    return G.reachable(e, seeds.select("node"), writer(spark))


REACHABILITY = f"""with recursive {RECIPROCAL_SQL}, e as (select distinct u, v from kept where u < v), s as (select min(u) node from e group by u // 1000),
reach as (select node seed, node from s union select seed, v from reach join e on e.u = reach.node) select * from reach"""

QUERIES = {
    "mate_edges": (mate_edges, MATE_EDGES), "edge_orientation": (edge_orientation, EDGE_ORIENTATION), "reciprocal_edges": (reciprocal_edges, RECIPROCAL), "one_way_edges": (one_way_edges, ONE_WAY),
    "strand_consistency": (strand_consistency, STRAND_CONSISTENCY), "single_coordinate_edges": (single_coordinate_edges, SINGLE_COORDINATE), "ambiguous_sides": (ambiguous_sides, AMBIGUOUS_SIDES),
    "bubble_triangles": (bubble_triangles, BUBBLE_TRIANGLES), "boundary_edges": (boundary_edges, BOUNDARY_EDGES), "terminal_nodes": (terminal_nodes, TERMINAL_NODES), "island_components": (island_components, None),
    "component_validity": (component_validity, None), "gene_blocks": (gene_blocks, None), "greedy_paths": (greedy_paths, None), "scaffold_order": (scaffold_order, None), "path_layers": (path_layers, None),
    "end_assignment": (end_assignment, END_ASSIGNMENT), "chain_split": (chain_split, CHAIN_SPLIT), "edge_union": (edge_union, EDGE_UNION), "raw_edges_of_marked": (raw_edges_of_marked, RAW_EDGES), "reachability": (reachability, REACHABILITY),
}

#: What is built on mate edges, over gene blocks.
QUERIES |= {f"gene_{q.__name__}": (partial(q, edges=gene_mate_edges), None) for q in (edge_orientation, reciprocal_edges, one_way_edges, single_coordinate_edges, ambiguous_sides, bubble_triangles, terminal_nodes, greedy_paths, scaffold_order, path_layers, end_assignment)}
QUERIES |= {
    "gene_repeat_classes": (gene_repeat_classes, None), "gene_clipped_edges": (gene_clipped_edges, None), "gene_family_edges": (gene_family_edges, None), "gene_misassembled": (gene_misassembled, None),
    "gene_mate_edges": (gene_mate_edges, None), "gene_strand_consistency": (partial(strand_consistency, edges=gene_mate_edges, votes=_gene_votes), None),
    "gene_reachability": (partial(reachability, edges=gene_mate_edges, numbers=G.NUMBERS), None),
}
