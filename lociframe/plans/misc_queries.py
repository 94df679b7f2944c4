"""Sessions, sweep depth, hit classification and what is done with verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming.sessions import sessions
from . import reads as R


def event_sessions(spark, sf_dir):
    """Sessions of a user: events less than half an hour apart."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return sessions(e).select("user_id", "start", "end", "n", F.round("value", 4).alias("value"))


EVENT_SESSIONS = """with g as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) k from g)
select user_id, min(ts) "start", max(ts) + interval 30 minutes "end", count(*) n, round(sum(value), 4) as value from s group by user_id, k"""


def _hits(spark, sf_dir):
    """Hits of queries (orders) on subjects (suppliers modulo 40) as an alignment search would list them."""
    r = R.raw(spark, sf_dir)
    return r.select("qname", (F.col("sk") % 40).alias("subject"), (F.col("pos") % 2000).alias("qs"), (F.col("pos") % 2000 + 30).alias("qe"), F.when(F.col("rev") == 1, F.col("pk") + 50).otherwise(F.col("pk")).alias("ss"), F.when(F.col("rev") == 1, F.col("pk")).otherwise(F.col("pk") + 50).alias("se"), *R.TIES)


HITS_SQL = f"""{R.RAW_SQL}, hits as (select qname, sk % 40 subject, pos % 2000 qs, pos % 2000 + 30 qe, case when rev = 1 then pk + 50 else pk end ss, case when rev = 1 then pk else pk + 50 end se, {", ".join(R.TIES)} from raw)"""


def hit_verdicts(spark, sf_dir):
    """Of each query and subject: -1 orientation changes between hits, -2 subject places run against it, 1 hits cover most of the query, else 0."""
    w = Window.partitionBy("qname", "subject").orderBy("qs", *R.TIES)
    h = _hits(spark, sf_dir).withColumn("way", F.when(F.col("ss") <= F.col("se"), 1).otherwise(-1))
    h = h.withColumns({"turned": (F.lag("way").over(w) != F.col("way")).cast("int"), "back": ((F.col("ss") - F.lag("ss").over(w)) * F.col("way") < 0).cast("int")})
    g = h.groupBy("qname", "subject").agg(F.count("*").alias("hits"), F.coalesce(F.max("turned"), F.lit(0)).alias("turned"), F.coalesce(F.max("back"), F.lit(0)).alias("back"), F.sum(F.col("qe") - F.col("qs") + 1).alias("covered"))
    return g.select("qname", "subject", "hits", F.when(F.col("turned") == 1, -1).when(F.col("back") == 1, -2).when(F.col("covered") >= 60, 1).otherwise(0).alias("verdict"))


HIT_VERDICTS = f"""with {HITS_SQL}, h as (select *, case when ss <= se then 1 else -1 end way from hits),
l as (select *, lag(way) over w <> way turned, (ss - lag(ss) over w) * way < 0 back from h window w as (partition by qname, subject order by qs, {", ".join(R.TIES)})),
g as (select qname, subject, count(*) hits, coalesce(max(turned::int), 0) turned, coalesce(max(back::int), 0) back, sum(qe - qs + 1) covered from l group by qname, subject)
select qname, subject, hits, case when turned = 1 then -1 when back = 1 then -2 when covered >= 60 then 1 else 0 end verdict from g"""


def query_verdicts(spark, sf_dir):
    """One verdict a query: covered wins, then the worst fault."""
    v = hit_verdicts(spark, sf_dir)
    return v.groupBy("qname").agg(F.when(F.max("verdict") == 1, 1).otherwise(F.min("verdict")).alias("verdict"), F.count("*").alias("subjects"))


QUERY_VERDICTS = f"select qname, case when max(verdict) = 1 then 1 else min(verdict) end verdict, count(*) subjects from ({HIT_VERDICTS}) group by qname"


def filtered_connections(spark, sf_dir):
    """Chains (orders) cut where the query of a link's number has a verdict other than 1; unknown ones stay; pieces of one part go."""
    r = R.raw(spark, sf_dir)
    w = Window.partitionBy("qname").orderBy(*R.TIES)
    links = r.select(F.col("qname").alias("chain"), F.row_number().over(w).alias("ord"), "pk")
    v = query_verdicts(spark, sf_dir).select(F.col("qname").alias("pk"), F.col("verdict"))
    j = links.join(v, "pk", "left").withColumn("cut", F.coalesce(F.col("verdict") != 1, F.lit(False)).cast("int"))
    o = Window.partitionBy("chain").orderBy("ord")
    j = j.withColumn("piece", F.coalesce(F.sum("cut").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return j.withColumn("size", F.count("*").over(Window.partitionBy("chain", "piece"))).where("size > 1").select("chain", "ord", "pk", "piece", "size")


FILTERED_CONNECTIONS = f"""with v as ({QUERY_VERDICTS}), {R.RAW_SQL}, l as (select qname chain, row_number() over (partition by qname order by {", ".join(R.TIES)})::int ord, pk from raw),
j as (select l.*, case when verdict <> 1 then 1 else 0 end cut from l left join v on v.qname = l.pk),
p as (select *, coalesce(sum(cut) over (partition by chain order by ord rows between unbounded preceding and 1 preceding), 0)::bigint piece from j), s as (select *, count(*) over (partition by chain, piece) size from p)
select chain, ord, pk, piece, size from s where size > 1"""


def effective_joins(spark, sf_dir):
    """Chains (orders) that join parts of different suppliers."""
    return R.raw(spark, sf_dir).groupBy("qname").agg(F.count_distinct("sk").alias("suppliers"), F.count("*").alias("parts")).where("suppliers > 1")


EFFECTIVE_JOINS = f"with {R.RAW_SQL} select qname, count(distinct sk) suppliers, count(*) parts from raw group by qname having count(distinct sk) > 1"

QUERIES = {
    "event_sessions": (event_sessions, EVENT_SESSIONS), "hit_verdicts": (hit_verdicts, HIT_VERDICTS), "query_verdicts": (query_verdicts, QUERY_VERDICTS), "filtered_connections": (filtered_connections, FILTERED_CONNECTIONS), "effective_joins": (effective_joins, EFFECTIVE_JOINS),
}
