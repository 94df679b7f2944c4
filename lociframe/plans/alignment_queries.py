"""Filters, read statistics and per-read operators of the alignment toolkit over the read views."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import support as S
from ..operators import intervals as I
from . import reads as R

KEY = ["qname", "ln", "pk", "sk", "pos"]


def alignment_admission(spark, sf_dir):
    """Reads that enter discovery: mapped with a mapped mate, neither secondary nor supplementary, the mate not inside one of their own introns."""
    s = R.spans(spark, sf_dir).where(R.admitted()).withColumn("segments", R.segment_array())
    inside = F.exists(F.sequence(F.lit(1), F.size("segments")), lambda i: (F.get("segments", i - 1)["b"] <= F.col("mpos")) & (F.col("mpos") <= F.get("segments", i)["a"]))
    keep = ~F.coalesce((F.col("mtid") == F.col("tid")) & inside, F.lit(False))
    return s.where(keep).select(*KEY, F.size("segments").alias("n"))


ALIGNMENT_ADMISSION = f"""with {R.SEGS_SQL}
select qname, ln, pk, sk, pos, case when gap > 0 then 2 else 1 end n from spans where {R.ADMITTED} and not coalesce(mtid = tid and gap > 0 and pos + half <= mpos and mpos <= pos + half + gap + 1, false)"""


def mate_in_intron(spark, sf_dir):
    """Reads of any kind whose mate lies in a gap of theirs, by sequence."""
    s = R.spans(spark, sf_dir).where("gap > 0 and mtid = tid")
    return s.where(F.col("mpos").between(F.col("pos") + F.col("half"), F.col("pos") + F.col("half") + F.col("gap") + 1)).groupBy("tid").agg(F.count("*").alias("n"))


MATE_IN_INTRON = f"with {R.SEGS_SQL} select tid, count(*) n from spans where gap > 0 and mtid = tid and mpos between pos + half and pos + half + gap + 1 group by tid"


def low_complexity(spark, sf_dir):
    """Texts, read as sequences, of which one letter of A, C, G, T, N makes up eight tenths."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.length("text")
    most = F.greatest(*(n - F.length(F.replace(F.translate("text", "acgtn", "ACGTN"), F.lit(c), F.lit(""))) for c in "ACGTN"))
    return d.select("doc_id", most.cast("long").alias("most"), (most >= F.floor(0.8 * n)).alias("low"))


LOW_COMPLEXITY = """with d as (select doc_id, length(text) n, greatest(length(text) - length(replace(translate(text, 'acgtn', 'ACGTN'), 'A', '')), length(text) - length(replace(translate(text, 'acgtn', 'ACGTN'), 'C', '')), length(text) - length(replace(translate(text, 'acgtn', 'ACGTN'), 'G', '')),
 length(text) - length(replace(translate(text, 'acgtn', 'ACGTN'), 'T', '')), length(text) - length(replace(translate(text, 'acgtn', 'ACGTN'), 'N', ''))) most from documents) select doc_id, most, most >= floor(0.8 * n) low from d"""


def view_filter(spark, sf_dir):
    """Mapping quality, all bits of one mask, none of another, and a read group (none passes)."""
    group = F.when(F.col("sk") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("rg"), F.col("sk") % 5))
    r = R.raw(spark, sf_dir).withColumn("rg", group)
    wanted = spark.createDataFrame([("rg1",), ("rg3",)], "rg string")
    ok = r.where((F.col("mapq") >= 12) & S.has_all(F.col("flag"), 1) & S.has_none(F.col("flag"), 1024 + 512))
    return ok.join(F.broadcast(wanted.withColumnRenamed("rg", "w")), F.col("rg") == F.col("w"), "left").where("w is not null or rg is null").select(*KEY, "rg", "flag")


VIEW_FILTER = f"""with {R.RAW_SQL}, r as (select *, case when sk % 7 = 0 then null else concat('rg', sk % 5) end rg from raw)
select qname, ln, pk, sk, pos, rg, flag from r where mapq >= 12 and (flag & 1) = 1 and (flag & 1536) = 0 and (rg in ('rg1', 'rg3') or rg is null)"""


def hash_subsample(spark, sf_dir):
    """A tenth of the read names, by a hash, so that mates stay together."""
    h = (S.x31(F.col("qname").cast("string")) + 11).bitwiseAND(0xFFFFFF)
    return R.raw(spark, sf_dir).select(*KEY, h.alias("h")).where(F.col("h") < 0.1 * (1 << 24))


HASH_SUBSAMPLE = f"""with {R.RAW_SQL}, h as (select qname, ln, pk, sk, pos, (list_reduce(list_transform(string_split(cast(qname as varchar), ''), lambda c: cast(ascii(c) as bigint)), lambda a, c: (a * 31 + c) % 4294967296) + 11) & 16777215 h from raw)
select * from h where h < 0.1 * 16777216"""


def pileup_read_filter(spark, sf_dir):
    """Reads that variant calling sees: mapped, some required bit, no excluded bit, mapping quality, no orphans."""
    f = F.col("flag")
    orphan = S.has_all(f, 1) & S.has_none(f, 64 + 128)
    return R.raw(spark, sf_dir).where(S.has_none(f, 4) & (f.bitwiseAND(16 + 64) != 0) & S.has_none(f, 512 + 1024) & (F.col("mapq") >= 6) & ~orphan).select(*KEY, "flag")


PILEUP_READ_FILTER = f"with {R.RAW_SQL} select qname, ln, pk, sk, pos, flag from raw where (flag & 4) = 0 and (flag & 80) <> 0 and (flag & 1536) = 0 and mapq >= 6 and not ((flag & 1) = 1 and (flag & 192) = 0)"


def region_parse(spark, sf_dir):
    """chr:beg-end with commas, 1-based; an end left out means to the end."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.concat(F.lit("chr:"), F.col("c_nationkey"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat(F.lit(":"), F.format_number(F.col("c_custkey") * 37, 0), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("-"), F.format_number(F.col("c_custkey") * 37 + 500, 0))))))
    t = c.select("c_custkey", text.alias("region"))
    r = F.when(F.col("region").rlike(r":[\d,]+(-[\d,]+)?$") & (F.length("region") - F.length(F.replace("region", F.lit(":"), F.lit(""))) > 1), F.regexp_extract("region", r"^(.*):", 1)).otherwise(F.col("region"))
    tail = F.regexp_replace(F.expr("substring(region, length(name) + 2)"), ",", "")
    t = t.withColumn("name", r).withColumn("tail", tail)
    num = lambda g: F.expr(f"try_cast(nullif(regexp_extract(tail, '^(\\\\d+)(-(\\\\d+))?$', {g}), '') as bigint)")
    return t.select("c_custkey", "region", "name", F.coalesce(num(1) - 1, F.lit(0)).alias("beg"), F.coalesce(num(3), F.lit(1 << 29)).alias("fin"))


REGION_PARSE = """with t as (select c_custkey, concat('chr:', c_nationkey, case when c_custkey % 5 = 0 then '' else concat(':', format('{:,}', c_custkey * 37), case when c_custkey % 3 = 0 then '' else concat('-', format('{:,}', c_custkey * 37 + 500)) end) end) region from customer),
n as (select *, case when regexp_matches(region, ':[0-9,]+(-[0-9,]+)?$') and length(region) - length(replace(region, ':', '')) > 1 then regexp_extract(region, '^(.*):', 1) else region end as name from t),
s as (select *, replace(substr(region, length(name) + 2), ',', '') tail from n)
select c_custkey, region, name, coalesce(try_cast(regexp_extract(tail, '^([0-9]+)', 1) as bigint) - 1, 0) beg, coalesce(try_cast(regexp_extract(tail, '-([0-9]+)$', 1) as bigint), 536870912) fin from s"""


def flag_letters(spark, sf_dir):
    return R.raw(spark, sf_dir).groupBy("flag", S.flag_letters(F.col("flag")).alias("letters")).agg(F.count("*").alias("n"))


FLAG_LETTERS = f"""with {R.RAW_SQL} select flag, concat({", ".join(f"case when (flag & {1 << i}) <> 0 then '{c}' else '' end" for i, c in enumerate("pPuUrR12sfd"))}) letters, count(*) n from raw group by flag"""


def strand_weights(spark, sf_dir):
    """Weights of a read's segments, by strand and segment: one in all for a spliced read."""
    s = R.segs(spark, sf_dir)
    return s.groupBy("rev", "i", "n").agg(F.count("*").alias("segments"), F.round(F.sum(S.segment_weight(F.col("i"), F.col("n"))), 6).alias("weight"))


STRAND_WEIGHTS = f"with {R.SEGS_SQL} select rev, i, n, count(*) segments, round(sum(case when n <= 1 then 0.0 when i = 0 or i = n - 1 then 1.0 / (2 * n - 2) else 1.0 / (n - 1) end)::double, 6) weight from segs group by all"

COUNTERS = {
    "n_pair_all": 1, "n_pair_good": 3, "n_read1": 65, "n_read2": 129, "n_dup": 1024,
}


def flagstat(spark, sf_dir):
    """Counters of flags for reads that pass and fail quality control; one pass over the table."""
    r = R.reads(spark, sf_dir)
    f = F.col("flag")
    some = {n: S.has_all(f, b) for n, b in COUNTERS.items()}
    paired = S.has_all(f, 1)
    both = paired & S.has_none(f, 12)
    apart = F.coalesce(F.col("mtid") != F.col("tid"), F.lit(True))
    some |= {"n_sgltn": paired & S.has_all(f, 8) & S.has_none(f, 4), "n_pair_map": both, "n_diffchr": both & apart, "n_diffhigh": both & apart & (F.col("mapq") >= 5), "n_mapped": S.has_none(f, 4)}
    return r.groupBy(S.has_all(f, 512).alias("failed")).agg(F.count("*").alias("n_reads"), *(F.count_if(c).alias(n) for n, c in some.items()))


FLAGSTAT = f"""with {R.READS_SQL} select (flag & 512) <> 0 failed, count(*) n_reads, {", ".join(f"count_if((flag & {b}) = {b})::bigint {n}" for n, b in COUNTERS.items())},
count_if((flag & 9) = 9 and (flag & 4) = 0)::bigint n_sgltn, count_if((flag & 1) = 1 and (flag & 12) = 0)::bigint n_pair_map, count_if((flag & 1) = 1 and (flag & 12) = 0 and coalesce(mtid <> tid, true))::bigint n_diffchr,
count_if((flag & 1) = 1 and (flag & 12) = 0 and coalesce(mtid <> tid, true) and mapq >= 5)::bigint n_diffhigh, count_if((flag & 4) = 0)::bigint n_mapped from reads group by all"""


def idxstats(spark, sf_dir):
    """Mapped and unmapped reads of each sequence, those without reads too."""
    names = spark.range(12).select(F.col("id").alias("tid"), (F.col("id") * 1000 + 500).alias("length"))
    s = R.raw(spark, sf_dir).groupBy("tid").agg(F.count_if(S.has_none(F.col("flag"), 4)).alias("mapped"), F.count_if(S.has_all(F.col("flag"), 4)).alias("unmapped"))
    return names.join(s, "tid", "left").select("tid", "length", F.coalesce("mapped", F.lit(0)).alias("mapped"), F.coalesce("unmapped", F.lit(0)).alias("unmapped"))


IDXSTATS = f"""with {R.RAW_SQL}, s as (select tid, count_if((flag & 4) = 0)::bigint mapped, count_if((flag & 4) <> 0)::bigint unmapped from raw group by tid)
select r tid, r * 1000 + 500 length, coalesce(mapped, 0) mapped, coalesce(unmapped, 0) unmapped from range(12) t(r) left join s on s.tid = r"""


def sort_coord(spark, sf_dir):
    """By sequence (unmapped last), place and strand; each read with its rank within its sequence."""
    r = R.raw(spark, sf_dir).withColumn("ref", F.when(S.has_all(F.col("flag"), 4), None).otherwise(F.col("tid")))
    r = I.ranked(r, "ref", "pos", ["pos", "rev", "qname", *R.TIES], "place")
    return r.select("ref", F.col("place").cast("int").alias("place"), *KEY).orderBy(F.col("ref").asc_nulls_last(), "place")


SORT_COORD = f"""with {R.RAW_SQL}, r as (select *, case when (flag & 4) <> 0 then null else tid end ref from raw)
select ref, row_number() over (partition by ref order by pos, rev, qname, {", ".join(R.TIES)})::int place, qname, ln, pk, sk, pos from r"""


def sort_name(spark, sf_dir):
    """Names with numbers in their natural order: digit runs are compared as numbers."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit("r"), F.col("c_nationkey"), F.lit("."), F.col("c_custkey")).alias("name"))
    parts = F.transform(F.regexp_extract_all("name", F.lit(r"(\d+|\D+)"), 1), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 18, "0")).otherwise(p))
    return c.withColumn("key", F.array_join(parts, "\x01")).orderBy("key").select("c_custkey", "name", F.md5("key").alias("key_md5"))


SORT_NAME = r"""with c as (select c_custkey, concat('r', c_nationkey, '.', c_custkey) as name from customer)
select c_custkey, name, md5(array_to_string(list_transform(regexp_extract_all(name, '[0-9]+|[^0-9]+'), lambda p: case when regexp_matches(p, '^[0-9]') then lpad(p, 18, '0') else p end), chr(1))) key_md5 from c"""


def merge_sorted(spark, sf_dir):
    """Two sorted inputs as one; the source breaks ties."""
    r = R.raw(spark, sf_dir)
    two = r.where("rev = 0").withColumn("src", F.lit(0)).unionByName(r.where("rev = 1").withColumn("src", F.lit(1)))
    return I.ranked(two, "tid", "pos", ["pos", "src", "qname", *R.TIES], "place").select("tid", "src", F.col("place").cast("int").alias("place"), *KEY)


MERGE_SORTED = f"with {R.RAW_SQL} select tid, rev src, row_number() over (partition by tid order by pos, rev, qname, {', '.join(R.TIES)})::int place, qname, ln, pk, sk, pos from raw"


def depth(spark, sf_dir):
    """Depth by strand at each covered place; segments only, not gaps."""
    s = R.segs(spark, sf_dir).where(S.has_none(F.col("flag"), 0x704)).select("tid", "rev", "a", "b")
    p = I.places(s, "tid", "a", "b", R.tasks(spark, sf_dir)).withColumnRenamed("place", "pos")
    return p.groupBy("tid", "bucket", "pos").agg(F.count_if(F.col("rev") == 0).alias("forward"), F.count_if(F.col("rev") == 1).alias("reverse")).drop("bucket")


DEPTH = f"""with {R.SEGS_SQL}, p as (select tid, rev, unnest(range(a, b + 1)) pos from segs where (flag & 1796) = 0)
select tid, pos, count_if(rev = 0)::bigint forward, count_if(rev = 1)::bigint reverse from p group by tid, pos"""


def depth_histogram(spark, sf_dir):
    d = depth(spark, sf_dir).withColumn("d", F.col("forward") + F.col("reverse"))
    return d.groupBy("d").agg(F.count("*").alias("places"))


DEPTH_HISTOGRAM = f"""with {R.SEGS_SQL}, p as (select tid, unnest(range(a, b + 1)) pos from segs where (flag & 1796) = 0), d as (select tid, pos, count(*) d from p group by tid, pos) select d, count(*) places from d group by d"""


def fixmate(spark, sf_dir):
    """Neighbours of one name exchange place, strand and insert size (difference of their 5' ends)."""
    r = R.reads(spark, sf_dir).where("ord <= 2")
    w = Window.partitionBy("qname").orderBy("ord")
    five = F.when(F.col("rev") == 1, F.col("end_pos") + 1).otherwise(F.col("pos"))
    other = lambda c: F.coalesce(F.lead(c).over(w), F.lag(c).over(w))
    r = r.withColumn("five", five).select(*KEY, "tid", "ord", other("tid").alias("mate_tid"), other("pos").alias("mate_pos"), other("rev").alias("mate_rev"), "five", other("five").alias("mate_five"))
    return r.select(*KEY, "ord", "mate_tid", "mate_pos", "mate_rev", F.when(F.col("tid") == F.col("mate_tid"), F.col("mate_five") - F.col("five")).otherwise(0).alias("isize"))


FIXMATE = f"""with {R.READS_SQL}, f as (select *, case when rev = 1 then end_pos + 1 else pos end five from reads where ord <= 2)
select a.qname, a.ln, a.pk, a.sk, a.pos, a.ord::int ord, b.tid mate_tid, b.pos mate_pos, b.rev mate_rev, case when a.tid = b.tid then b.five - a.five else 0 end isize from f a left join f b on a.qname = b.qname and a.ord <> b.ord"""


def fixmate_all(spark, sf_dir):
    """All reads: of one name, secondary ones aside, the first and second, third and fourth and so on exchange place, strand and insert size; the rest stay without a mate.

    `fixmate` follows its SQL, which has the first two reads of a name only. An insert size needs both reads, and what they say of their mates, mapped.
    """
    five = F.when(F.col("rev") == 1, F.col("end_pos") + 1).otherwise(F.col("pos"))
    second = F.col("flag").bitwiseAND(256) != 0
    r = R.reads(spark, sf_dir).select(*KEY, "tid", "rev", "ord", five.alias("five"), (F.col("flag").bitwiseAND(12) == 0).alias("mapped"), second.alias("second"))
    r = r.withColumn("place", F.row_number().over(Window.partitionBy("qname", "second").orderBy("ord")) - 1)
    w = Window.partitionBy("qname", "second", F.expr("case when second then place else place div 2 end")).orderBy("ord")
    other = lambda c: F.coalesce(F.lead(c).over(w), F.lag(c).over(w))
    r = r.withColumns({f"mate_{c}": other(c) for c in ("tid", "pos", "rev", "five", "mapped")})
    isize = F.when((F.col("tid") == F.col("mate_tid")) & F.col("mapped") & F.col("mate_mapped"), F.col("mate_five") - F.col("five")).otherwise(0)
    return r.select(*KEY, "ord", "mate_tid", "mate_pos", "mate_rev", isize.alias("isize"))


def rmdup_pe(spark, sf_dir):
    """Pairs by library, sequence, place and insert size: the one of greatest quality stays, the first of equals."""
    r = R.reads(spark, sf_dir).where("mtid = tid and mpos >= pos").withColumns({"lib": F.col("sk") % 3, "isize": F.col("mpos") - F.col("pos")})
    w = Window.partitionBy("lib", "tid", "pos", "isize").orderBy(F.desc("mapq"), "qname", "ord")
    return r.withColumn("r", F.row_number().over(w)).where("r = 1").select("lib", "tid", "pos", "isize", "qname", "mapq")


RMDUP_PE = f"""with {R.READS_SQL}, r as (select *, sk % 3 lib, mpos - pos isize from reads where mtid = tid and mpos >= pos)
select lib, tid, pos, isize, qname, mapq from (select *, row_number() over (partition by lib, tid, pos, isize order by mapq desc, qname, ord) r from r) where r = 1"""


def rmdup_se(spark, sf_dir):
    """Single reads by library, strand and 5' place."""
    r = R.raw(spark, sf_dir).withColumns({"lib": F.col("sk") % 3, "five": F.when(F.col("rev") == 1, F.col("end_pos")).otherwise(F.col("pos"))})
    w = Window.partitionBy("lib", "tid", "rev", "five").orderBy(F.desc("mapq"), "qname", *R.TIES)
    return r.withColumn("r", F.row_number().over(w)).where("r = 1").select("lib", "tid", "rev", "five", "qname", "mapq")


RMDUP_SE = f"""with {R.RAW_SQL}, r as (select *, sk % 3 lib, case when rev = 1 then end_pos else pos end five from raw)
select lib, tid, rev, five, qname, mapq from (select *, row_number() over (partition by lib, tid, rev, five order by mapq desc, qname, {", ".join(R.TIES)}) r from r) where r = 1"""


def shuffled_names(spark, sf_dir):
    """Reads dealt to 64 buckets by a hash of their name, in order within them: names stay together, places don't."""
    h = S.x31(F.col("qname").cast("string"))
    return R.raw(spark, sf_dir).select((h % 64).alias("bucket"), h.alias("h"), *KEY).repartition("bucket").sortWithinPartitions("bucket", "h", "qname", "ln")


SHUFFLED_NAMES = f"""with {R.RAW_SQL}, h as (select list_reduce(list_transform(string_split(cast(qname as varchar), ''), lambda c: cast(ascii(c) as bigint)), lambda a, c: (a * 31 + c) % 4294967296) h, qname, ln, pk, sk, pos from raw) select h % 64 bucket, * from h"""


def cigar_text() -> Column:
    """A clip for reverse reads, the first segment, and for spliced reads the gap and the second segment."""
    m1 = F.when(F.col("gap") > 0, F.col("half") + 1).otherwise(F.col("end_pos") - F.col("pos") + 1)
    rest = F.when(F.col("gap") > 0, F.concat(F.col("gap"), F.lit("N"), F.col("end_pos") - F.col("pos") - F.col("half"), F.lit("M"))).otherwise("")
    return F.concat(F.when(F.col("rev") == 1, "5S").otherwise(""), m1, F.lit("M"), rest)


CIGAR_SQL = f"""{R.SEGS_SQL},
cig as (select *, concat(case when rev = 1 then '5S' else '' end, case when gap > 0 then half + 1 else end_pos - pos + 1 end, 'M', case when gap > 0 then concat(gap, 'N', end_pos - pos - half, 'M') else '' end) cigar from spans)"""


def cigar_segments(spark, sf_dir):
    """Segments of a CIGAR: M, D, =, X extend the current one, N closes it, I, S, H, P leave it."""
    from ..functions.cigar import ops, segments

    r = R.spans(spark, sf_dir).select(*KEY, cigar_text().alias("cigar"))
    r = r.withColumn("s", F.explode(segments(ops(F.col("cigar")), F.col("pos"))))
    return r.select(*KEY, "cigar", F.col("s.a").alias("a"), F.col("s.b").alias("b"))


CIGAR_SEGMENTS = f"""with {CIGAR_SQL} select qname, ln, pk, sk, pos, cigar, pos a, case when gap > 0 then pos + half else end_pos end b from cig union all select qname, ln, pk, sk, pos, cigar, pos + half + gap + 1, end_pos + gap from cig where gap > 0"""


def cigar_lengths(spark, sf_dir):
    """Where a read ends on the reference, and how long it is, from its CIGAR."""
    from ..functions.cigar import ops, query_length, reference_length

    r = R.spans(spark, sf_dir).select(*KEY, cigar_text().alias("cigar")).withColumn("ops", ops(F.col("cigar")))
    return r.select(*KEY, (F.col("pos") + reference_length(F.col("ops"))).alias("ref_end"), query_length(F.col("ops")).alias("q_len"))


CIGAR_LENGTHS = f"with {CIGAR_SQL} select qname, ln, pk, sk, pos, end_pos + gap + 1 ref_end, end_pos - pos + 1 + case when rev = 1 then 5 else 0 end q_len from cig"


def supplementary_split(spark, sf_dir):
    """Entries of a list of further alignments: name,place,strand,CIGAR,quality,mismatches; each with its reference length."""
    from ..functions.cigar import ops, reference_length

    one = F.concat(F.lit("chr"), F.col("tid"), F.lit(","), F.col("pos") + 1, F.when(F.col("rev") == 1, ",-,").otherwise(",+,"), cigar_text(), F.lit(","), F.col("mapq"), F.lit(","), F.col("nm"), F.lit(";"))
    r = R.spans(spark, sf_dir).groupBy("qname").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", one.alias("t")))), lambda x: x["t"]), "").alias("sa"))
    parts = r.select("qname", F.posexplode(F.filter(F.split("sa", ";"), lambda x: x != "")).alias("i", "t")).withColumn("f", F.split("t", ","))
    return parts.select("qname", "i", F.get("f", F.lit(0)).alias("chrom"), (F.get("f", F.lit(1)).cast("long") - 1).alias("at"), F.get("f", F.lit(2)).alias("strand"), reference_length(ops(F.get("f", F.lit(3)))).alias("ref_len"), F.get("f", F.lit(5)).cast("int").alias("nm"))


SUPPLEMENTARY_SPLIT = f"with {CIGAR_SQL} select qname, (ord - 1)::int i, concat('chr', tid) chrom, pos \"at\", case when rev = 1 then '-' else '+' end strand, end_pos - pos + 1 + gap ref_len, (nm)::int nm from cig"


def bam_to_bed(spark, sf_dir):
    return R.spans(spark, sf_dir).where(S.has_none(F.col("flag"), 4)).select(F.concat(F.lit("chr"), F.col("tid")).alias("chrom"), F.col("pos").alias("beg"), (F.col("end_pos") + F.col("gap") + 1).alias("fin"), "qname", "mapq", F.when(F.col("rev") == 1, "-").otherwise("+").alias("strand"))


BAM_TO_BED = f"with {R.SEGS_SQL} select concat('chr', tid) chrom, pos beg, end_pos + gap + 1 fin, qname, mapq, case when rev = 1 then '-' else '+' end strand from spans where (flag & 4) = 0"


def unique_hits(spark, sf_dir):
    """Of each name the hit of greatest score; its quality falls with the second best."""
    r = R.raw(spark, sf_dir).withColumn("score", F.col("price").cast("long") % 1000 + 1)
    w = Window.partitionBy("qname").orderBy(F.desc("score"), *R.TIES)
    top = r.withColumns({"r": F.row_number().over(w), "n2": F.coalesce(F.lead("score").over(w), F.lit(0))}).where("r = 1")
    return top.select("qname", "ln", "score", F.least(F.floor(250.0 * (F.col("score") - F.col("n2")) / F.col("score")), F.lit(250)).alias("quality"))


UNIQUE_HITS = f"""with {R.RAW_SQL}, s as (select *, cast(floor(price) as bigint) % 1000 + 1 score from raw),
t as (select *, row_number() over w r, coalesce(lead(score) over w, 0) n2 from s window w as (partition by qname order by score desc, {", ".join(R.TIES)}))
select qname, ln, score, least(floor(250.0 * (score - n2) / score)::bigint, 250) quality from t where r = 1"""


def compare_aligners(spark, sf_dir):
    """Two sets of placements by read name: found by both, one or the other, and whether they agree (one sequence and strand, less than 100 apart), by quality."""
    r = R.reads(spark, sf_dir).withColumn("k", F.lit(0))
    return _compared(r.where("ord = 1"), r.where("ord = 2 and sk % 4 <> 0"))


def compare_aligners_all(spark, sf_dir):
    """The same over all reads: those at odd places of their name against those that follow them."""
    r = R.reads(spark, sf_dir).withColumn("k", F.expr("(ord - 1) div 2"))
    return _compared(r.where("ord % 2 = 1"), r.where("ord % 2 = 0"))


def _compared(a, b):
    a = a.select("qname", "k", "tid", "pos", "rev", (F.col("mapq") >= 30).alias("hi"))
    b = b.select("qname", "k", F.col("tid").alias("t2"), F.col("pos").alias("p2"), F.col("rev").alias("r2"), (F.col("mapq") >= 30).alias("hi2"))
    both = a.join(b, ["qname", "k"], "full_outer")
    kind = F.when(F.col("t2").isNull(), "first").when(F.col("tid").isNull(), "second").when((F.col("tid") == F.col("t2")) & (F.col("rev") == F.col("r2")) & (F.abs(F.col("pos") - F.col("p2")) < 100), "agree").otherwise("differ")
    return both.groupBy(kind.alias("kind"), F.coalesce("hi", F.lit(False)).alias("hi"), F.coalesce("hi2", F.lit(False)).alias("hi2")).agg(F.count("*").alias("n"))


COMPARE_ALIGNERS = f"""with {R.READS_SQL}, a as (select qname, tid, pos, rev, mapq >= 30 hi from reads where ord = 1), b as (select qname, tid t2, pos p2, rev r2, mapq >= 30 hi2 from reads where ord = 2 and sk % 4 <> 0)
select case when t2 is null then 'first' when tid is null then 'second' when tid = t2 and rev = r2 and abs(pos - p2) < 100 then 'agree' else 'differ' end kind, coalesce(hi, false) hi, coalesce(hi2, false) hi2, count(*) n from a full join b using (qname) group by all"""


def insert_histogram(spark, sf_dir):
    """Insert sizes by orientation of pairs on one sequence, up to 8,000."""
    return _sizes(spark, sf_dir, lambda r: r.where("size <= 8000"))


def insert_histogram_all(spark, sf_dir):
    """All pairs on one sequence: sizes of 7,999 and more are in the last bin."""
    return _sizes(spark, sf_dir, lambda r: r.withColumn("size", F.least("size", F.lit(7999))))


def _sizes(spark, sf_dir, bins):
    r = bins(R.reads(spark, sf_dir).where("mtid = tid").withColumn("size", F.abs(F.col("mpos") - F.col("pos"))))
    first, second = F.when(F.col("pos") <= F.col("mpos"), F.col("rev")).otherwise(F.col("mrev")), F.when(F.col("pos") <= F.col("mpos"), F.col("mrev")).otherwise(F.col("rev"))
    way = F.when((first == 0) & (second == 1), "inward").when((first == 1) & (second == 0), "outward").otherwise("other")
    return r.groupBy("size", way.alias("way")).agg(F.count("*").alias("n"))


INSERT_HISTOGRAM = f"""with {R.READS_SQL}, r as (select abs(mpos - pos) size, case when pos <= mpos then rev else mrev end f, case when pos <= mpos then mrev else rev end s from reads where mtid = tid)
select size, case when f = 0 and s = 1 then 'inward' when f = 1 and s = 0 then 'outward' else 'other' end way, count(*) n from r where size <= 8000 group by all"""


def placement_errors(spark, sf_dir):
    """Cumulative share of wrong placements by mapping quality, best first; a placement is wrong if its order has another priority."""
    r = R.raw(spark, sf_dir).select(F.floor(F.col("mapq") / 10).alias("q"), (F.col("pk") % 13 == F.col("sk") % 13).cast("int").alias("bad"))
    s = r.groupBy("q").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    w = Window.orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each tenth of quality
    return s.select("q", F.sum("n").over(w).alias("n"), F.sum("bad").over(w).alias("bad"))


PLACEMENT_ERRORS = f"""with {R.RAW_SQL}, s as (select mapq // 10 q, count(*) n, sum(case when pk % 13 = sk % 13 then 1 else 0 end) bad from raw group by all)
select q::bigint q, sum(n) over (order by q desc rows unbounded preceding)::bigint n, sum(bad) over (order by q desc rows unbounded preceding)::bigint bad from s"""

def read_strand(spark, sf_dir):
    """Strand that the tag of each admitted spliced read tells, 0 without a tag or of one segment; a third of the reads has no tag."""
    xs = F.when(F.col("qname") % 3 == 1, "-").when(F.col("qname") % 3 == 2, "+")
    s = R.spans(spark, sf_dir).where(R.admitted())
    return s.select(*KEY, S.strand(F.when(F.col("gap") > 0, 2).otherwise(1), xs).alias("strand"))


READ_STRAND = f"""with {R.SEGS_SQL}
select qname, ln, pk, sk, pos, case when gap = 0 or qname % 3 = 0 then 0 when qname % 3 = 1 then -1 else 1 end strand from spans where {R.ADMITTED}"""

QUERIES = {
    "alignment_admission": (alignment_admission, ALIGNMENT_ADMISSION), "read_strand": (read_strand, READ_STRAND), "mate_in_intron": (mate_in_intron, MATE_IN_INTRON), "low_complexity": (low_complexity, LOW_COMPLEXITY), "view_filter": (view_filter, VIEW_FILTER),
    "hash_subsample": (hash_subsample, HASH_SUBSAMPLE), "pileup_read_filter": (pileup_read_filter, PILEUP_READ_FILTER), "region_parse": (region_parse, REGION_PARSE), "flag_letters": (flag_letters, FLAG_LETTERS),
    "strand_weights": (strand_weights, STRAND_WEIGHTS), "flagstat": (flagstat, FLAGSTAT), "idxstats": (idxstats, IDXSTATS), "sort_coord": (sort_coord, SORT_COORD), "sort_name": (sort_name, SORT_NAME),
    "merge_sorted": (merge_sorted, MERGE_SORTED), "depth": (depth, DEPTH), "depth_histogram": (depth_histogram, DEPTH_HISTOGRAM), "fixmate": (fixmate, FIXMATE), "fixmate_all": (fixmate_all, None), "rmdup_pe": (rmdup_pe, RMDUP_PE), "rmdup_se": (rmdup_se, RMDUP_SE),
    "shuffled_names": (shuffled_names, SHUFFLED_NAMES), "cigar_segments": (cigar_segments, CIGAR_SEGMENTS), "cigar_lengths": (cigar_lengths, CIGAR_LENGTHS), "supplementary_split": (supplementary_split, SUPPLEMENTARY_SPLIT),
    "bam_to_bed": (bam_to_bed, BAM_TO_BED), "unique_hits": (unique_hits, UNIQUE_HITS), "compare_aligners": (compare_aligners, COMPARE_ALIGNERS), "insert_histogram": (insert_histogram, INSERT_HISTOGRAM), "compare_aligners_all": (compare_aligners_all, None), "insert_histogram_all": (insert_histogram_all, None), "placement_errors": (placement_errors, PLACEMENT_ERRORS),
}
